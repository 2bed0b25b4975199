from pyspark.sql import functions as F

from arborlake.streaming import views as V

DIR = "/root/testdata/sf0.001"


def done(q):
    try:
        assert q.awaitTermination(120)
        if q.exception():
            raise q.exception()
    finally:
        q.stop()


def parted(spark, tmp_path):
    """The events in time order, as files of a folder."""
    e = spark.read.parquet(f"{DIR}/events.parquet")
    e.repartitionByRange(4, "ts").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_tumbling_is_the_batch_result(spark, tmp_path):
    d = parted(spark, tmp_path)
    e = V.read_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    done(V.live_view(V.tumbling(e, "ts", "1 hour", ["event_type"], [F.count("*").alias("n")], "30 days"), "tumbled", f"{tmp_path}/c1", "complete"))
    b = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = V.tumbling(b, "ts", "1 hour", ["event_type"], [F.count("*").alias("n")])
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, want.collect()))


def test_state_and_watch(spark, tmp_path):
    d = parted(spark, tmp_path)
    seen = {}

    def keep(batch, number):
        for r in batch.collect():
            seen[r.user_id] = (r.n, round(r.total, 6))

    done(V.watch(V.running_totals(V.read_stream(spark, d, "events"), "user_id", "value"), keep, f"{tmp_path}/c2"))
    want = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("t")).collect()
    assert seen == {r.user_id: (r.n, round(r.t, 6)) for r in want}


def test_deduplicated_stream(spark, tmp_path):
    d = parted(spark, tmp_path)
    e = V.read_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    done(V.live_view(V.deduplicated(e, ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type"), "deduplicated", f"{tmp_path}/c3"))
    want = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_type").distinct()
    assert sorted(map(tuple, spark.table("deduplicated").collect())) == sorted(map(tuple, want.collect()))
