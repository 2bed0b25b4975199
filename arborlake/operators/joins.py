"""Joins that Spark SQL has no form for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.operators.storage import cut, small

def with_row_index(df: DataFrame, order: list, name: str = "row_index") -> DataFrame:
    """Adds 0, 1, 2 .. in the given order without bringing all rows into one task.

    Rows are laid out by range and sorted there; each range's start is the sum of the sizes before it, which is one
    number a partition. The layout is written once, as another run would sample other ranges. The order should be
    total, else ties fall as they do.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))
    laid = cut(laid)
    sizes = {r["_pid"]: r["n"] for r in laid.groupBy("_pid").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for pid in sorted(sizes):
        starts.append((pid, total))
        total += sizes[pid]
    table = spark.createDataFrame(starts or [(0, 0)], "_pid int, _start bigint")
    return laid.join(F.broadcast(table), "_pid").withColumn(name, F.col("_start") + F.col("_at")).drop("_pid", "_at", "_start")


def positional_join(left: DataFrame, right: DataFrame, left_order: list, right_order: list, how: str = "full") -> DataFrame:
    """Row i beside row i; the longer side's rest has nulls (full) or is left out (inner, PASTE)."""
    a, b = with_row_index(left, left_order, "_i"), with_row_index(right, right_order, "_i")
    return a.join(b, "_i", how).drop("_i")


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str], value_cols: list[str], how: str = "left", strict: bool = False, bucket: Column | None = None) -> DataFrame:
    """Each left row with the values of the latest right row of the same keys at or before it (before it, if strict).

    bucket: an expression over `_t`, the time, that rises with it; then rows are dealt by keys and bucket, so that a hot key
    spreads over many tasks, and a bucket starts with the last right row of those before it. how: left, inner, semi or
    anti. Of right rows of equal time the one with the greatest values counts.
    """
    v = F.struct(*[F.col(c) for c in value_cols])
    side_left, side_right = (0, 1) if strict else (1, 0)
    a = left.withColumn("_t", F.col(left_on)).withColumn("_s", F.lit(side_left)).withColumn("_v", F.lit(None).cast(right.select(v.alias("v")).schema["v"].dataType))
    b = right.select(*by, F.col(right_on).alias("_t"), F.lit(side_right).alias("_s"), v.alias("_v"))
    both = a.unionByName(b, allowMissingColumns=True)
    both = both.withColumn("_b", bucket if bucket is not None else F.lit(0))
    within = Window.partitionBy(*by, "_b").orderBy(F.col("_t").asc_nulls_first(), "_s", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_m", F.last("_v", ignorenulls=True).over(within)).where(F.col("_s") == side_left)
    if bucket is not None:
        # one row a bucket: the last right row up to it, brought forward over the buckets of the key
        ends = both.where(F.col("_s") == side_right).groupBy(*by, "_b").agg(F.max(F.struct("_t", "_v")).alias("_e"))
        every = both.select(*by, "_b").distinct()
        before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carried = every.join(ends, [*by, "_b"], "left").withColumn("_c", F.last("_e", ignorenulls=True).over(before)["_v"]).drop("_e")
        found = found.join(carried, [*by, "_b"], "left").withColumn("_m", F.coalesce("_m", "_c")).drop("_c")
    if how in ("inner", "semi"):
        found = found.where(F.col("_m").isNotNull())
    elif how == "anti":
        found = found.where(F.col("_m").isNull())
    keep = [F.col(c) for c in left.columns]
    if how not in ("semi", "anti"):
        keep += [F.col("_m")[c].alias(c) for c in value_cols]
    return found.select(*keep)


def any_join(left: DataFrame, right: DataFrame, on: list[str], order: list, how: str = "left") -> DataFrame:
    """At most one match for each left row: the right side's first by `order`."""
    w = Window.partitionBy(*on).orderBy(*order)
    first = right.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return left.join(first, on, how)


def right_semi(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return right.join(left, on, "left_semi")


def right_anti(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return right.join(left, on, "left_anti")


def partitioned_outer_join(left: DataFrame, right: DataFrame, partition: list[str], on: list[str]) -> DataFrame:
    """Densifies: for each partition of left, each row of right, with the left values where there are any.

    right is the dense dimension (a calendar, say) and is broadcast behind a check of its bytes. The result has a row
    for each key and row of it, whatever joins them.
    """
    keys = left.select(*partition).distinct()
    grid = keys.join(small(right), F.lit(True))
    return grid.join(left, [*partition, *on], "left")


#: Bytes of query vectors that one scan of the rows takes along, and numbers that a task compares at once.
BLOCK_BYTES, COMPARED = 32 << 20, 4_000_000


def nearest_vectors(queries: DataFrame, rows: DataFrame, query_id: str, query_vec: str, row_id: str, row_vec: str, k: int, metric: str = "l2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k nearest rows of each query: (query_id, row_id, distance, rank). Exact.

    The queries are a stated set; they go over all rows in blocks of so many bytes, each task keeps the k best for each
    query of what it has read, and these are merged. Ties go to the smaller row id; nulls are left out. metric: l2 or
    cosine distance.
    """
    spark = rows.sparkSession
    out = None
    q = queries.select(F.col(query_id).alias("i"), F.col(query_vec).alias("v")).where("i is not null and v is not null")

    def distances(m: np.ndarray, x: np.ndarray) -> np.ndarray:
        if metric == "cosine":
            return 1 - (m @ x.T) / np.maximum(np.linalg.norm(m, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :], 1e-300)
        return np.sqrt(((m[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))

    def one(ids: list, vectors: list):
        sent = spark.sparkContext.broadcast((np.array(ids), np.array(vectors, np.float64)))  # block_bytes

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, mat = sent.value
            top_d, top_i = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64)
            filled = 0
            for pdf in batches:
                pdf = pdf.dropna()
                for at in range(0, len(pdf), 512):
                    part = pdf.iloc[at : at + 512]
                    x = np.array(part["v"].tolist(), np.float64)
                    own = part["i"].to_numpy()
                    filled += len(own)
                    step = max(1, COMPARED // x.size)
                    for m in range(0, len(ids), step):
                        d = np.concatenate([top_d[m : m + step], distances(mat[m : m + step], x)], axis=1)
                        i = np.concatenate([top_i[m : m + step], np.broadcast_to(own, (len(d), len(own)))], axis=1)
                        order = np.lexsort((i, d), axis=1)[:, :k]
                        top_d[m : m + step], top_i[m : m + step] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
            n = min(filled, k)
            yield pd.DataFrame({"q": np.repeat(ids, n), "r": top_i[:, :n].ravel(), "d": top_d[:, :n].ravel()})

        return rows.select(F.col(row_id).alias("i"), F.col(row_vec).alias("v")).mapInPandas(best, "q bigint, r bigint, d double")

    ids: list = []
    vectors: list = []
    for r in q.toLocalIterator():
        ids.append(r["i"])
        vectors.append(r["v"])
        if len(ids) * len(r["v"]) * 8 >= block_bytes:
            part = one(ids, vectors)
            out, ids, vectors = part if out is None else out.unionAll(part), [], []
    if ids:
        part = one(ids, vectors)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], "q bigint, r bigint, d double")
    w = Window.partitionBy("q").orderBy("d", "r")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(query_id), F.col("r").alias(row_id), F.col("d").alias("distance"), "rank")


#: Ranges of the numbers that nearest_value() deals each key to.
RANGES = 256


def nearest_value(left: DataFrame, right: DataFrame, left_on: str, right_on: str, right_id: str, by: list[str], ranges: int = RANGES) -> DataFrame:
    """Each left row with the right row of the same keys whose number is nearest: adds right_id and distance. Ties go to the smaller number, then id.

    Rows are dealt by keys and ranges of the number, so that a hot key, or no key at all, spreads over tasks; a range
    sees the last number before it and the first behind it. Left rows without a number, or without any of their keys,
    have nulls.
    """
    b = right.where(F.col(right_on).isNotNull()).groupBy(*by, F.col(right_on).alias("_t")).agg(F.min(right_id).alias("_id"))
    kind = dict(b.dtypes)["_id"]
    cuts = b.agg(F.percentile_approx("_t", [k / ranges for k in range(1, ranges)], 10_000).alias("p")).first()["p"] or []  # bounds alone
    cuts = sorted(set(cuts))
    number = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("_t"))) if cuts else F.lit(0)
    v = F.struct(F.col("_t").alias("x"), F.col("_id").alias("id"))
    a = left.withColumn("_t", F.col(left_on)).withColumn("_s", F.lit(1))
    both = a.unionByName(b.withColumn("_s", F.lit(0)), allowMissingColumns=True).withColumn("_b", number)
    both = both.withColumn("_v", F.when(F.col("_s") == 0, v))
    own = Window.partitionBy(*by, "_b").orderBy(F.col("_t").asc_nulls_first(), "_s")
    near = both.withColumn("_lo", F.last("_v", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_hi", F.first("_v", ignorenulls=True).over(own.rowsBetween(0, Window.unboundedFollowing))).where("_s = 1")
    ends = both.groupBy(*by, "_b").agg(F.min("_v").alias("_first"), F.max("_v").alias("_last"))  # a row for each key and range
    over = Window.partitionBy(*by).orderBy("_b")
    ends = ends.withColumn("_before", F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_behind", F.first("_first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)))
    on = F.col("_b") == F.col("e__b")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"e_{c}"))
    ends = ends.select(*[F.col(c).alias(f"e_{c}") for c in [*by, "_b"]], "_before", "_behind")
    near = near.join(ends, on, "left").withColumn("_lo", F.coalesce("_lo", "_before")).withColumn("_hi", F.coalesce("_hi", "_behind"))
    lo_d, hi_d = F.col("_t") - F.col("_lo.x"), F.col("_hi.x") - F.col("_t")
    pick = F.when(F.col("_t").isNull(), None).when(F.col("_lo").isNull(), F.col("_hi")).when(F.col("_hi").isNull() | (lo_d <= hi_d), F.col("_lo")).otherwise(F.col("_hi"))
    return near.withColumn("_p", pick).select(*[F.col(c) for c in left.columns], F.col("_p.id").cast(kind).alias(right_id), F.abs(F.col("_t") - F.col("_p.x")).alias("distance"))


def containment_join(outer: DataFrame, inner: DataFrame, by: list[str], outer_range: tuple[str, str], inner_range: tuple[str, str], width: int) -> DataFrame:
    """Pairs of one key where the inner range lies in the outer: an equi-join on keys and buckets of `width`, then the ranges.

    The outer side has a row for each bucket that it touches, the inner one for that of its start, so no pair comes twice.
    """
    a0, a1 = outer_range
    b0, b1 = inner_range
    a = outer.withColumn("_b", F.explode(F.sequence(F.floor(F.col(a0) / width), F.floor(F.col(a1) / width))))
    b = inner.withColumn("_b", F.floor(F.col(b0) / width))
    return a.join(b, [*by, "_b"]).where((F.col(b0) >= F.col(a0)) & (F.col(b1) <= F.col(a1))).drop("_b")
