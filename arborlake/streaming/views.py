"""Continuous queries over event streams, and the same queries over tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, size: str, keys: list[str], aggs: list[Column], lateness: str | None = None) -> DataFrame:
    """Aggregates of windows of one size. lateness: the watermark; on a stream rows later than it are dropped."""
    e = events.withWatermark(ts, lateness) if lateness else events
    g = e.groupBy(F.window(ts, size), *keys).agg(*aggs)
    return g.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in g.columns if c != "window"])


def hopping(events: DataFrame, ts: str, size: str, slide: str, keys: list[str], aggs: list[Column], lateness: str | None = None) -> DataFrame:
    e = events.withWatermark(ts, lateness) if lateness else events
    g = e.groupBy(F.window(ts, size, slide), *keys).agg(*aggs)
    return g.select(F.col("window.start").alias("window_start"), *[c for c in g.columns if c != "window"])


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], aggs: list[Column], lateness: str | None = None) -> DataFrame:
    """Aggregates of runs of a key's events with no gap as long as `gap`."""
    e = events.withWatermark(ts, lateness) if lateness else events
    g = e.groupBy(F.session_window(ts, gap), *keys).agg(*aggs)
    return g.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *[c for c in g.columns if c != "session_window"])


def deduplicated(events: DataFrame, keys: list[str], ts: str, lateness: str) -> DataFrame:
    """The first event of each key; on a stream keys are forgotten behind the watermark."""
    if events.isStreaming:
        return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, before: str, lateness: str) -> DataFrame:
    """Pairs of equal keys whose right time is at most `before` earlier than the left's; both sides' state is bounded by the watermarks."""
    a = left.withWatermark(left_ts, lateness) if left.isStreaming else left
    b = right.withWatermark(right_ts, lateness) if right.isStreaming else right
    near = (F.col(right_ts) <= F.col(left_ts)) & (F.col(right_ts) >= F.col(left_ts) - F.expr(f"INTERVAL {before}"))
    on = None
    for k in keys:
        same = a[k] == b[k]
        on = same if on is None else on & same
    return a.join(b, on & near)


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) of the keys of each batch, from a state of two numbers that is kept for every key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, value).groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, n bigint, total double", "n bigint, total double", "update", "NoTimeout")


def read_stream(spark: SparkSession, sf_dir: str, name: str, per_trigger: int = 1) -> DataFrame:
    """A folder of parquet files as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def live_view(df: DataFrame, name: str, checkpoint: str, mode: str = "append", every: str | None = None):
    """LIVE VIEW: keeps a query's result in memory under a name. `every`: REFRESH EVERY; else it runs over what there is."""
    w = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def watch(df: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update"):
    """WATCH: f gets each batch of changes and its number; a batch may come again after a failure, with the same number."""
    return df.writeStream.outputMode(mode).foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def alive(df: DataFrame, ts: str, ttl: str, now: Column) -> DataFrame:
    """TTL: rows that are not older than ttl."""
    return df.where(F.col(ts) > now - F.expr(f"INTERVAL {ttl}"))
