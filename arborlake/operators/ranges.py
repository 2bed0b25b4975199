"""Sets of half-open integer ranges, one row a range, a set for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalise(df: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The union: overlapping and touching ranges become one, empty ones go. Gaps and islands over a running greatest end."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.where(F.col(start) < F.col(end)).withColumn("_new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    d = d.withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*by, "_i").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_i")


def _combine(sets: list[DataFrame], by: list[str], keep, start: str, end: str) -> DataFrame:
    """Spans between neighbouring bounds where keep(depths) holds, joined up; a set's depth is how many of its ranges are open."""
    events = None
    for k, s in enumerate(sets):
        s = s.where(F.col(start) < F.col(end))
        for at, step in ((start, 1), (end, -1)):
            e = s.select(*by, F.col(at).alias("_x"), *[F.lit(step if j == k else 0).alias(f"_d{j}") for j in range(len(sets))])
            events = e if events is None else events.unionAll(e)
    points = events.groupBy(*by, "_x").agg(*[F.sum(f"_d{j}").alias(f"_d{j}") for j in range(len(sets))])
    w = Window.partitionBy(*by).orderBy("_x")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    depth = points.select(*by, "_x", F.lead("_x").over(w).alias("_y"), *[(F.sum(f"_d{j}").over(up) > 0).alias(f"_o{j}") for j in range(len(sets))])
    spans = depth.where(F.col("_y").isNotNull() & keep(*[F.col(f"_o{j}") for j in range(len(sets))]))
    return normalise(spans.select(*by, F.col("_x").alias(start), F.col("_y").alias(end)), by, start, end)


def intersect(a: DataFrame, b: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    return _combine([a, b], by, lambda x, y: x & y, start, end)


def difference(a: DataFrame, b: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    return _combine([a, b], by, lambda x, y: x & ~y, start, end)


def symmetric_difference(a: DataFrame, b: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    return _combine([a, b], by, lambda x, y: x != y, start, end)
