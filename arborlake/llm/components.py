"""Connected components of a table of links, by alternating large and small stars.

Each round hangs the neighbours of a node onto the smallest of them, until every edge leads to the least node of its
component. Rounds grow with the logarithm of the longest path. The edges are written to the shared folder each round
and never brought to the driver; a node with a third of all edges is summed before the shuffle, and the join back to
its edges is one that Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from arborlake.llm.common import by_sorting, cut


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, and a mark of them that is taken as they are written."""
    seen = Observation()
    out = cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")))
    return out, (seen.get["n"], seen.get["s"])


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(by_sorting(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(by_sorting(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node that has a link; root is the least node of its component, which has a row too.

    Links may repeat, point either way or join a node to itself; links with a null end are left out. No links: no rows.
    """
    edges, before = _marked(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())
    while before[0]:
        edges, now = _marked(_small(_large(edges)))
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
