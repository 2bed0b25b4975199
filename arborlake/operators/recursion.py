"""Recursion to a fix-point over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.operators.storage import cut


#: Rounds whose rows are read side by side before they are written together.
TOGETHER = 16


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], most_rounds: int = 1000) -> DataFrame:
    """WITH RECURSIVE .. UNION: rows of start and of each step from the new rows, until there are none.

    A round writes its new rows; those seen before are written again once in TOGETHER rounds.
    """
    seen = new = cut(start.distinct())
    for n in range(1, most_rounds + 1):
        new = cut(step(new).select(*seen.columns).distinct().subtract(seen))
        if new.isEmpty():
            return seen
        seen = seen.unionAll(new)
        if n % TOGETHER == 0:
            seen = cut(seen)
    raise ValueError(f"no fix-point after {most_rounds} rounds")


def fixpoint_by_key(start: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], key: list[str], best: Column, most_rounds: int = 1000) -> DataFrame:
    """WITH RECURSIVE .. USING KEY: one row a key, replaced where a step has one with a smaller `best`.

    step(new, all): candidate rows with the columns of start. Rounds end when no row improves.
    """
    cols = start.columns
    pick = lambda df: df.groupBy(*key).agg(F.min_by(F.struct(*cols), best).alias("_r")).select("_r.*")
    seen = new = cut(pick(start))
    for _ in range(most_rounds):
        offered = pick(step(new, seen).select(*cols)).withColumn("_b", best)
        old = seen.withColumn("_o", best).select(*key, "_o")
        new = cut(offered.join(old, key, "left").where(F.col("_o").isNull() | (F.col("_b") < F.col("_o"))).select(*cols))
        if new.isEmpty():
            return seen
        seen = cut(pick(seen.unionAll(new)))
    raise ValueError(f"no fix-point after {most_rounds} rounds")


def connect_by(df: DataFrame, child: str, parent: str, start: Column, most_levels: int = 100) -> DataFrame:
    """START WITH start CONNECT BY PRIOR child = parent NOCYCLE: adds level, root, path (an array) and is_cycle.

    A row whose child is on its own path is not expanded; is_cycle marks the row above it. A level is one join.
    """
    key = F.col(child)
    level = df.where(start).withColumn("level", F.lit(1)).withColumn("root", key).withColumn("path", F.array(key))
    out = level = cut(level)
    for n in range(2, most_levels + 1):
        up = level.select(F.col(child).alias("_p"), F.col("root").alias("_root"), F.col("path").alias("_path"))
        level = df.join(up, df[parent] == F.col("_p")).where(~F.array_contains("_path", df[child]))
        level = cut(level.select(*df.columns, F.lit(n).alias("level"), F.col("_root").alias("root"), F.concat("_path", F.array(key)).alias("path")))
        if level.isEmpty():
            break
        out = out.unionAll(level)
    else:
        raise ValueError(f"more than {most_levels} levels")
    back = df.select(F.col(parent).alias("_from"), F.col(child).alias("_to"))
    loops = out.select(child, "path").distinct().join(back, F.col(child) == F.col("_from")).where(F.array_contains("path", F.col("_to"))).select(F.col(child).alias("_c"), F.col("path").alias("_pth")).distinct()
    return out.join(loops, (F.col(child) == F.col("_c")) & (F.col("path") == F.col("_pth")), "left").withColumn("is_cycle", F.col("_c").isNotNull()).drop("_c", "_pth")


def depth_first(df: DataFrame, path: str = "path") -> Column:
    """SEARCH DEPTH FIRST: the ordering column of rows with a path."""
    return F.col(path)


def breadth_first(df: DataFrame, path: str = "path") -> Column:
    """SEARCH BREADTH FIRST: level before path."""
    return F.struct(F.size(path), F.col(path))


def closure(edges: DataFrame, a: str, b: str, most_rounds: int = 64) -> DataFrame:
    """(a, b) for each pair that a path of one edge or more joins. Paths double in length each round."""
    seen = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").distinct())
    n = seen.count()
    for _ in range(most_rounds):
        longer = seen.alias("x").join(seen.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a"), F.col("y.b"))
        seen = cut(seen.unionAll(longer).distinct())
        m = seen.count()
        if m == n:
            return seen
        n = m
    raise ValueError(f"paths of more than 2^{most_rounds} edges")
