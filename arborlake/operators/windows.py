"""Window, top-k and grouping forms that Spark SQL lacks, as compositions of those it has."""

from __future__ import annotations

from decimal import Decimal
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.operators.joins import with_row_index


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """Rows whose window expression holds."""
    return df.withColumn("_q", condition).where("_q").drop("_q")


def distinct_on(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def limit_by(df: DataFrame, n: int, keys: list[str], order: list, offset: int = 0) -> DataFrame:
    """The first n rows of each key after `offset`. Spark keeps n + offset rows of a key a task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n + offset).where(F.col("_r") > offset).drop("_r")


def limit_with_ties(df: DataFrame, n: int, order: list) -> DataFrame:
    """The first n rows, and those that equal the last of them in the order.

    The n-th row's keys come from a top-k, so nothing but n rows meets in one task.
    """
    top = df.orderBy(*order).limit(n)
    names = [_plain(c) for c in order]
    keys = [F.col(x).alias(f"_k{i}") for i, x in enumerate(names)]
    last = top.orderBy(*order).offset(max(0, min(n, top.count()) - 1)).limit(1).select(*keys)
    same = [F.col(x).eqNullSafe(F.col(f"_k{i}")) for i, x in enumerate(names)]
    return top.join(F.broadcast(last), same, "left_anti").unionAll(df.join(F.broadcast(last), same, "left_semi"))


def _plain(c) -> str:
    """The name of an ordering column."""
    if isinstance(c, str):
        return c
    text = c._jc.toString() if hasattr(c, "_jc") else str(c)
    return text.split(" ")[0].strip("`'")


def limit_percent(df: DataFrame, percent: float, order: list) -> DataFrame:
    """The first `percent` of all rows in the order, rounded down."""
    total = df.count()
    return with_row_index(df, order, "_i").where(F.col("_i") < int(total * percent / 100)).drop("_i")


def reservoir(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows drawn at random: those of the least seeded hash of the whole row. The same for the same rows, however they lie."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns).limit(n)


def groups_frame(df: DataFrame, agg: str, value: str, partition: list[str], order: str, start: int, end: int, name: str) -> DataFrame:
    """sum, count, min, max or avg over a GROUPS frame: from `start` to `end` peer groups around the current one."""
    w = Window.partitionBy(*partition).orderBy(order)
    ranked = df.withColumn("_g", F.dense_rank().over(w))
    frame = Window.partitionBy(*partition).orderBy("_g").rangeBetween(start, end)
    return ranked.withColumn(name, getattr(F, agg)(value).over(frame)).drop("_g")


def excluded_frame(df: DataFrame, agg: str, value: str, partition: list[str], order: str, exclude: str, name: str) -> DataFrame:
    """sum or count over the whole partition with EXCLUDE current row, group or ties: what is excluded is taken off again."""
    every = Window.partitionBy(*partition)
    peers = Window.partitionBy(*partition, order)
    f = getattr(F, agg)
    total, same = f(value).over(every), f(value).over(peers)
    own = F.col(value) if agg == "sum" else F.when(F.col(value).isNotNull(), 1).otherwise(0)
    own = F.coalesce(own, F.lit(0))
    n_total, n_same, n_own = F.count(value).over(every), F.count(value).over(peers), F.when(F.col(value).isNotNull(), 1).otherwise(0)
    if exclude == "current row":
        out, left = total - own, n_total - n_own
    elif exclude == "group":
        out, left = total - F.coalesce(same, F.lit(0)), n_total - n_same
    elif exclude == "ties":
        out, left = total - F.coalesce(same, F.lit(0)) + own, n_total - n_same + n_own
    else:
        raise ValueError(exclude)
    return df.withColumn(name, F.when(left > 0, out).otherwise(F.lit(0) if agg == "count" else F.lit(None)))


#: Steps of the grid that fill() carries values over in one task.
STEPS = 4096


def fill(df: DataFrame, key: str, step, start=None, end=None, interpolate: list[str] = ()) -> DataFrame:
    """ORDER BY key WITH FILL STEP step: rows for missing keys; `interpolate` columns carry the value before them.

    step: a number, or an interval for dates and times. The grid is made in pieces, and values are carried over each
    piece and then from piece to piece, of which one row each is looked at. Keys off the grid are left out.
    """
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    lo, hi = lo if start is None else start, hi if end is None else end
    if lo is None:
        return df
    spark = df.sparkSession
    if isinstance(step, int) and isinstance(lo, int):
        n = max(0, (hi - lo) // step + 1)
        grid = spark.range(n).select(F.col("id").alias("_i"), (F.lit(lo) + F.col("id") * step).cast(dict(df.dtypes)[key]).alias(key))
    else:
        whole = spark.range(1).select(F.posexplode(F.sequence(F.lit(lo), F.lit(hi), F.lit(step))).alias("_i", key))
        grid = whole.select(F.col("_i").cast("bigint").alias("_i"), key)
    out = grid.join(df, key, "left").withColumn("_b", F.floor(F.col("_i") / STEPS))
    if interpolate:
        inside = Window.partitionBy("_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
        ends = out.groupBy("_b").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_i"))).alias(f"_last_{c}") for c in interpolate])
        before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row for each piece of the grid
        ends = ends.select("_b", *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_from_{c}") for c in interpolate])
        for c in interpolate:
            out = out.withColumn(c, F.last(c, ignorenulls=True).over(inside))
        out = out.join(ends, "_b")
        for c in interpolate:
            out = out.withColumn(c, F.coalesce(c, f"_from_{c}")).drop(f"_from_{c}")
    return out.drop("_b", "_i").select(*df.columns)


def with_totals(df: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """GROUP BY keys WITH TOTALS: the groups and one row of all, whose keys are null, with `is_total`."""
    groups = df.groupBy(*keys).agg(*aggs).withColumn("is_total", F.lit(False))
    return groups.unionByName(df.agg(*aggs).withColumn("is_total", F.lit(True)), allowMissingColumns=True)


def grouping_sets(df: DataFrame, sets: list[list[str]], aggs: list[Column], distinct: bool = False) -> DataFrame:
    """Grouping sets; with `distinct` sets that occur twice count once (GROUP BY DISTINCT)."""
    if distinct:
        sets = [list(s) for s in dict.fromkeys(tuple(sorted(set(s))) for s in sets)]
    cols = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets(sets, *cols).agg(*aggs)


def rollup_sets(cols: list[str]) -> list[list[str]]:
    return [cols[:k] for k in range(len(cols), -1, -1)]


def cube_sets(cols: list[str]) -> list[list[str]]:
    return [list(c) for k in range(len(cols), -1, -1) for c in combinations(cols, k)]


def pivot_dynamic(df: DataFrame, group: list[str], on: str, agg: Column, most: int = 1000) -> DataFrame:
    """PIVOT without a list of values: those of `on`, in order, become columns; more than `most` is an error."""
    values = [r[0] for r in df.select(on).where(F.col(on).isNotNull()).distinct().orderBy(on).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{on} has more than {most} values")
    return df.groupBy(*group).pivot(on, values).agg(agg)


def quantiles_disc(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, str]) -> DataFrame:
    """(*keys, a column for each name): the least value that so many of a group's values do not exceed, exactly. Nulls do not count.

    quantiles: {name: the quantile as a decimal text}, so that ranks are whole numbers. Rows are counted by value before
    they are shuffled; a group's distinct values, and not its rows, meet in one task.
    """
    counts = df.groupBy(*keys, value).agg(F.count(value).alias("_n"))
    w = Window.partitionBy(*keys)
    upto = counts.withColumn("_upto", F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(w))
    ratio = {name: Decimal(q).as_integer_ratio() for name, q in quantiles.items()}
    return upto.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") * den >= F.col("_all") * num, F.col(value))).alias(name) for name, (num, den) in ratio.items()])


def keep_first(value: str, order: Column | str) -> Column:
    """KEEP (DENSE_RANK FIRST ORDER BY order) of a value; of ties the least counts with min_by over a struct."""
    return F.min(F.struct(order, value))[value if isinstance(value, str) else "col2"]


def keep_last(value: str, order: Column | str) -> Column:
    return F.max(F.struct(order, value))[value]


def summarize(df: DataFrame) -> DataFrame:
    """One row a column: its name, type, least and greatest value as text, distinct values, nulls and rows. One pass."""
    aggs = []
    for k, c in enumerate(df.columns):
        q = F.col(f"`{c}`")
        aggs += [F.min(q).cast("string").alias(f"a{k}"), F.max(q).cast("string").alias(f"b{k}"), F.count_distinct(q).alias(f"d{k}"), F.count(q).alias(f"n{k}")]
    one = df.agg(F.count("*").alias("rows"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("column_type"), F.col(f"a{k}").alias("min"), F.col(f"b{k}").alias("max"), F.col(f"d{k}").alias("n_distinct"), (F.col("rows") - F.col(f"n{k}")).alias("n_null"), F.col("rows").alias("n_rows")) for k, (c, t) in enumerate(df.dtypes)])
    return one.select(F.inline(rows))
