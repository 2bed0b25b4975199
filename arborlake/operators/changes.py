"""Data changes as DataFrames: what INSERT, UPDATE, DELETE, MERGE and their kin leave, and the rows that they changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_by_name(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns match by name; those that rows lack are null."""
    return target.unionByName(rows, allowMissingColumns=True).select(*target.columns)


def update(target: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return target.select(*[F.when(hit, values[c]).otherwise(F.col(c)).cast(t).alias(c) if c in values else F.col(c) for c, t in target.dtypes])


def update_from(target: DataFrame, source: DataFrame, on: list[str], values: dict[str, Column]) -> DataFrame:
    """UPDATE .. FROM: source has one row a key at most; its columns are named `s_<column>` in values."""
    s = source.select(*on, F.lit(True).alias("_hit"), *[F.col(c).alias(f"s_{c}") for c in source.columns if c not in on])
    j = target.join(s, on, "left")
    return j.select(*[F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).cast(t).alias(c) if c in values else F.col(c) for c, t in target.dtypes])


def delete(target: DataFrame, where: Column) -> DataFrame:
    return target.where(~F.coalesce(where, F.lit(False)))


def delete_using(target: DataFrame, source: DataFrame, on: list[str]) -> DataFrame:
    return target.join(source, on, "left_anti")


def upsert(target: DataFrame, rows: DataFrame, key: list[str], update_cols: list[str] | None = None, ignore: bool = False) -> DataFrame:
    """INSERT .. ON CONFLICT (key) DO UPDATE SET update_cols (all, if none are named), or DO NOTHING."""
    new = rows.join(target, key, "left_anti").select(*target.columns)
    if ignore:
        return target.unionAll(new)
    cols = update_cols or [c for c in target.columns if c not in key]
    old = update_from(target, rows.select(*key, *cols), key, {c: F.col(f"s_{c}") for c in cols})
    return old.unionAll(new)


def merge(target: DataFrame, source: DataFrame, key: list[str], matched_delete: Column | None = None, matched_update: dict[str, Column] | None = None, insert: dict[str, Column] | None = None, by_source_delete: Column | None = None) -> DataFrame:
    """MERGE as one full join: the new rows of target with `action`: kept, updated, inserted or deleted.

    Conditions and values use t_<column> and s_<column>. Deleted rows stay in the result, so that RETURNING and OUTPUT
    can be read from it; merged() leaves them out.
    """
    t = target.select(*key, F.lit(True).alias("_t"), *[F.col(c).alias(f"t_{c}") for c in target.columns if c not in key])
    s = source.select(*key, F.lit(True).alias("_s"), *[F.col(c).alias(f"s_{c}") for c in source.columns if c not in key])
    j = t.join(s, key, "full")
    yes = lambda c: F.coalesce(c, F.lit(False)) if c is not None else F.lit(False)
    both, only_t, only_s = F.col("_t") & F.col("_s"), F.col("_s").isNull(), F.col("_t").isNull()
    action = F.when(both & yes(matched_delete), "deleted").when(both & F.lit(bool(matched_update)), "updated").when(only_s, F.lit("inserted" if insert is not None else "none")).when(only_t & yes(by_source_delete), "deleted").otherwise("kept")
    j = j.withColumn("action", action).where("action <> 'none'")
    cols = []
    for c, kind in target.dtypes:
        if c in key:
            cols.append(F.col(c))
            continue
        v = F.col(f"t_{c}")
        if matched_update and c in matched_update:
            v = F.when(F.col("action") == "updated", matched_update[c]).otherwise(v)
        if insert is not None:
            v = F.when(F.col("action") == "inserted", insert.get(c, F.lit(None))).otherwise(v)
        cols.append(v.cast(kind).alias(c))
    return j.select(*cols, "action")


def merged(result: DataFrame) -> DataFrame:
    return result.where("action <> 'deleted'").drop("action")


def multi_insert(source: DataFrame, branches: list[tuple[str, Column]], first: bool = False) -> DataFrame:
    """INSERT ALL / FIRST: source's rows with `target`, once for each branch (for the first, if `first`) whose condition holds.

    One pass; write it partitioned by target, or filter by it.
    """
    names = [F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in branches]
    if first:
        return source.withColumn("target", F.coalesce(*names)).where("target is not null")
    return source.withColumn("target", F.explode(F.filter(F.array(*names), lambda x: x.isNotNull())))


def last_write(rows: DataFrame, key: list[str], values: list[str], written: str, expires: str | None = None, now: Column | None = None) -> DataFrame:
    """Last write wins, column by column: of each column the value of the latest write that set it. Expired writes don't count."""
    if expires is not None:
        rows = rows.where(F.col(expires).isNull() | (F.col(expires) > now))
    return rows.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(written))).alias(c) for c in values])


def final(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """FINAL: of each key the row of the greatest version."""
    w = Window.partitionBy(*key).orderBy(F.col(version).desc())
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
