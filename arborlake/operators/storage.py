"""Cutting lineage in iterative operators, so that a lost executor costs one round at most."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in spark.checkpoint.dir; a local run without one gets its own folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        there = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not there and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(there or f"file:/tmp/checkpoints/{uuid.uuid4().hex}")
    return df.checkpoint(eager=True)


def scratch(df: DataFrame, name: str) -> str:
    """A path of its own in the shared folder, for tables that a query writes and reads again."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        cut(df.limit(0))
    base = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().get()
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, computed once, as a table of columns in the shared folder: for wide rows of which each reader takes a few columns."""
    there = scratch(df, name)
    df.write.parquet(there)
    return df.sparkSession.read.parquet(there)


#: Bytes of a table that is broadcast at most.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """df to be broadcast if its rows take so many bytes at most, as they are written; else to be joined by a shuffle."""
    df = cut(df)
    size = F.lit(0)
    for c, kind in df.dtypes:
        fixed = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8}.get(kind)
        own = F.lit(fixed) if fixed else F.octet_length(F.col(f"`{c}`")) if kind in ("string", "binary") else F.octet_length(F.to_json(F.struct(F.col(f"`{c}`"))))
        size = size + 8 + F.coalesce(own, F.lit(0))
    taken = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if taken <= most else df
