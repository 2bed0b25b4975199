"""Helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: A-Z to a-z and nothing else.
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_TABLE = str.maketrans(ASCII_UPPER, ASCII_LOWER)


#: Rows of one Arrow batch at most. Spark's own 10,000 whole texts are tens of MB, held by the JVM and the worker both.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """df, to be handed to Python workers in batches of BATCH_ROWS rows; the session keeps that setting."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: str) -> str:
    """A-Z lower-cased, all else untouched."""
    return text.lower() if text.isascii() else text.translate(LOWER_TABLE)


def ascii_lower_col(c):
    """The same as a column; texts of one byte a character take the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, ASCII_UPPER, ASCII_LOWER))


#: What this process keeps from task to task: one thing at most, by its key.
_KEPT: dict = {}


def kept(key, make: Callable):
    """make(), or what it returned to an earlier task of this process; it stays until let_go() or another key."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def let_go() -> None:
    """Drops what kept() keeps, as a task begins that has no use for it: workers live on, and operators would add up in them."""
    if _KEPT:
        _KEPT.clear()
        give_back()


def map_slices(df: DataFrame, columns: list, make: Callable, schema: str, rows: int = 128, keeps: bool = False) -> DataFrame:
    """One output row or more for the rows of a slice, by Arrow and without a shuffle.

    make() runs once a task and returns f, which gets one list per column for up to `rows` rows and
    returns one list per output column. Only the named columns leave the JVM, so others may have any name. If f has a
    `close`, it is called as the task ends, so that workers, which live on, keep nothing of it. keeps: make() uses kept().
    """
    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            let_go()
        f = make()
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    out = f(*[c.to_pylist() for c in batch.slice(at, rows).columns])
                    yield pa.RecordBatch.from_arrays([pa.array(v, x.type) for v, x in zip(out, arrow, strict=True)], schema=arrow)
        finally:
            getattr(f, "close", lambda: None)()
            del f
            trim()

    return small_batches(df).select(*columns).mapInArrow(run, kind)


def give_back() -> None:
    """Returns memory that this process has freed to the system, where its library can."""
    gc.collect()
    trim()


def trim() -> None:
    """The same without a search for garbage: what a task does as it ends."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def give_back_heaps(spark: SparkSession) -> None:
    """The JVMs that run tasks collect their garbage and return what is free: a heap that one stage has filled stays full otherwise.

    A task for each core reaches every executor that is idle; one that is not reached keeps its heap, and no result depends on it.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").collect()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set here where it is unset (local runs)."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
    if jvm.isDefined():
        return jvm.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    here = f"file:/tmp/checkpoints/{uuid.uuid4().hex}"
    spark.sparkContext.setCheckpointDir(here)
    return here


#: Files of a lineage cut for each core at most: a file each for very many small partitions costs more than its rows.
FILES_A_CORE = 4


def cut(df: DataFrame, as_dealt: bool = False) -> DataFrame:
    """The rows, computed once and kept in the shared folder, so that a lost executor costs nothing that came before.

    Partitions beyond FILES_A_CORE for each core are put together; as_dealt keeps them all, for what is costly to compute.
    """
    spark = df.sparkSession
    there = shared_dir(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(there)
    return (df if as_dealt else df.coalesce(FILES_A_CORE * spark.sparkContext.defaultParallelism)).checkpoint(eager=True)


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many lines before it as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def by_sorting(df: DataFrame) -> DataFrame:
    """df, for a join that sorts both sides. Left to itself Spark broadcasts what it takes for small, by the compressed size of a shuffle or
    by that of texts from which rows were made, and the driver holds all such tables of a plan at once."""
    return df.hint("merge")


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """df, computed once, to be broadcast if it has so many rows at most; beyond them joins shuffle. For narrow rows only."""
    df = cut(df)
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
