"""Functions of tables: one that reads a table row by row, and rules over cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def table_function(df: DataFrame, partition: list[str], order: list[str], columns: list[str], f: Callable[[tuple, Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """TABLE(f(TABLE df PARTITION BY partition ORDER BY order)): the partition's keys beside each row that f yields.

    f gets a key and an iterator of its rows' columns in order; rows stream through it, so that a partition of any size
    needs no memory of its own. What f leaves unread is passed over. Partitions of null keys are partitions as well.
    """
    keys = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in partition)
    kind = _parse_datatype_string(f"{keys}, {schema}" if partition else schema)
    arrow = to_arrow_schema(kind)
    n = len(partition)
    sent = [*partition, *[c for c in columns if c not in partition]]
    at = [sent.index(c) for c in columns]
    dealt = (df.repartition(*partition) if partition else df.coalesce(1)).sortWithinPartitions(*partition, *order).select(*sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every():
            for batch in batches:
                for k in range(0, batch.num_rows, 1024):
                    yield from zip(*[c.to_pylist() for c in batch.slice(k, 1024).columns])

        rows = every()
        held = next(rows, None)
        out: list[tuple] = []
        while held is not None:
            key = held[:n]

            def own():
                nonlocal held
                while held is not None and held[:n] == key:
                    now, held = held, next(rows, None)
                    yield tuple(now[j] for j in at)

            mine = own()
            for made in f(key, mine):
                out.append((*key, *made))
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(v, x.type) for v, x in zip(zip(*out), arrow)], schema=arrow)
                    out = []
            for _ in mine:
                pass
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, x.type) for v, x in zip(zip(*out), arrow)], schema=arrow)

    return dealt.mapInArrow(run, kind)


def model(cells: DataFrame, partition: list[str], dimension: str, measure: str, rules: list[tuple[object, Callable[[Callable[[object], Column]], Column]]], updated_only: bool = False) -> DataFrame:
    """MODEL PARTITION BY partition DIMENSION BY dimension MEASURES measure RULES: (partition, dimension, measure).

    A rule is a cell and an expression over c(cell), the measure of a cell of the partition (null if there is none); rules
    apply in order and see what those before them set. Cells are unique; a partition's cells are one map, so a dimension
    is for years or classes and not for rows without number.
    """
    kind = dict(cells.dtypes)
    own = cells.where(F.col(dimension).isNotNull()).groupBy(*partition).agg(F.map_from_entries(F.collect_list(F.struct(dimension, measure))).alias("_c"))
    key = lambda x: F.lit(x).cast(kind[dimension])
    made = []
    for at, rule in rules:
        value = rule(lambda x: F.try_element_at("_c", key(x))).cast(kind[measure])
        own = own.withColumn("_c", F.map_concat(F.map_filter("_c", lambda k, _: k != key(at)), F.create_map(key(at), value)))
        made.append(at)
    out = own.select(*partition, F.explode("_c").alias(dimension, measure))
    return out.where(F.col(dimension).isin(made)) if updated_only else out
