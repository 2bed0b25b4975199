"""Sources: files as tables, text in any encoding, literal rows and table functions."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {"parquet": "parquet", "pq": "parquet", "orc": "orc", "csv": "csv", "tsv": "csv", "json": "json", "ndjson": "json", "jsonl": "json", "txt": "text", "avro": "avro", "xml": "xml"}


def file_table(spark: SparkSession, path: str, schema: str | None = None, **options: str) -> DataFrame:
    """FROM 'data.parquet': the format from the name, compression suffixes aside."""
    m = re.search(r"\.(\w+?)(?:\.(?:gz|bz2|zst|snappy|lz4))?/?$", path.rstrip("*"))
    kind = FORMATS.get((m[1] if m else "parquet").lower())
    if kind is None:
        raise ValueError(f"no format for {path}")
    r = spark.read.format(kind).options(**({"header": "true"} if kind == "csv" else {}) | ({"sep": "\t"} if path.endswith(".tsv") else {}) | options)
    return (r.schema(schema) if schema else r).load(path)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): whole files as bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def decode_text(content: Column, encoding: str = "UTF-8") -> Column:
    """Bytes as text: invalid UTF-8 becomes the replacement character, a byte-order mark is no text. UTF-8, UTF-16LE, UTF-16BE."""
    text = F.make_valid_utf8(content.cast("string")) if encoding.upper() == "UTF-8" else F.decode(content, encoding)
    return F.regexp_replace(text, "^\ufeff", "")


def decode_custom(decoder: Callable[[bytes], str]) -> Callable[[Column], Column]:
    """A caller's decoder as a column function, over Arrow batches."""

    @F.pandas_udf("string")
    def run(content: pd.Series) -> pd.Series:
        return content.map(decoder, na_action="ignore")

    return run


def partition(df: DataFrame, column: str, value) -> DataFrame:
    """PARTITION (column = value): a filter that prunes a partitioned source."""
    return df.where(F.col(column) == value)


def export_database(tables: dict[str, DataFrame], directory: str, kind: str = "parquet") -> None:
    """EXPORT DATABASE: each table in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(kind).save(f"{directory}/{name}")


def import_database(spark: SparkSession, names: list[str], directory: str, kind: str = "parquet") -> dict[str, DataFrame]:
    return {n: spark.read.format(kind).load(f"{directory}/{n}") for n in names}


def json_rows(df: DataFrame, column: str, schema: str, keep: list[str] = ()) -> DataFrame:
    """JSON_TABLE / OPENJSON: a JSON column as columns; an array as a row for each element."""
    parsed = F.from_json(column, schema)
    if schema.strip().lower().startswith("array"):
        return df.select(*keep, F.inline(parsed))
    return df.select(*keep, parsed.alias("_j")).select(*keep, "_j.*")


def xml_rows(df: DataFrame, column: str, schema: str, keep: list[str] = ()) -> DataFrame:
    """XMLTABLE: an XML column as columns."""
    return df.select(*keep, F.from_xml(column, schema).alias("_x")).select(*keep, "_x.*")


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """FOR JSON: each row as one JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def as_xml(df: DataFrame, row: str = "row", name: str = "xml") -> DataFrame:
    """FOR XML: each row as one element."""
    return df.select(F.to_xml(F.struct(*df.columns), {"rowTag": row}).alias(name))


def split_rows(df: DataFrame, column: str, by: str, keep: list[str]) -> DataFrame:
    """STRING_SPLIT: a row for each part of a text between separators, with its ordinal from 1."""
    import re

    return df.select(*keep, F.posexplode(F.split(column, re.escape(by), -1)).alias("_o", "value")).select(*keep, (F.col("_o") + 1).alias("ordinal"), "value")


def series_rows(df: DataFrame, start: str, end: str, step: int, keep: list[str]) -> DataFrame:
    """GENERATE_SERIES: a row for each step from start to end; none if it can't be reached."""
    a, b = F.col(start).cast("bigint"), F.col(end).cast("bigint")
    can = b >= a if step > 0 else b <= a
    return df.where(can).select(*keep, F.explode(F.sequence(a, b, F.lit(step).cast("bigint"))).alias("value"))


def stage_files(spark: SparkSession, base: str, pattern: str = "*") -> DataFrame:
    """LIST @stage: (name, size, modified) of the files below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(base)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def stage_table(spark: SparkSession, base: str, pattern: str = "*", form: str = "parquet", **options) -> DataFrame:
    """SELECT .. FROM @stage: the rows of a folder's files that fit a pattern."""
    return spark.read.options(**options).option("pathGlobFilter", pattern).format(form).load(base)
