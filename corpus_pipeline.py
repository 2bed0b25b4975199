"""From raw documents to token ids, in five stages; each takes what the one before kept.

Every stage but the last returns the columns of documents, whatever others there are and whatever their names; very long
texts are read whole, and an empty table gives an empty one. SQL can express none of this: a trained classifier, a
similarity and a tokenizer are among the stages. tests/llm/test_pipeline.py holds each against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arborlake.llm import bpe, decontaminate, secrets, simhash, toxicity
from arborlake.llm.common import give_back_heaps, read, shared_dir


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of docs, does not call toxic.

    Null and empty texts have no words and are scored as such. Repeated rows stay or go together. Without labels of
    both kinds nothing goes.
    """
    give_back_heaps(spark)
    return toxicity.reject(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies, that of the smallest id.

    Null texts count as empty ones. Null ids come last. Rows that share an id but no text are different documents; of
    rows that share both one stays.
    """
    give_back_heaps(spark)
    return simhash.remove_copies(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is in benchmark passages. Null and empty texts stay."""
    give_back_heaps(spark)
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in the text masked and n_chars set to what is left. Null texts stay null, repeated rows repeated."""
    give_back_heaps(spark)
    return secrets.redact(docs, secrets.train())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and the digests by which to compare them. Null texts have no ids."""
    give_back_heaps(spark)
    return bpe.encode_with_digests(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_dedup", remove_near_copies),
    ("decontamination", remove_contaminated),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; the last stage's rows."""
    docs = read(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{spark.sparkContext.applicationId}-{spark.sql('SELECT uuid()').first()[0]}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.parquet(f"{base}/{k}-{name}")
    return docs
