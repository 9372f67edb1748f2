"""The corpus pipeline: from raw documents to packed training sequences, each stage one of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the next one's docs. All but the
last return the columns of documents. Filters are anti joins on the ids that go, so that rows without an id stay."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, ngram_join, packing, quality_classifier, secrets
from lodestone.llm._base import Scratch, table


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as 0 go."""
    return _without(docs, quality_classifier.classify(docs, table(spark, sf_dir, "labels")).where("predicted = 0"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of least doc_id stays, and one row of rows that repeat a doc_id."""
    kept = _without(docs, ngram_join.jaccard_components(docs, links=False).where("doc_id <> component_id"))
    again = Window.partitionBy(F.coalesce(F.col("doc_id"), F.xxhash64(*docs.columns)), F.col("doc_id").isNull()).orderBy(F.xxhash64(*docs.columns))
    return kept.withColumn("_again", F.row_number().over(again)).where("_again = 1").select(docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are redacted."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: Model scores, near-duplicate components and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        if last is not None:
            scratch.drop(last)
        last = f"stage{k}"
    return docs
