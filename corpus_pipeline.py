"""Raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
The stages are exact functions of their input, but SQL can express neither the vocabularies nor the packing, so there
is no ORACLE_SQL; tests hold every stage against a plain restatement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel import storage
from tidewheel.llm import decontaminate, near_dups, packing, quality, secrets_scan

ORACLE_SQL = None


def _recount(before: DataFrame, after: DataFrame) -> DataFrame:
    """``n_chars`` follows the text where a stage may have changed it; null texts keep what they have."""
    if "n_chars" not in before.columns:
        return after
    counted = F.coalesce(F.char_length("text").cast(before.schema["n_chars"].dataType), "n_chars")
    return after.withColumn("n_chars", counted).select(*before.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the text statistics and the fertility bands."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the least doc_id."""
    return near_dups.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words of benchmark windows; those that are mostly benchmark go as a whole."""
    return _recount(docs, decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a mark."""
    return _recount(docs, secrets_scan.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset."""
    return packing.pack(docs, keep_words=False)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
