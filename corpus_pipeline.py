"""Documents to a training mix: quality, near-duplicates, benchmark passages, personal data, source weights.

Every stage takes and returns the columns of ``documents``; the last adds each document's share of the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import decontaminate, mixing, near, pii, quality
from concord.llm.common import durable, modest_batches, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars as long as the text is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns from ``docs`` and ``labels``."""
    found = quality.quality_scores(docs, _table(spark, sf_dir, "labels"), keep=True)
    return found.where("predicted = 1").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of least id. The ids that go are broadcast up to a bound."""
    gone = durable(near.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct())
    ids = F.broadcast(gone) if gone.count() <= near.BROADCAST_IDS else gone
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that benchmark windows cover."""
    return _measured(decontaminate.cleaned(docs, _table(spark, sf_dir, "benchmark")))


def surrogate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data. The key is a fixed one so that runs can be compared."""
    return _measured(pii.surrogates(docs, b"example key", keep=True))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with how many."""
    return mixing.mix(docs, keep=True).where("taken > 0")


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", surrogate_stage),
    ("source mixing", mixing_stage),
]
#: Hashing sketches, a fitted classifier and keyed surrogates have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
