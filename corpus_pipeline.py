"""A training-data pipeline over ``documents``.

The stages run in order, each over all that the one before kept: toxic documents go, lines of recurring templates go,
one document of each near-duplicate group stays, personal data is sanitised, and what is left is packed into sequences.
Every stage but the last returns the columns of ``documents``; where a stage changes texts, ``n_chars`` follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, packing, pii, queries, simhash_golay, toxicity
from tessera.tables import Workspace, temporary_tables


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(line_dedup.drop_recurring(docs, min_share=line_dedup.SHARE))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_golay.keep_dissimilar(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(pii.sanitise(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, queries.tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]
#: No SQL can express a trained classifier, a tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, and what a
    stage kept there for itself goes with it."""
    work, docs = Workspace(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        with temporary_tables():
            docs = work.save(stage(spark, docs, sf_dir), name)
        if i:
            work.drop(STAGES[i - 1][0])
    return docs
