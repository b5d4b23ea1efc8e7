"""Corpus pipeline: toxicity, near-duplicates, decontamination, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.llm import decontam, omh, packing, pii, toxicity
from airgrid.llm.common import bound_batches, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score >= 0.7) go; it learns from all labels."""
    base = docs.select(*COLUMNS)
    model = toxicity.train(base, table(spark, sf_dir, "labels"), lambda i: i.isNotNull())
    scored = toxicity.score(base, model, out="toxicity_score")
    return scored.where(F.col("toxicity_score") < 0.7).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays, once."""
    bound_batches(spark)
    return omh.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one word in twenty or more lies in a benchmark window go."""
    found = decontam.scan(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(~decontam.is_contaminated()).select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind; n_chars follows the new text."""
    bound_batches(spark)
    base = docs.select(*COLUMNS)
    clean = base.withColumn("text", pii.scrub(base, pii.train(base)))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("long")).select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and slot of every remaining document."""
    bound_batches(spark)
    return packing.pack_texts(docs.select(*COLUMNS))


STAGES = [("toxicity", drop_toxic), ("near-duplicates", drop_near_copies), ("decontamination", drop_contaminated),
          ("personal-data", mask_personal_data), ("packing", pack_documents)]
ORACLE_SQL = None          # trained models are not expressible in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored before the next stage reads it."""
    docs = table(bound_batches(spark), sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
