"""Corpus pipeline over ``documents``: classify, deduplicate, redact, mix, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs``.  Between stages the rows are written as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetflow.llm import mixing_poisson, packing_drr, pii_boosted, quality_nbsvm, simhash
from assetflow.llm.catalog import TOKENIZER
from assetflow.llm.common import materialise, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality_nbsvm.fit(docs, read(spark, sf_dir, "labels"))
    return (quality_nbsvm.score(docs, model, out="__quality").filter(F.col("__quality") >= quality_nbsvm.THRESHOLD)
            .drop("__quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: that of the smallest id."""
    return simhash.one_of_each(docs, shingle=3, radius=3)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts become their kind in brackets."""
    return pii_boosted.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are replicated to their target weights and dealt out anew; copies keep their document's id."""
    return mixing_poisson.replicate(docs, max_rate=None).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing_drr.pack(docs, TOKENIZER)


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

# SQL can express neither the classifier nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
