"""The corpus pipeline: five stages, each on all that the one before it kept.

Quality rules drop documents, line dedup takes recurring lines out of texts,
near-dedup keeps one document of each group of Jaccard 0.8 over five-word shingles, decontamination drops documents
with benchmark passages, and mixing takes documents towards target weights
(its rows say how many words of each document the mix takes, and from which
slot on).  All but the last return the columns of ``documents``.

Every stage takes null and empty texts, null ids, languages and sources,
repeated rows, empty tables and columns of its own names as the docstrings of
its operator say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import decontaminate, line_templates, mixture, quality_rules, shingle_dup
from corpusloom.llm.common import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_templates.drop_lines(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingle_dup.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.mixed_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
]

#: The language model, the shingle hashes and the hash order of the mix have no SQL twin.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the result of every earlier stage is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
