"""Cleaning pipeline over ``documents``: toxicity, near-duplicates, benchmark leaks, personal data, packing.

Every stage is (spark, docs, sf_dir) -> DataFrame.  All but the last return the columns of documents;
``run`` writes each result as Parquet in the shared folder and reads it back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.llm.common import saved, table
from tabspark.llm.decontaminate import without_contaminated
from tabspark.llm.packing import pack
from tabspark.llm.pii import redact
from tabspark.llm.q_toxicity import toxicity_model
from tabspark.llm.simhash import deduplicate
from tabspark.llm.toxicity import THRESHOLD, score_column


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    model = toxicity_model(spark, docs, sf_dir)
    return docs.filter(score_column(model, F.col("text")) < THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows the new text."""
    clean = redact(docs)
    if "n_chars" not in clean.columns:
        return clean
    kind = clean.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of sequences of 1024 tokens."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # the classifier, SimHash and the tokenizer have no SQL; see tests/llm/test_pipeline.py


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
