"""op8: toxicity scores of the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, saved, table
from .toxicity import THRESHOLD, Model, fit, labelled_sample, score_column

FOLDS, HELD_OUT = 4, 2  # fixed by the contract


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """A model of the labelled rows of ``docs`` outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    labels = labels.filter(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)
    return fit(saved(labelled_sample(docs, labels), "toxicity-labelled"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(spark, docs, sf_dir)
    scored = docs.select("doc_id", score_column(model, F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE: dict[str, str] = {}
