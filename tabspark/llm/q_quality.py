"""op2: quality scores of the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, saved, table
from .quality import THRESHOLD, fit, score, with_statistics

FOLDS, HELD_OUT = 5, 0  # fixed by the contract


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = saved(with_statistics(table(spark, sf_dir, "documents")), "quality-statistics")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    labels = labels.filter(crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT)
    model = fit(stats.join(labels, "doc_id"))
    return score(stats, model).select(
        "doc_id",
        F.coalesce(crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op2_quality": op2_quality}
ORACLE: dict[str, str] = {}
