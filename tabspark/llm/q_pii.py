"""op4: personal data in the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .pii import personal_data


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


QUERIES = {"op4_pii": op4_pii}
ORACLE: dict[str, str] = {}
