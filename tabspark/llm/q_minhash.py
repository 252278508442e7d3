"""op13: MinHash near-duplicates of the whole documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .minhash import near_duplicates


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op13_minhash": op13_minhash}
ORACLE: dict[str, str] = {}
