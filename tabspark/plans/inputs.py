"""Standard inputs over the driver tables, built identically in Spark and SQL.

The relational test tables have no NULLs and no duplicate rows, so the
queries inject them the same way on both sides (``nullif`` on a value and
low-cardinality projections).  Every Spark input below has its SQL twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import data_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(data_path(sf_dir, name))


# Lineitem with NULL quantities wherever the quantity is 1.
LINEITEM_NULLED_SQL = (
    "(SELECT l_orderkey, l_linenumber, NULLIF(l_quantity, 1.0) AS l_quantity, l_extendedprice, "
    "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem)"
)


def lineitem_nulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        F.nullif(F.col("l_quantity"), F.lit(1.0)).alias("l_quantity"),
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
        "l_shipdate",
    )


# A low-cardinality projection: many duplicate rows and some NULLs.
LINEITEM_FLAGS_SQL = (
    "(SELECT l_returnflag, l_linestatus, NULLIF(l_quantity, 1.0) AS l_quantity, l_discount FROM lineitem)"
)


def lineitem_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_returnflag",
        "l_linestatus",
        F.nullif(F.col("l_quantity"), F.lit(1.0)).alias("l_quantity"),
        "l_discount",
    )


# Events with NULL event types wherever the type is 'error'.
EVENTS_NULLED_SQL = (
    "(SELECT event_id, ts, user_id, NULLIF(event_type, 'error') AS event_type, value FROM events)"
)


def events_nulled(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id",
        "ts",
        "user_id",
        F.nullif(F.col("event_type"), F.lit("error")).alias("event_type"),
        "value",
    )
