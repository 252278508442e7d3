"""op3: token counts of the whole documents table, kept by batches of signed deltas.

Batches: all documents inserted under two tokenizer versions; the same batch again (no effect); the
second version's counts revised for every document; exact copies (all but the smallest doc_id of a
text) deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir
from .common import saved, table
from .rollup import TokenRollup, counted, default_versions


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rollup = TokenRollup(spark, work_dir(spark, "token-rollup"))
    counts = saved(counted(docs, default_versions()), "token-counts").withColumn("op", F.lit("insert"))
    rollup.commit("load", counts)
    rollup.commit("load", counts)
    revised = counted(docs, {"space_v1": "words"}).withColumn("op", F.lit("revise"))
    rollup.commit("recount space_v1 as words", revised)
    hashed = docs.select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    first = hashed.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = hashed.join(first, "h").filter("doc_id > first_id")
    names = F.explode(F.array(*map(F.lit, default_versions()))).alias("tokenizer")
    gone = copies.select(F.lit("delete").alias("op"), "doc_id", "source", "lang", names, F.lit(0).cast("long").alias("n_tokens"))
    rollup.commit("delete exact copies", gone)
    return rollup.totals()


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLE: dict[str, str] = {}
