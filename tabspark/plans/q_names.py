"""Queries over columns whose names need quoting: dots, spaces, percent signs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explore as X
from ..operators import hypothesis as H
from ..operators import modeling as M
from ..operators import prepare as P
from ..operators import profile as PR
from ..schema import DatasetSchema, col_of
from ..session import work_dir
from ..sources.versions import Catalog
from .inputs import table
from .registry import register

RENAMED = {"l_tax": "l.tax", "l_quantity": "qty %", "l_returnflag": "return flag.x", "l_linestatus": "status`s"}


def _li(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", *RENAMED)
    return df.withColumnsRenamed(RENAMED)


@register("names_filter", "SELECT l_orderkey, l_tax AS tax FROM lineitem WHERE l_tax > 0.05")
def names_filter(spark, d):
    out = P.run(_li(spark, d), [P.Filter("col_l.tax", "gt", 0.05), P.Rename("col_l.tax", "tax")])
    return out.select("l_orderkey", "tax")


@register(
    "names_profile",
    "SELECT 'l.tax' AS name, COUNT(DISTINCT l_tax) AS distinct_count, CAST(0 AS BIGINT) AS null_count FROM lineitem "
    "UNION ALL SELECT 'qty %', COUNT(DISTINCT l_quantity), 0 FROM lineitem",
)
def names_profile(spark, d):
    out = PR.column_profiles(_li(spark, d).select(col_of("l.tax"), col_of("qty %")), exact_distinct=True)
    return out.select("name", "distinct_count", "null_count")


@register(
    "names_describe",
    "SELECT COUNT(*) AS valid_count, MIN(l_tax) AS minimum, ROUND(QUANTILE_CONT(l_tax, 0.25), 6) AS q1, ROUND(MEDIAN(l_tax), 6) AS median FROM lineitem",
)
def names_describe(spark, d):
    out = X.describe(_li(spark, d), "l.tax")
    return out.select("valid_count", "minimum", F.round("q1", 6).alias("q1"), F.round("median", 6).alias("median"))


@register(
    "names_box",
    "SELECT l_returnflag AS category, ROUND(MEDIAN(l_quantity), 6) AS median, COUNT(*) AS n FROM lineitem GROUP BY 1",
)
def names_box(spark, d):
    out = X.box(_li(spark, d), "qty %", group="return flag.x")
    return out.select("category", F.round("median", 6).alias("median"), "n")


@register("names_correlation", "SELECT ROUND(CORR(l_tax, l_quantity), 9) AS r FROM lineitem")
def names_correlation(spark, d):
    out = X.correlation(_li(spark, d), ["l.tax", "qty %"])
    return out.where("i = 0 AND j = 1").select(F.round("r", 9).alias("r"))


@register(
    "names_chi_square",
    "WITH o AS (SELECT l_returnflag AS a, l_linestatus AS b, COUNT(*) AS c FROM lineitem GROUP BY 1, 2), "
    "n AS (SELECT SUM(c) AS n FROM o), ra AS (SELECT a, SUM(c) AS ca FROM o GROUP BY 1), rb AS (SELECT b, SUM(c) AS cb FROM o GROUP BY 1), "
    "cells AS (SELECT COALESCE(c, 0) AS c, ca * cb / CAST(n AS DOUBLE) AS e FROM ra CROSS JOIN rb CROSS JOIN n LEFT JOIN o ON o.a = ra.a AND o.b = rb.b) "
    "SELECT ROUND(SUM((c - e) * (c - e) / e), 4) AS statistic FROM cells",
)
def names_chi_square(spark, d):
    out = H.chi_square(_li(spark, d), "return flag.x", "status`s")
    return out.select(F.round("statistic", 4).alias("statistic"))


@register(
    "names_recommend",
    "SELECT 'welch_t' AS test_id, 'qty % is numeric and status`s has two observed groups.' AS rationale FROM lineitem LIMIT 1",
)
def names_recommend(spark, d):
    out = H.recommend(_li(spark, d), "compare_groups", outcome="qty %", group="status`s")
    return out.where("preferred").select("test_id", "rationale")


@register("names_model", "SELECT COUNT(*) - CAST(CEIL(0.2::DOUBLE * COUNT(*)) AS BIGINT) AS train_rows, 2 AS candidates FROM lineitem")
def names_model(spark, d):
    cfg = M.ModelConfig("regression", "qty %", ("l.tax", "return flag.x"), algorithms=("linear",), row_key=("l_orderkey", "l_linenumber"))
    evaluation, frame, _ = M.train(_li(spark, d), cfg)
    return frame.agg(F.lit(evaluation["train_rows"]).cast("bigint").alias("train_rows"), F.count(F.lit(1)).cast("int").alias("candidates"))


@register("names_ingest", "SELECT l_orderkey, l_tax AS tax, l_returnflag AS flag FROM lineitem WHERE l_tax > 0.05")
def names_ingest(spark, d):
    source = work_dir(spark, "names") + "/source.parquet"
    _li(spark, d).write.parquet(source)
    cat = Catalog(spark, work_dir(spark, "catalog"))
    vid = cat.ingest(source, "renamed")
    _, schema = cat.read(vid)
    child = cat.apply(vid, P.Filter(schema.resolve("l.tax").column_id, "gt", 0.05))
    df, schema = cat.read(child)
    assert DatasetSchema.of(df).names == schema.names
    return df.select("l_orderkey", col_of("l.tax").alias("tax"), col_of("return flag.x").alias("flag"))
