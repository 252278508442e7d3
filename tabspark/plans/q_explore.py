"""Exploration queries (E4-E15) with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explore as X
from .inputs import EVENTS_NULLED_SQL, LINEITEM_NULLED_SQL, events_nulled, lineitem_nulled, table
from .registry import register

R6 = 6


def _r(c):
    return F.round(F.col(c), R6).alias(c)


# -- describe ------------------------------------------------------------------
_DESCRIBE_COLS = (
    "column_id, column_name, data_type, row_count, valid_count, missing_count, distinct_count, "
    "minimum, maximum, mean, stddev, q1, median, q3, mode, mode_count"
)


def _describe_sql(src: str, col: str, kind: str, numeric: bool, ordered: bool, vtype: str) -> str:
    stats = (
        f"ROUND(AVG({col}), 6) AS mean, ROUND(STDDEV_SAMP({col}), 6) AS stddev, "
        f"ROUND(QUANTILE_CONT({col}, 0.25), 6) AS q1, ROUND(QUANTILE_CONT({col}, 0.5), 6) AS median, "
        f"ROUND(QUANTILE_CONT({col}, 0.75), 6) AS q3"
        if numeric
        else "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS stddev, CAST(NULL AS DOUBLE) AS q1, "
        "CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS q3"
    )
    bounds = (
        f"MIN({col}) AS minimum, MAX({col}) AS maximum"
        if ordered
        else f"CAST(NULL AS {vtype}) AS minimum, CAST(NULL AS {vtype}) AS maximum"
    )
    return (
        f"WITH t AS (SELECT * FROM {src} s), "
        f"vc AS (SELECT {col} AS v, COUNT(*) AS n FROM t WHERE {col} IS NOT NULL GROUP BY 1), "
        "m AS (SELECT v, n FROM vc ORDER BY n DESC, v LIMIT 1) "
        f"SELECT 'col_{col}' AS column_id, '{col}' AS column_name, '{kind}' AS data_type, "
        f"COUNT(*) AS row_count, COUNT({col}) AS valid_count, COUNT(*) - COUNT({col}) AS missing_count, "
        f"(SELECT COUNT(*) FROM vc) AS distinct_count, {bounds}, {stats}, "
        "(SELECT v FROM m) AS mode, COALESCE((SELECT n FROM m), 0) AS mode_count FROM t"
    )


def _describe_round(df):
    return df.select(
        *[_r(c) if c in ("mean", "stddev", "q1", "median", "q3") else F.col(c) for c in df.columns]
    )


@register("describe_numeric", _describe_sql(LINEITEM_NULLED_SQL, "l_quantity", "float", True, True, "DOUBLE"))
def describe_numeric(spark, d):
    return _describe_round(X.describe(lineitem_nulled(spark, d), "l_quantity"))


@register("describe_price", _describe_sql("lineitem", "l_extendedprice", "float", True, True, "DOUBLE"))
def describe_price(spark, d):
    return _describe_round(X.describe(table(spark, d, "lineitem"), "l_extendedprice"))


@register("describe_temporal", _describe_sql("orders", "o_orderdate", "datetime", False, True, "TIMESTAMP"))
def describe_temporal(spark, d):
    return _describe_round(X.describe(table(spark, d, "orders"), "o_orderdate"))


@register("describe_string", _describe_sql(EVENTS_NULLED_SQL, "event_type", "string", False, False, "VARCHAR"))
def describe_string(spark, d):
    return _describe_round(X.describe(events_nulled(spark, d), "event_type"))


@register(
    "mode_value",
    "SELECT p_size AS mode, COUNT(*) AS mode_count FROM part GROUP BY p_size ORDER BY COUNT(*) DESC, p_size LIMIT 1",
)
def mode_value(spark, d):
    return X.describe(table(spark, d, "part"), "p_size").select("mode", "mode_count")


# -- frequencies / bar -----------------------------------------------------------
def _freq_sql(src: str, col: str, limit: int, label: bool) -> str:
    value = (
        "COALESCE(CAST(value AS VARCHAR), '(missing)') AS label"
        if label
        else "value"
    )
    extra = "" if label else ", tot.total_rows, tot.k > " + str(limit) + " AS truncated"
    return (
        f"WITH g AS (SELECT {col} AS value, COUNT(*) AS count FROM {src} s GROUP BY 1), "
        "tot AS (SELECT CAST(SUM(count) AS BIGINT) AS total_rows, COUNT(*) AS k FROM g), "
        "top AS (SELECT value, count, ROW_NUMBER() OVER (ORDER BY count DESC, value ASC NULLS LAST) AS rank FROM g) "
        f"SELECT CAST(rank AS BIGINT) AS rank, {value}, count, "
        "ROUND(count * CAST(100.0 AS DOUBLE) / tot.total_rows, 4) AS percentage"
        f"{extra} FROM top, tot WHERE rank <= {limit}"
    )


@register("frequencies", _freq_sql(EVENTS_NULLED_SQL, "event_type", 3, False))
def frequencies(spark, d):
    return X.frequencies(events_nulled(spark, d), "event_type", limit=3)


@register("frequencies_numeric", _freq_sql("lineitem", "l_quantity", 30, False))
def frequencies_numeric(spark, d):
    return X.frequencies(table(spark, d, "lineitem"), "l_quantity", limit=30)


@register("bar_chart", _freq_sql(EVENTS_NULLED_SQL, "event_type", 30, True))
def bar_chart(spark, d):
    return X.bar(events_nulled(spark, d), "event_type", limit=30)


# -- correlation / heatmap ---------------------------------------------------------
_CORR_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "flat")
_CORR_SRC = (
    f"(SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber * 0.0 AS flat FROM {LINEITEM_NULLED_SQL} a)"
)


def _corr_frame(spark, d):
    return lineitem_nulled(spark, d).select(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_linenumber") * 0.0).alias("flat")
    )


def _corr_sql(heat: bool) -> str:
    parts = []
    for i, a in enumerate(_CORR_COLS):
        for j, b in enumerate(_CORR_COLS):
            r = f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE ROUND(corr({a}, {b}), 6) END"
            if heat:
                parts.append(f"SELECT '{b}' AS x, '{a}' AS y, {r} AS value FROM {_CORR_SRC} s")
            else:
                parts.append(
                    f"SELECT {i} AS i, {j} AS j, '{a}' AS row_column, '{b}' AS column_column, {r} AS r FROM {_CORR_SRC} s"
                )
    return " UNION ALL ".join(parts)


@register("correlation_matrix", _corr_sql(False))
def correlation_matrix(spark, d):
    out = X.correlation(_corr_frame(spark, d))
    return out.select("i", "j", "row_column", "column_column", _r("r"))


@register("corr_heatmap", _corr_sql(True))
def corr_heatmap(spark, d):
    out = X.heatmap(_corr_frame(spark, d))
    return out.select("x", "y", _r("value"))


# -- crosstab ------------------------------------------------------------------------
def _xtab_sql(src: str, a: str, b: str, limit: int) -> str:
    return (
        f"WITH r AS (SELECT {a} AS v FROM {src} s WHERE {a} IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, v LIMIT {limit}), "
        f"c AS (SELECT {b} AS v FROM {src} s WHERE {b} IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, v LIMIT {limit}), "
        f"k AS (SELECT COUNT(DISTINCT {a}) AS kr, COUNT(DISTINCT {b}) AS kc FROM {src} s), "
        f"g AS (SELECT {a} AS rv, {b} AS cv, COUNT(*) AS n FROM {src} s GROUP BY 1, 2), "
        "cells AS (SELECT r.v AS row_value, c.v AS column_value, COALESCE(g.n, 0) AS count "
        "FROM r CROSS JOIN c LEFT JOIN g ON g.rv = r.v AND g.cv = c.v) "
        "SELECT row_value, column_value, count, "
        "CAST(SUM(count) OVER (PARTITION BY row_value) AS BIGINT) AS row_total, "
        "CAST(SUM(count) OVER (PARTITION BY column_value) AS BIGINT) AS column_total, "
        "CAST(SUM(count) OVER () AS BIGINT) AS total, "
        f"(SELECT kr FROM k) > {limit} AS row_truncated, (SELECT kc FROM k) > {limit} AS column_truncated FROM cells"
    )


@register("crosstab", _xtab_sql("lineitem", "l_returnflag", "l_linestatus", 12))
def crosstab(spark, d):
    return X.crosstab(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", limit=12)


@register("crosstab_truncated", _xtab_sql("orders", "o_orderpriority", "o_orderstatus", 2))
def crosstab_truncated(spark, d):
    return X.crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", limit=2)


@register(
    "crosstab_totals",
    "WITH r AS (SELECT o_orderpriority AS v FROM orders GROUP BY 1 ORDER BY COUNT(*) DESC, v LIMIT 3), "
    "c AS (SELECT o_orderstatus AS v FROM orders GROUP BY 1 ORDER BY COUNT(*) DESC, v LIMIT 3), "
    "kept AS (SELECT * FROM orders WHERE o_orderpriority IN (SELECT v FROM r) AND o_orderstatus IN (SELECT v FROM c)) "
    "SELECT 'row' AS kind, o_orderpriority AS row_value, CAST(NULL AS VARCHAR) AS column_value, COUNT(*) AS count "
    "FROM kept GROUP BY 2 UNION ALL "
    "SELECT 'column', NULL, o_orderstatus, COUNT(*) FROM kept GROUP BY 3 UNION ALL "
    "SELECT 'total', NULL, NULL, COUNT(*) FROM kept",
)
def crosstab_totals(spark, d):
    return X.crosstab_totals(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", limit=3)


# -- histogram -----------------------------------------------------------------------
def _hist_sql(src: str, col: str, bins: int) -> str:
    return (
        f"WITH b AS (SELECT CAST(MIN({col}) AS DOUBLE) AS lo, CAST(MAX({col}) AS DOUBLE) AS hi FROM {src} s), "
        f"h AS (SELECT LEAST({bins - 1}, CAST(FLOOR((CAST({col} AS DOUBLE) - b.lo) / ((b.hi - b.lo) / {bins})) AS INTEGER)) "
        f"AS bin, COUNT(*) AS count FROM {src} s, b WHERE {col} IS NOT NULL GROUP BY 1) "
        f"SELECT h.bin, ROUND(b.lo + h.bin * ((b.hi - b.lo) / {bins}), 6) AS start, "
        f"ROUND(b.lo + (h.bin + 1) * ((b.hi - b.lo) / {bins}), 6) AS \"end\", h.count FROM h, b"
    )


def _hist_round(df):
    return df.select("bin", _r("start"), _r("end"), "count")


@register("histogram", _hist_sql("lineitem", "l_extendedprice", 20))
def histogram(spark, d):
    return _hist_round(X.histogram(table(spark, d, "lineitem"), "l_extendedprice", bins=20))


@register("histogram_int", _hist_sql("part", "p_size", 10))
def histogram_int(spark, d):
    return _hist_round(X.histogram(table(spark, d, "part"), "p_size", bins=10))


# -- line / scatter / box / qq ------------------------------------------------------
@register(
    "line_mean",
    "SELECT o_orderdate AS x, ROUND(AVG(o_totalprice), 6) AS y FROM orders "
    "WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 1000",
)
def line_mean(spark, d):
    out = X.line(table(spark, d, "orders"), "o_orderdate", "o_totalprice", limit=1000)
    return out.select("x", _r("y"))


@register(
    "line_numeric",
    f"SELECT l_quantity AS x, ROUND(AVG(l_extendedprice), 6) AS y FROM {LINEITEM_NULLED_SQL} s "
    "WHERE l_quantity IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 1000",
)
def line_numeric(spark, d):
    out = X.line(lineitem_nulled(spark, d), "l_quantity", "l_extendedprice", limit=1000)
    return out.select("x", _r("y"))


@register(
    "scatter_sample",
    "SELECT CAST(c_custkey AS DOUBLE) AS x, c_acctbal AS y FROM customer",
)
def scatter_sample(spark, d):
    # 5000 >= customers at sf0.01, so the sample is the full set there.
    return X.scatter(table(spark, d, "customer"), "c_custkey", "c_acctbal", limit=5000)


@register("sample_large", "SELECT 500 AS rows, 500 AS found, TRUE AS spread FROM (SELECT COUNT(*) AS n FROM lineitem) t WHERE n > 500")
def sample_large(spark, d):
    """A sample far smaller than its table: its size, how many pairs stand in the table, and that equal rows do not crowd it."""
    df = table(spark, d, "lineitem").select(F.col("l_discount").alias("x"), F.col("l_tax").alias("y"))
    got = X.scatter(df, "x", "y", limit=500)
    pairs = df.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct()
    both = got.join(pairs.withColumn("known", F.lit(1)), ["x", "y"], "left")
    return both.agg(
        F.count(F.lit(1)).cast("int").alias("rows"),
        F.count("known").cast("int").alias("found"),
        (F.count_distinct("x", "y") > 50).alias("spread"),  # 99 pairs in the table
    )


@register(
    "box_single",
    "SELECT 'l_extendedprice' AS category, MIN(l_extendedprice) AS minimum, "
    "ROUND(QUANTILE_CONT(l_extendedprice, 0.25), 6) AS q1, ROUND(MEDIAN(l_extendedprice), 6) AS median, "
    "ROUND(QUANTILE_CONT(l_extendedprice, 0.75), 6) AS q3, MAX(l_extendedprice) AS maximum, COUNT(*) AS n "
    "FROM lineitem WHERE l_extendedprice IS NOT NULL",
)
def box_single(spark, d):
    out = X.box(table(spark, d, "lineitem"), "l_extendedprice")
    return out.select("category", "minimum", _r("q1"), _r("median"), _r("q3"), "maximum", "n")


@register(
    "box_grouped",
    "WITH t AS (SELECT COALESCE(CAST(p_brand AS VARCHAR), '(missing)') AS category, p_retailprice AS v FROM part "
    "WHERE p_retailprice IS NOT NULL), "
    "top AS (SELECT category FROM t GROUP BY 1 ORDER BY COUNT(*) DESC, category LIMIT 12) "
    "SELECT category, MIN(v) AS minimum, ROUND(QUANTILE_CONT(v, 0.25), 6) AS q1, ROUND(MEDIAN(v), 6) AS median, "
    "ROUND(QUANTILE_CONT(v, 0.75), 6) AS q3, MAX(v) AS maximum, COUNT(*) AS n "
    "FROM t WHERE category IN (SELECT category FROM top) GROUP BY 1",
)
def box_grouped(spark, d):
    out = X.box(table(spark, d, "part"), "p_retailprice", group="p_brand")
    return out.select("category", "minimum", _r("q1"), _r("median"), _r("q3"), "maximum", "n")


@register(
    "qq_points",
    "WITH o AS (SELECT s_acctbal AS ordered, ROW_NUMBER() OVER (ORDER BY s_acctbal) AS i, COUNT(*) OVER () AS m "
    "FROM supplier) "
    "SELECT CAST(i AS INTEGER) AS i, ROUND(CASE WHEN i = 1 THEN 1 - POW(0.5, 1.0 / m) WHEN i = m THEN POW(0.5, 1.0 / m) "
    "ELSE (i - 0.3175) / (m + 0.365) END, 9) AS p, ordered, m AS sample_size FROM o",
)
def qq_points(spark, d):
    # 5000 >= suppliers at sf0.01: the sample is the full set there.
    pts, _ = X.qq(table(spark, d, "supplier"), "s_acctbal", limit=5000)
    return pts.select("i", F.round("p", 9).alias("p"), "ordered", "sample_size")


@register(
    "qq_fit",
    "SELECT COUNT(*) AS sample_size, TRUE AS rising, ROUND(AVG(s_acctbal), 2) AS centre FROM supplier",
)
def qq_fit(spark, d):
    # The theoretical quantiles are symmetric, so the line passes the mean at 0.
    _, fit = X.qq(table(spark, d, "supplier"), "s_acctbal", limit=5000)
    return fit.select("sample_size", (F.col("slope") > 0).alias("rising"), F.round("intercept", 2).alias("centre"))
