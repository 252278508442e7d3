"""Hypothesis-test and diagnostic queries with their SQL twins.

The oracle checks statistics, degrees of freedom, estimates and effect
sizes.  p-values are checked where SQL has a closed form (F with df1 = 2,
chi-square with df = 2); the others are pinned by unit tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import row_order
from ..operators import diagnostics as D
from ..operators import explore as X
from ..operators import hypothesis as H
from .inputs import LINEITEM_NULLED_SQL, lineitem_nulled, table
from .registry import register

LN = LINEITEM_NULLED_SQL


def _r(c, digits=6):
    return F.round(F.col(c), digits).alias(c)


def _mag_sql(e: str, kind: str) -> str:
    a, b, c = (0.2, 0.5, 0.8) if kind == "standardized_mean" else (0.1, 0.3, 0.5)
    return (
        f"CASE WHEN ({e}) IS NULL THEN NULL WHEN abs({e}) < {a} THEN 'very small' WHEN abs({e}) < {b} THEN 'small' "
        f"WHEN abs({e}) < {c} THEN 'medium' ELSE 'large' END"
    )


_CORE = ["test_id", "sample_size", "estimate_name", "estimate", "statistic_name", "statistic", "df",
         "effect_name", "effect", "effect_magnitude"]


def _core(df, extra=(), drop=()):
    cols = [c for c in _CORE + list(extra) if c not in drop]
    return df.select(*[_r(c) if c in ("estimate", "statistic", "df", "effect", "p_value") else F.col(c) for c in cols])


def _grouped_sql(x: str, g: str, src: str) -> str:
    return f"(SELECT {g} AS label, {x} AS x FROM {src} s WHERE {g} IS NOT NULL AND {x} IS NOT NULL)"


# -- Welch t ---------------------------------------------------------------------------
_WELCH_T_SQL = (
    f"WITH t AS {_grouped_sql('l_quantity', 'l_linestatus', LN)}, "
    "g AS (SELECT label, COUNT(*) AS n, AVG(x) AS m, VAR_SAMP(x) AS v FROM t GROUP BY 1), "
    "a AS (SELECT * FROM g ORDER BY label LIMIT 1), b AS (SELECT * FROM g ORDER BY label DESC LIMIT 1), "
    "c AS (SELECT a.label AS la, b.label AS lb, a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2, a.v / a.n AS va, "
    "b.v / b.n AS vb, ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) AS pooled FROM a, b), "
    "e AS (SELECT *, (m1 - m2) / sqrt(pooled) * (1 - 3 / (4 * (n1 + n2) - 9)) AS g FROM c) "
    "SELECT 'welch_t' AS test_id, n1 + n2 AS sample_size, 'Mean difference · ' || la || ' − ' || lb AS estimate_name, "
    "ROUND(m1 - m2, 6) AS estimate, 't' AS statistic_name, ROUND((m1 - m2) / sqrt(va + vb), 6) AS statistic, "
    "ROUND(pow(va + vb, 2) / (va * va / (n1 - 1) + vb * vb / (n2 - 1)), 6) AS df, "
    "'Hedges'' g' AS effect_name, ROUND(g, 6) AS effect, " + _mag_sql("g", "standardized_mean") + " AS effect_magnitude FROM e"
)


@register("welch_t", _WELCH_T_SQL)
def welch_t(spark, d):
    return _core(H.welch_t(lineitem_nulled(spark, d), "l_quantity", "l_linestatus"))


@register("welch_t_result")
def welch_t_result(spark, d):
    # Full result row incl. p-value, interval and interpretation (rows-only check).
    return H.welch_t(lineitem_nulled(spark, d), "l_quantity", "l_linestatus")


# -- paired / one-sample -------------------------------------------------------------------
@register(
    "paired_t",
    "WITH s AS (SELECT COUNT(*) AS n, AVG(l_discount - l_tax) AS m, STDDEV_SAMP(l_discount - l_tax) AS sd "
    "FROM lineitem WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL) "
    "SELECT 'paired_t' AS test_id, n AS sample_size, 'Mean paired difference · l_discount − l_tax' AS estimate_name, "
    "ROUND(m, 6) AS estimate, 't' AS statistic_name, ROUND(m / (sd / sqrt(n)), 6) AS statistic, "
    "CAST(n - 1 AS DOUBLE) AS df, 'Cohen''s dz' AS effect_name, ROUND(m / sd, 6) AS effect, "
    + _mag_sql("m / sd", "standardized_mean") + " AS effect_magnitude FROM s",
)
def paired_t(spark, d):
    return _core(H.paired_t(table(spark, d, "lineitem"), "l_discount", "l_tax"))


@register(
    "one_sample_t",
    f"WITH s AS (SELECT COUNT(l_quantity) AS n, AVG(l_quantity) AS m, STDDEV_SAMP(l_quantity) AS sd FROM {LN} t) "
    "SELECT 'one_sample_t' AS test_id, n AS sample_size, 'Mean difference from reference' AS estimate_name, "
    "ROUND(m - 25, 6) AS estimate, 't' AS statistic_name, ROUND((m - 25) / (sd / sqrt(n)), 6) AS statistic, "
    "CAST(n - 1 AS DOUBLE) AS df, 'Cohen''s d' AS effect_name, ROUND((m - 25) / sd, 6) AS effect, "
    + _mag_sql("(m - 25) / sd", "standardized_mean") + " AS effect_magnitude FROM s",
)
def one_sample_t(spark, d):
    return _core(H.one_sample_t(lineitem_nulled(spark, d), "l_quantity", 25))


# -- Welch ANOVA (df1 = 2: p = (1 + 2F/df2)^(-df2/2)) -----------------------------------------
@register(
    "welch_anova",
    f"WITH t AS {_grouped_sql('l_quantity', 'l_returnflag', LN)}, "
    "g AS (SELECT label, COUNT(*) AS n, AVG(x) AS m, VAR_SAMP(x) AS v FROM t GROUP BY 1), "
    "w AS (SELECT *, n / v AS w FROM g), "
    "s AS (SELECT SUM(w) AS wt, SUM(w * m) / SUM(w) AS yb, COUNT(*) AS k, SUM(n) AS nn, SUM(n * m) / SUM(n) AS grand FROM w), "
    "a AS (SELECT SUM(w.w * pow(w.m - s.yb, 2)) / (s.k - 1) AS num, SUM(pow(1 - w.w / s.wt, 2) / (w.n - 1)) AS lam, "
    "SUM(w.n * pow(w.m - s.grand, 2)) AS ssb, SUM((w.n - 1) * w.v) AS ssw, s.k, s.nn FROM w, s GROUP BY s.k, s.nn), "
    "f AS (SELECT num / (1 + 2 * (k - 2) / (k * k - 1) * lam) AS fs, (k * k - 1) / (3 * lam) AS df2, "
    "ssb / (ssb + ssw) AS eta, nn FROM a) "
    "SELECT 'welch_anova' AS test_id, CAST(nn AS BIGINT) AS sample_size, 'F' AS statistic_name, "
    "ROUND(fs, 6) AS statistic, ROUND(pow(1 + 2 * fs / df2, -df2 / 2), 6) AS p_value, "
    "'Eta-squared (descriptive)' AS effect_name, ROUND(eta, 6) AS effect FROM f",
)
def welch_anova(spark, d):
    out = H.welch_anova(lineitem_nulled(spark, d), "l_quantity", "l_returnflag")
    return out.select("test_id", "sample_size", "statistic_name", _r("statistic"), _r("p_value"), "effect_name", _r("effect"))


# -- ranks (midranks by SQL windows on the oracle side) -------------------------------------
def _ranked_sql(src: str) -> str:
    return (
        f"(SELECT label, x, CAST(RANK() OVER (ORDER BY x) AS DOUBLE) + "
        f"(COUNT(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk FROM {src} q)"
    )


@register(
    "kruskal",
    f"WITH t AS {_grouped_sql('l_quantity', 'l_returnflag', LN)}, r AS {_ranked_sql('t')}, "
    "g AS (SELECT label, COUNT(*) AS n, SUM(rk) AS rs FROM r GROUP BY 1), "
    "ties AS (SELECT SUM(pow(c, 3) - c) AS tt FROM (SELECT COUNT(*) AS c FROM t GROUP BY x) z), "
    "s AS (SELECT CAST(SUM(n) AS DOUBLE) AS nn, COUNT(*) AS k, SUM(rs * rs / n) AS q FROM g), "
    "h AS (SELECT (12.0 / (nn * (nn + 1)) * q - 3 * (nn + 1)) / (1 - tt / (pow(nn, 3) - nn)) AS h, nn, k FROM s, ties) "
    "SELECT 'kruskal' AS test_id, CAST(nn AS BIGINT) AS sample_size, 'H' AS statistic_name, ROUND(h, 6) AS statistic, "
    "CAST(k - 1 AS DOUBLE) AS df, ROUND(exp(-h / 2), 6) AS p_value, 'Epsilon-squared' AS effect_name, "
    "ROUND(GREATEST(0, (h - k + 1) / (nn - k)), 6) AS effect FROM h",
)
def kruskal(spark, d):
    out = H.kruskal(lineitem_nulled(spark, d), "l_quantity", "l_returnflag")
    return out.select("test_id", "sample_size", "statistic_name", _r("statistic"), _r("df"), _r("p_value"),
                      "effect_name", _r("effect"))


@register(
    "mann_whitney",
    f"WITH t AS {_grouped_sql('l_quantity', 'l_linestatus', LN)}, r AS {_ranked_sql('t')}, "
    "g AS (SELECT label, COUNT(*) AS n, SUM(rk) AS rs, MEDIAN(x) AS md FROM r GROUP BY 1), "
    "a AS (SELECT * FROM g ORDER BY label LIMIT 1), b AS (SELECT * FROM g ORDER BY label DESC LIMIT 1), "
    "u AS (SELECT a.label AS la, b.label AS lb, a.n AS n1, b.n AS n2, a.rs - a.n * (a.n + 1) / 2.0 AS u1, "
    "a.md - b.md AS est FROM a, b) "
    "SELECT 'mann_whitney' AS test_id, n1 + n2 AS sample_size, 'Median difference · ' || la || ' − ' || lb AS estimate_name, "
    "ROUND(est, 6) AS estimate, 'U' AS statistic_name, ROUND(u1, 6) AS statistic, CAST(NULL AS DOUBLE) AS df, "
    "'Rank-biserial correlation' AS effect_name, ROUND(2 * u1 / (n1 * n2) - 1, 6) AS effect, "
    + _mag_sql("2 * u1 / (n1 * n2) - 1", "correlation") + " AS effect_magnitude FROM u",
)
def mann_whitney(spark, d):
    return _core(H.mann_whitney(lineitem_nulled(spark, d), "l_quantity", "l_linestatus"))


@register(
    "wilcoxon",
    "WITH p AS (SELECT l_discount - l_tax AS d FROM lineitem WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL), "
    "nz AS (SELECT 'all' AS label, abs(d) AS x, d > 0 AS pos FROM p WHERE d <> 0), "
    "r AS (SELECT x, pos, CAST(RANK() OVER (ORDER BY x) AS DOUBLE) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk FROM nz), "
    "s AS (SELECT COALESCE(SUM(CASE WHEN pos THEN rk END), 0) AS rp, COALESCE(SUM(CASE WHEN NOT pos THEN rk END), 0) AS rm FROM r), "
    "m AS (SELECT COUNT(*) AS n, MEDIAN(d) AS md FROM p) "
    "SELECT 'wilcoxon' AS test_id, n AS sample_size, 'Median paired difference' AS estimate_name, ROUND(md, 6) AS estimate, "
    "'W' AS statistic_name, ROUND(LEAST(rp, rm), 6) AS statistic, CAST(NULL AS DOUBLE) AS df, "
    "'Matched-pairs rank-biserial correlation' AS effect_name, ROUND((rp - rm) / (rp + rm), 6) AS effect, "
    + _mag_sql("(rp - rm) / (rp + rm)", "correlation") + " AS effect_magnitude FROM s, m",
)
def wilcoxon(spark, d):
    return _core(H.wilcoxon(table(spark, d, "lineitem"), "l_discount", "l_tax"))


@register(
    "pearson",
    f"WITH p AS (SELECT l_quantity AS x, l_extendedprice AS y FROM {LN} t WHERE l_quantity IS NOT NULL "
    "AND l_extendedprice IS NOT NULL), s AS (SELECT COUNT(*) AS n, corr(x, y) AS r FROM p) "
    "SELECT 'pearson' AS test_id, n AS sample_size, 'Pearson r' AS estimate_name, ROUND(r, 6) AS estimate, "
    "'r' AS statistic_name, ROUND(r, 6) AS statistic, CAST(n - 2 AS DOUBLE) AS df, 'Pearson r' AS effect_name, "
    "ROUND(r, 6) AS effect, " + _mag_sql("r", "correlation") + " AS effect_magnitude FROM s",
)
def pearson(spark, d):
    return _core(H.pearson(lineitem_nulled(spark, d), "l_quantity", "l_extendedprice"))


@register(
    "spearman",
    f"WITH p AS (SELECT l_quantity AS x, l_extendedprice AS y FROM {LN} t WHERE l_quantity IS NOT NULL "
    "AND l_extendedprice IS NOT NULL), "
    "r AS (SELECT CAST(RANK() OVER (ORDER BY x) AS DOUBLE) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, "
    "CAST(RANK() OVER (ORDER BY y) AS DOUBLE) + (COUNT(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p), "
    "s AS (SELECT COUNT(*) AS n, corr(rx, ry) AS r FROM r) "
    "SELECT 'spearman' AS test_id, n AS sample_size, 'Spearman rho' AS estimate_name, ROUND(r, 6) AS estimate, "
    "'ρ' AS statistic_name, ROUND(r, 6) AS statistic, CAST(NULL AS DOUBLE) AS df, 'Spearman rho' AS effect_name, "
    "ROUND(r, 6) AS effect, " + _mag_sql("r", "correlation") + " AS effect_magnitude FROM s",
)
def spearman(spark, d):
    return _core(H.spearman(lineitem_nulled(spark, d), "l_quantity", "l_extendedprice"))


# -- chi-square (df = 2: p = exp(-chi2/2)) ----------------------------------------------------
_CELLS_SQL = (
    "c AS (SELECT l_returnflag AS a, l_linestatus AS b, COUNT(*) AS o FROM lineitem "
    "WHERE l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2), "
    "ra AS (SELECT a, SUM(o) AS ra FROM c GROUP BY 1), cb AS (SELECT b, SUM(o) AS cb FROM c GROUP BY 1), "
    "nn AS (SELECT SUM(o) AS n FROM c), "
    "cells AS (SELECT ra.a, cb.b, COALESCE(c.o, 0) AS o, CAST(ra.ra * cb.cb AS DOUBLE) / nn.n AS e, nn.n "
    "FROM ra CROSS JOIN cb CROSS JOIN nn LEFT JOIN c ON c.a = ra.a AND c.b = cb.b)"
)


@register(
    "chi_square",
    f"WITH {_CELLS_SQL}, s AS (SELECT SUM(pow(o - e, 2) / e) AS chi2, COUNT(DISTINCT a) AS r, COUNT(DISTINCT b) AS k, "
    "MAX(n) AS n FROM cells) "
    "SELECT 'chi_square' AS test_id, CAST(n AS BIGINT) AS sample_size, 'χ²' AS statistic_name, ROUND(chi2, 6) AS statistic, "
    "CAST((r - 1) * (k - 1) AS DOUBLE) AS df, ROUND(exp(-chi2 / 2), 6) AS p_value, 'Cramér''s V' AS effect_name, "
    "ROUND(sqrt(chi2 / (n * LEAST(r - 1, k - 1))), 6) AS effect FROM s",
)
def chi_square(spark, d):
    out = H.chi_square(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return out.select("test_id", "sample_size", "statistic_name", _r("statistic"), _r("df"), _r("p_value"),
                      "effect_name", _r("effect"))


@register(
    "chi_cells",
    f"WITH {_CELLS_SQL} SELECT a AS row_value, b AS column_value, o AS observed, ROUND(e, 6) AS expected, "
    "ROUND(CASE WHEN e > 0 THEN (o - e) / sqrt(e) ELSE 0 END, 6) AS residual FROM cells",
)
def chi_cells(spark, d):
    out = H.chi_cells(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return out.select("row_value", "column_value", "observed", _r("expected"), _r("residual"))


@register(
    "expected_cells",
    f"WITH {_CELLS_SQL} SELECT 'Expected cell counts' AS name, ROUND(MIN(e), 6) AS minimum_expected, "
    "CASE WHEN SUM(CASE WHEN e < 5 THEN 1 ELSE 0 END) > 0 THEN 'warning' ELSE 'pass' END AS status, "
    "CAST(MAX(n) AS BIGINT) AS sample_size, CAST(SUM(CASE WHEN e < 5 THEN 1 ELSE 0 END) AS BIGINT) AS low_cells, "
    "COUNT(*) AS total_cells FROM cells",
)
def expected_cells(spark, d):
    out = H.expected_cells(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return out.select("name", _r("minimum_expected"), "status", "sample_size", "low_cells", "total_cells")


# -- summaries and diagnostics ------------------------------------------------------------------
@register(
    "group_summaries",
    f"SELECT label, COUNT(*) AS n, ROUND(AVG(x), 6) AS mean, ROUND(MEDIAN(x), 6) AS median, "
    f"ROUND(STDDEV_SAMP(x), 6) AS stddev FROM {_grouped_sql('l_quantity', 'l_returnflag', LN)} t GROUP BY 1",
)
def group_summaries(spark, d):
    out = D.group_summaries(lineitem_nulled(spark, d), "l_quantity", "l_returnflag")
    return out.select("label", "n", _r("mean"), _r("median"), _r("stddev"))


@register(
    "levene",
    f"WITH t AS {_grouped_sql('l_quantity', 'l_returnflag', LN)}, "
    "md AS (SELECT label, MEDIAN(x) AS md FROM t GROUP BY 1), "
    "z AS (SELECT t.label, abs(t.x - md.md) AS z FROM t JOIN md USING (label)), "
    "g AS (SELECT label, COUNT(*) AS n, AVG(z) AS m, VAR_SAMP(z) AS v FROM z GROUP BY 1), "
    "s AS (SELECT CAST(SUM(n) AS DOUBLE) AS nn, COUNT(*) AS k, SUM(n * m) / SUM(n) AS grand FROM g), "
    "f AS (SELECT (SUM(g.n * pow(g.m - s.grand, 2)) / (s.k - 1)) / (SUM((g.n - 1) * g.v) / (s.nn - s.k)) AS fs, "
    "s.nn, s.k FROM g, s GROUP BY s.nn, s.k, s.grand), "
    "p AS (SELECT fs, pow(1 + 2 * fs / (nn - k), -(nn - k) / 2) AS pv, nn FROM f) "
    "SELECT 'Variance equality · Brown-Forsythe/Levene' AS name, ROUND(fs, 6) AS statistic, ROUND(pv, 6) AS p_value, "
    "CASE WHEN pv >= 0.05 THEN 'info' ELSE 'warning' END AS status, CAST(nn AS BIGINT) AS sample_size FROM p",
)
def levene(spark, d):
    out = D.levene(lineitem_nulled(spark, d), "l_quantity", "l_returnflag")
    return out.select("name", _r("statistic"), _r("p_value"), "status", "sample_size")


@register("shapiro")
def shapiro(spark, d):
    # Shapiro-Wilk per group on <= 5000 sampled values: no SQL form (rows-only).
    return D.shapiro(table(spark, d, "lineitem"), "l_quantity", "l_returnflag")


_RESID_SQL = (
    "WITH t AS (SELECT l_returnflag AS label, l_quantity AS x FROM lineitem WHERE l_returnflag IS NOT NULL "
    "AND l_quantity IS NOT NULL), "
    "r AS (SELECT x - AVG(x) OVER (PARTITION BY label) AS residual FROM t), "
    "o AS (SELECT residual, ROW_NUMBER() OVER (ORDER BY residual) - 1 AS pos FROM r), "
    "n AS (SELECT COUNT(*) AS nn FROM t), "
    "ps AS (SELECT CASE WHEN j = 4999 THEN nn - 1 ELSE CAST(FLOOR(j * (CAST(nn - 1 AS DOUBLE) / 4999.0)) AS BIGINT) END "
    "AS pos FROM range(0, 5000) q(j), n), "
    "picks AS (SELECT o.residual FROM ps JOIN o ON o.pos = ps.pos), "
    "k AS (SELECT residual, ROW_NUMBER() OVER (ORDER BY residual) AS i, COUNT(*) OVER () AS m FROM picks) "
    "SELECT CAST(i AS INTEGER) AS i, ROUND(CASE WHEN i = 1 THEN 1 - POW(0.5, 1.0 / m) WHEN i = m THEN POW(0.5, 1.0 / m) "
    "ELSE (i - 0.3175) / (m + 0.365) END, 9) AS p, ROUND(residual, 6) AS ordered, m AS sample_size FROM k"
)


@register("residual_qq", _RESID_SQL)
def residual_qq(spark, d):
    pts, _ = D.residual_qq(table(spark, d, "lineitem"), "l_quantity", "l_returnflag")
    return pts.select("i", _r("p", 9), _r("ordered"), "sample_size")


@register("residual_qq_fit")
def residual_qq_fit(spark, d):
    _, fit = D.residual_qq(table(spark, d, "lineitem"), "l_quantity", "l_returnflag")
    return fit


@register(
    "box_by_group",
    f"SELECT label AS category, MIN(x) AS minimum, ROUND(QUANTILE_CONT(x, 0.25), 6) AS q1, ROUND(MEDIAN(x), 6) AS median, "
    f"ROUND(QUANTILE_CONT(x, 0.75), 6) AS q3, MAX(x) AS maximum, COUNT(*) AS n "
    f"FROM {_grouped_sql('l_quantity', 'l_returnflag', LN)} t GROUP BY 1",
)
def box_by_group(spark, d):
    out = X.box(lineitem_nulled(spark, d), "l_quantity", group="l_returnflag", top=None)
    return out.select("category", "minimum", _r("q1"), _r("median"), _r("q3"), "maximum", "n")


def _spaced_sql(rows: str, columns: str, m: int, by: str = "0") -> str:
    """Rows at m evenly spaced places in file order within each group (all of a smaller group)."""
    return (
        f"WITH f AS (SELECT *, row_number() OVER () AS rn FROM {rows} s), "
        f"t AS (SELECT *, {by} AS grp, row_number() OVER (PARTITION BY {by} ORDER BY rn) - 1 AS pos, count(*) OVER (PARTITION BY {by}) AS nn FROM f), "
        f"p AS (SELECT grp, CASE WHEN j = {m - 1} THEN nn - 1 ELSE CAST(FLOOR(j * (CAST(nn - 1 AS DOUBLE) / {m - 1}.0)) AS BIGINT) END AS pos "
        f"FROM range(0, {m}) q(j), (SELECT DISTINCT grp, nn FROM t WHERE nn > {m})) "
        f"SELECT {columns} FROM t WHERE nn <= {m} OR EXISTS (SELECT 1 FROM p WHERE p.grp = t.grp AND p.pos = t.pos)"
    )


_PAIRS_SQL = f"(SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS label FROM {LN} WHERE l_quantity IS NOT NULL)"


@register("scatter_evidence", _spaced_sql(_PAIRS_SQL, "x, y", D.EVIDENCE_LIMIT))
def scatter_evidence(spark, d):
    """Complete pairs at evenly spaced places in file order."""
    return D.scatter_evidence(lineitem_nulled(spark, d), "l_quantity", "l_extendedprice")


@register("scatter_evidence_small", "SELECT CAST(c_nationkey AS DOUBLE) AS x, c_acctbal AS y FROM customer")
def scatter_evidence_small(spark, d):
    # 3000 >= customers at sf0.01: the evidence sample is the full set there.
    return X.scatter(table(spark, d, "customer"), "c_nationkey", "c_acctbal", limit=D.EVIDENCE_LIMIT)


@register("systematic_groups", _spaced_sql(_PAIRS_SQL, "label, x", D.SHAPIRO_LIMIT, "label"))
def systematic_groups(spark, d):
    """The values that the normality check of each group sees."""
    return row_order.systematic_rows(H.grouped_values(lineitem_nulled(spark, d), "l_quantity", "l_returnflag"), D.SHAPIRO_LIMIT, ["label"])


@register(
    "test_notes",
    f"SELECT 'Linearity' AS name, CAST(NULL AS DOUBLE) AS statistic, CAST(NULL AS DOUBLE) AS p_value, 'info' AS status, "
    "COUNT(*) AS sample_size, 'Inspect the linked scatter plot for linear form and outliers.' AS message "
    f"FROM {LN} t WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL",
)
def test_notes(spark, d):
    pairs = lineitem_nulled(spark, d).dropna(subset=["l_quantity", "l_extendedprice"])
    return D.notes(pairs, "pearson")


# -- recommendation -----------------------------------------------------------------------------
@register(
    "recommend_two_groups",
    "SELECT * FROM (VALUES ('welch_t', 'Welch independent t-test', TRUE, "
    "'l_quantity is numeric and l_linestatus has two observed groups.'), "
    "('mann_whitney', 'Mann-Whitney U', FALSE, 'Rank-based alternative for two independent groups.')) "
    "v(test_id, name, preferred, rationale) WHERE (SELECT COUNT(DISTINCT l_linestatus) FROM lineitem) = 2",
)
def recommend_two_groups(spark, d):
    out = H.recommend(table(spark, d, "lineitem"), "compare_groups", outcome="l_quantity", group="l_linestatus")
    return out.select("test_id", "name", "preferred", "rationale")


@register(
    "recommend_many_groups",
    "WITH k AS (SELECT COUNT(DISTINCT l_returnflag) AS k FROM lineitem) "
    "SELECT 'welch_anova' AS test_id, 'Welch one-way ANOVA' AS name, TRUE AS preferred, "
    "'l_quantity is numeric and l_returnflag has ' || CAST(k AS VARCHAR) || ' observed groups.' AS rationale FROM k "
    "WHERE k >= 3 UNION ALL SELECT 'kruskal', 'Kruskal-Wallis H', FALSE, "
    "'Rank-based alternative for three or more independent groups.' FROM k WHERE k >= 3",
)
def recommend_many_groups(spark, d):
    out = H.recommend(table(spark, d, "lineitem"), "compare_groups", outcome="l_quantity", group="l_returnflag")
    return out.select("test_id", "name", "preferred", "rationale")


def _picked_sql(values: str) -> str:
    """Q-Q points of ``values`` (a query with a column residual): 5000 evenly spaced sorted positions."""
    start = _RESID_SQL.index("o AS (SELECT residual")
    return f"WITH r AS ({values}), " + _RESID_SQL[start:].replace("FROM t)", "FROM r)")


@register("one_sample_qq", _picked_sql("SELECT l_quantity AS residual FROM lineitem WHERE l_quantity IS NOT NULL"))
def one_sample_qq(spark, d):
    pts, _ = D.residual_qq(table(spark, d, "lineitem"), "l_quantity")
    return pts.select("i", _r("p", 9), _r("ordered"), "sample_size")


@register("paired_qq", _picked_sql("SELECT l_discount - l_tax AS residual FROM lineitem WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL"))
def paired_qq(spark, d):
    pts, _ = D.paired_qq(table(spark, d, "lineitem"), "l_discount", "l_tax")
    return pts.select("i", _r("p", 9), _r("ordered"), "sample_size")


@register(
    "paired_summaries",
    f"WITH t AS (SELECT l_quantity AS q, l_extendedprice AS e FROM {LN} s WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL), "
    "u AS (SELECT 'l_quantity' AS label, q AS x FROM t UNION ALL SELECT 'l_extendedprice', e FROM t) "
    "SELECT label, COUNT(*) AS n, ROUND(AVG(x), 6) AS mean, ROUND(MEDIAN(x), 6) AS median, ROUND(STDDEV_SAMP(x), 6) AS stddev FROM u GROUP BY 1",
)
def paired_summaries(spark, d):
    out = D.column_summaries(lineitem_nulled(spark, d), ["l_quantity", "l_extendedprice"])
    return out.select("label", "n", _r("mean"), _r("median"), _r("stddev"))


_GOAL_SQL = (
    "SELECT * FROM (VALUES ('paired_t', TRUE, 'Compare row-aligned values of l_discount and l_tax.', 2, 1), "
    "('wilcoxon', FALSE, 'Rank-based alternative for paired numeric measurements.', 1, 1), "
    "('pearson', TRUE, 'Measure linear association between l_discount and l_tax.', 1, 1), "
    "('spearman', FALSE, 'Monotonic rank-based association with fewer distributional assumptions.', 1, 1), "
    "('chi_square', TRUE, 'Test association between l_returnflag and l_linestatus.', 2, 1), "
    "('one_sample_t', TRUE, 'Compare the mean of l_discount with a reference value.', 1, 1)) "
    "v(test_id, preferred, rationale, assumptions, notes) WHERE (SELECT COUNT(*) FROM lineitem) >= 0"
)


@register("recommend_other_goals", _GOAL_SQL)
def recommend_other_goals(spark, d):
    df = table(spark, d, "lineitem")
    out = H.recommend(df, "compare_paired", outcome="l_discount", secondary="l_tax")
    out = out.unionByName(H.recommend(df, "numeric_relationship", outcome="l_discount", secondary="l_tax"))
    out = out.unionByName(H.recommend(df, "categorical_association", outcome="l_returnflag", secondary="l_linestatus"))
    out = out.unionByName(H.recommend(df, "one_sample", outcome="l_discount"))
    return out.select("test_id", "preferred", "rationale", F.size("assumptions").alias("assumptions"), F.size("notes").alias("notes"))
