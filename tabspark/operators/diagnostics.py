"""Diagnostics and linked evidence for the hypothesis tests.

* ``group_summaries``  -- n, mean, exact median, sample sd per group.
* ``levene``           -- Brown-Forsythe (median-centred Levene) from group
                          medians and moments of |x - median|.
* ``shapiro``          -- Shapiro-Wilk per group on at most 5000 values per group, at
                          evenly spaced places in file order, one ``applyInPandas`` task per group.
* ``residual_qq``      -- normal Q-Q of group-centred residuals; above 5000
                          values a systematic sample of the sorted residuals taken
                          through ``value_positions`` (no global sort).
* ``notes``            -- the fixed informational diagnostics of each test.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dist, row_order
from ..functions.ranks import quantiles, value_positions
from ..schema import DatasetSchema, col_of
from .explore import qq_fit, qq_points, sample_rows
from .hypothesis import MAX_GROUPS, AnalyzeError, _pairs, _run_stage, check_group_count, grouped_values

SHAPIRO_LIMIT = 5000
QQ_LIMIT = 5000
EVIDENCE_LIMIT = 3000


def group_summaries(df: DataFrame, x: str, group: str, schema: DatasetSchema | None = None) -> DataFrame:
    """Label, n, mean, median (exact), stddev (sample; NULL when n = 1)."""
    values = grouped_values(df, x, group, schema)
    return _summaries(values)


def _summaries(values: DataFrame) -> DataFrame:
    moments = [F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("stddev")]
    out = quantiles(values, "x", [0.5], ["median"], by=["label"], aggs=moments)
    return out.select("label", "n", "mean", "median", "stddev")


def column_summaries(df: DataFrame, columns: list[str], schema: DatasetSchema | None = None) -> DataFrame:
    """The same summary of one or more numeric columns over their complete rows."""
    schema = schema or DatasetSchema.of(df)
    cols = [schema.resolve(c) for c in columns]
    rows = df.select(*[col_of(c.physical_name).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)]).dropna()
    one = [F.struct(F.lit(c.display_name).alias("label"), F.col(f"_v{i}").alias("x")) for i, c in enumerate(cols)]
    return _summaries(rows.select(F.inline(F.array(*one))))


# -- X1 Brown-Forsythe / Levene -------------------------------------------------------
def levene(
    df: DataFrame,
    x: str,
    group: str,
    confidence_level: float = 0.95,
    schema: DatasetSchema | None = None,
    test_id: str = "welch_t",
) -> DataFrame:
    """One-way ANOVA F on z = |x - group median|; status info (p >= alpha) or warning."""
    alpha = 1 - confidence_level
    values = grouped_values(df, x, group, schema)
    check_group_count(values)
    # at most MAX_GROUPS medians (just checked): a bounded broadcast
    medians = quantiles(values, "x", [0.5], ["median"], by=["label"])
    z = values.join(F.broadcast(medians), "label").select("label", F.abs(F.col("x") - F.col("median")).alias("z"))
    moments = (
        z.groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean"), F.var_samp("z").alias("var"))
        .orderBy("label")
        .limit(MAX_GROUPS + 1)
    )

    def fn(p):
        g = p["moments"]
        k = len(g)
        if k < 2 or k > MAX_GROUPS:
            raise AnalyzeError("Levene's test needs 2 to 50 groups")
        n = g["n"].to_numpy(float)
        m = g["mean"].to_numpy(float)
        v = np.nan_to_num(g["var"].to_numpy(float))
        N = n.sum()
        grand = (n * m).sum() / N
        ssb = (n * (m - grand) ** 2).sum()
        ssw = ((n - 1) * v).sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            stat = (ssb / (k - 1)) / (ssw / (N - k)) if N > k else math.nan
        pval = dist.f_sf(stat, k - 1, N - k) if math.isfinite(stat) else math.nan
        ok = math.isfinite(pval) and pval >= alpha
        # Diagnostic name and message.
        return pd.DataFrame(
            [(
                "Variance equality · Brown-Forsythe/Levene",
                float(stat) if math.isfinite(stat) else None,
                pval if math.isfinite(pval) else None,
                "info" if ok else "warning",
                int(N),
                LEVENE_MESSAGE["welch_anova" if test_id == "welch_anova" else "welch_t"],
            )],
            columns=["name", "statistic", "p_value", "status", "sample_size", "message"],
        )

    return _run_stage({"moments": moments}, fn, _DIAG_SCHEMA)


# The variance diagnostic's message by test.
LEVENE_MESSAGE = {
    "welch_t": "Welch's test does not require equal variances; this diagnostic is reported to describe heteroscedasticity.",
    "welch_anova": "Welch ANOVA does not require equal variances; this diagnostic describes heteroscedasticity.",
}
_DIAG_SCHEMA = "name string, statistic double, p_value double, status string, sample_size bigint, message string"


# -- X2 Shapiro-Wilk --------------------------------------------------------------------
def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and p by Royston's approximation (algorithm AS R94), 3 <= n <= 5000."""
    x = np.sort(np.asarray(values, dtype=float))
    n = x.size
    if n < 3:
        raise ValueError("need at least three values")
    span = x[-1] - x[0]
    if span == 0:
        return 1.0, 1.0
    nd = dist._STD
    m = np.array([nd.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        # Polynomial coefficients of the published approximation.
        c1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
        c2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
        u = 1.0 / math.sqrt(n)
        mm = float(m @ m)
        c = m / math.sqrt(mm)
        an = c[-1] + sum(k * u**i for i, k in enumerate(c1))
        if n > 5:
            an1 = c[-2] + sum(k * u**i for i, k in enumerate(c2))
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an**2 - 2 * an1**2)
            a = m / math.sqrt(phi)
            a[-1], a[-2], a[0], a[1] = an, an1, -an, -an1
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * an**2)
            a = m / math.sqrt(phi)
            a[-1], a[0] = an, -an
    xc = x - x.mean()
    w = float((a @ x) ** 2 / (xc @ xc))
    w = min(w, 1.0)
    if n == 3:
        p = 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, max(0.0, min(1.0, p))
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        mu = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sigma = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
        if 1 - w <= 0 or gamma - math.log(1 - w) <= 0:
            return w, 0.0
        y = -math.log(gamma - math.log(1 - w))
    else:
        ln = math.log(n)
        mu = -1.5861 - 0.31082 * ln - 0.083751 * ln**2 + 0.0038915 * ln**3
        sigma = math.exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln**2)
        y = math.log(1 - w) if w < 1 else -math.inf
    return w, float(dist.norm_sf((y - mu) / sigma)) if math.isfinite(y) else 1.0


def bounded_sample(values: DataFrame, by: str, limit: int, seed: int = 42) -> DataFrame:
    """Rows of each group with a seeded uniform key below a per-group threshold.

    The threshold keeps about limit + 10 sd rows per group (all rows of small
    groups); the exact ``limit`` smallest keys are then chosen per group in
    the consumer.  Rows are never sorted per group in Spark.
    """
    counts = _group_sizes(values, by)
    margin = limit + 10.0 * math.sqrt(limit) + 100.0
    # A per-row uniform key (repeated values must not share a key); it depends
    # only on the seed and the input partitioning, so a lost task recomputes it.
    keyed = values.withColumn("_u", F.rand(seed))
    # counts has at most MAX_GROUPS rows (checked in _group_sizes): a bounded broadcast.
    return keyed.join(F.broadcast(counts), by).where(F.col("_u") < F.lit(margin) / F.col("_n"))


def _group_sizes(values: DataFrame, by: str) -> DataFrame:
    """Rows per group; more than MAX_GROUPS groups is an error (one bounded job)."""
    counts = values.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    if counts.limit(MAX_GROUPS + 1).count() > MAX_GROUPS:
        raise AnalyzeError("more than 50 groups")
    return counts


def shapiro(
    df: DataFrame,
    x: str,
    group: str | None = None,
    confidence_level: float = 0.95,
    schema: DatasetSchema | None = None,
    limit: int = SHAPIRO_LIMIT,
    seed: int = 42,
) -> DataFrame:
    """Shapiro-Wilk per group (or for the whole column) with pass/warning at alpha.

    More than ``limit`` values: those at evenly spaced places in file order, or a seeded uniform
    sample where the rows have no file order.
    """
    alpha = 1 - confidence_level
    schema = schema or DatasetSchema.of(df)
    if group is None:
        xc = schema.resolve(x)
        values = df.select(F.lit(xc.display_name).alias("label"), col_of(xc.physical_name).cast("double").alias("x")).dropna()
    else:
        values = grouped_values(df, x, group, schema)
    if row_order.has_address(values):
        counts = _group_sizes(values, "label").withColumnsRenamed({"label": "_label", "_n": "_total"})
        sample = row_order.systematic_rows(values, limit, ["label"]).withColumn("_u", F.lit(0.0))
        # at most MAX_GROUPS rows (checked in _group_sizes): a bounded broadcast
        sample = sample.join(F.broadcast(counts), F.col("label") == F.col("_label")).drop("_label")
    else:
        sample = bounded_sample(values, "label", limit, seed).withColumnRenamed("_n", "_total")

    def per_group(pdf: pd.DataFrame) -> pd.DataFrame:
        label = pdf["label"].iloc[0]
        total = int(pdf["_total"].iloc[0])
        chosen = pdf.nsmallest(limit, "_u")["x"].to_numpy(float)
        sampled = total > limit
        return pd.DataFrame([_shapiro_row(label, chosen, sampled, alpha)], columns=_DIAG_COLS)

    return sample.groupBy("label").applyInPandas(per_group, _DIAG_SCHEMA)


_DIAG_COLS = ["name", "statistic", "p_value", "status", "sample_size", "message"]


def _shapiro_row(label: str, values: np.ndarray, sampled: bool, alpha: float):
    # Diagnostic name and messages.
    name = f"Normality · {label}"
    if values.size < 3:
        return (name, None, None, "unavailable", int(values.size),
                "At least three observed values are required for Shapiro-Wilk.")
    w, p = shapiro_wilk(values)
    qualifier = " on a bounded 5,000-value diagnostic sample" if sampled else ""
    return (
        name, w, p, "pass" if p >= alpha else "warning", int(values.size),
        f"Shapiro-Wilk{qualifier}; p {'≥' if p >= alpha else '<'} α ({alpha:.3f}). "
        "Treat this as a diagnostic, not a binary proof of normality.",
    )


# -- X6 residual Q-Q ------------------------------------------------------------------------
def systematic_sorted_sample(values: DataFrame, value: str, m: int) -> DataFrame:
    """Values at sorted positions floor(j (N-1)/(m-1)), j = 0..m-1 (all values if N <= m)."""
    pos = value_positions(values, value)
    n_total = F.col("total")
    step = (n_total - 1).cast("double") / F.lit(float(m - 1))
    last_pos = (F.col("before") + F.col("n") - 1).cast("double")
    # A value covering sorted positions [before, last] is picked by every j with
    # before <= floor(j * step) <= last, i.e. before/step <= j < (last + 1)/step.
    # Candidates come from inverting the position formula and are then kept by
    # the exact predicate floor(j * step) in [before, last], evaluated the same
    # way as the positions themselves (so float rounding cannot shift a pick).
    first_j = F.greatest(F.ceil(F.col("before").cast("double") / step) - 1, F.lit(0)).cast("int")
    last_j = F.least(F.ceil((last_pos + 1.0) / step), F.lit(m - 1)).cast("int")
    big = (
        pos.where((n_total > m) & (first_j <= last_j))
        .select(F.col(value), F.col("before"), last_pos.alias("_last"), step.alias("_step"),
                (n_total - 1).alias("_end"), F.explode(F.sequence(first_j, last_j)).alias("_j"))
        .withColumn(
            "_p",
            # the last position is the end point itself, as in an inclusive linspace
            F.when(F.col("_j") == m - 1, F.col("_end")).otherwise(F.floor(F.col("_j").cast("double") * F.col("_step"))),
        )
        .where((F.col("_p") >= F.col("before")) & (F.col("_p") <= F.col("_last")))
    )
    small = pos.where(n_total <= m).select(
        F.col(value), F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))).alias("_j")
    )
    return big.select(value).unionByName(small.select(value))


def residual_qq(
    df: DataFrame, x: str, group: str | None = None, schema: DatasetSchema | None = None, limit: int = QQ_LIMIT
) -> tuple[DataFrame, DataFrame]:
    """(points, fit) of group-centred residuals (or of x itself without a group); none for n < 3."""
    schema = schema or DatasetSchema.of(df)
    if group is None:
        return _qq(df.select(col_of(schema.resolve(x).physical_name).cast("double").alias("residual")).dropna(), limit)
    values = grouped_values(df, x, group, schema)
    _group_sizes(values, "label")
    means = values.groupBy("label").agg(F.avg("x").alias("_mean"))
    # at most MAX_GROUPS group means (checked above): a bounded broadcast
    resid = values.join(F.broadcast(means), "label").select((F.col("x") - F.col("_mean")).alias("residual"))
    return _qq(resid, limit)


def _qq(values: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    pts = qq_points(systematic_sorted_sample(values, "residual", limit), "residual")
    return pts, qq_fit(pts)


def paired_qq(
    df: DataFrame, x: str, y: str, schema: DatasetSchema | None = None, limit: int = QQ_LIMIT
) -> tuple[DataFrame, DataFrame]:
    """(points, fit) of the paired differences x - y."""
    return _qq(paired_differences(df, x, y, schema).withColumnRenamed("d", "residual"), limit)


def paired_differences(df: DataFrame, x: str, y: str, schema: DatasetSchema | None = None) -> DataFrame:
    schema = schema or DatasetSchema.of(df)
    a, b = schema.resolve(x), schema.resolve(y)
    return df.select((col_of(a.physical_name).cast("double") - col_of(b.physical_name).cast("double")).alias("d")).dropna()


# -- X7 scatter evidence ----------------------------------------------------------------------
def scatter_evidence(
    df: DataFrame, x: str, y: str, schema: DatasetSchema | None = None, limit: int = EVIDENCE_LIMIT, seed: int = 42
) -> DataFrame:
    """(x, y) of complete rows, at most ``limit``: evenly spaced in file order, or a seeded uniform
    sample where the rows have no file order."""
    pairs = _pairs(df, x, y, schema)[0]
    return row_order.systematic_rows(pairs, limit) if row_order.has_address(pairs) else sample_rows(pairs, limit, seed)


# -- X8 notes --------------------------------------------------------------------------------
# Informational diagnostics attached to the rank and correlation tests.
NOTES = {
    "mann_whitney": ("Distributional form", "Inspect the linked box plot for distribution shape and spread."),
    "kruskal": ("Distributional form", "Inspect group distributions before interpreting H as a location effect."),
    "wilcoxon": (
        "Paired design",
        "Rows are treated as matched pairs. Confirm row alignment reflects the study design.",
    ),
    "pearson": ("Linearity", "Inspect the linked scatter plot for linear form and outliers."),
    "spearman": ("Monotonic form", "Inspect the linked scatter plot for monotonic form and outliers."),
}


def notes(df: DataFrame, test_id: str, sample_size_col: str | None = None) -> DataFrame:
    """The fixed ``info`` diagnostic of a test, with the number of rows it saw."""
    if test_id not in NOTES:
        raise AnalyzeError(f"no informational diagnostic for {test_id}")
    name, message = NOTES[test_id]
    return df.agg(
        F.lit(name).alias("name"),
        F.lit(None).cast("double").alias("statistic"),
        F.lit(None).cast("double").alias("p_value"),
        F.lit("info").alias("status"),
        F.count(F.lit(1)).alias("sample_size"),
        F.lit(message).alias("message"),
    )
