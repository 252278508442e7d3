"""Exploration: describe, frequencies, correlation, crosstab and chart data.

Every operator is a fused aggregate over the version.  Results are small
DataFrames (one row, a top-k list, or a bounded grid).  Only bounded
values ever reach the driver: the top-k level lists of a crosstab (<= 21
per side), the histogram bounds (three numbers) and bucket edges of the
exact quantiles (see ``functions.ranks``).
"""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranks import quantiles as exact_quantiles
from ..functions.ranks import kept_counts, position_quantiles, value_positions
from ..functions.small import spread
from ..schema import CATEGORICAL_ROLE, NUMERIC, TEMPORAL, DatasetColumn, DatasetSchema, col_of

MISSING_LABEL = "(missing)"
BOX_GROUPS = 12


class ExploreError(ValueError):
    pass


def _column(df: DataFrame, ref: str, schema: DatasetSchema | None) -> DatasetColumn:
    schema = schema or DatasetSchema.of(df)
    return schema.resolve(ref)


def _numeric(df, ref, schema) -> DatasetColumn:
    c = _column(df, ref, schema)
    if c.data_type not in NUMERIC:
        raise ExploreError(f"column {c.display_name} must be numeric")
    return c


# -- E4 describe --------------------------------------------------------------
def describe(
    df: DataFrame, column: str, schema: DatasetSchema | None = None, quantiles: str = "exact"
) -> DataFrame:
    """One row of descriptive statistics for a column.

    Quantiles are exact (``quantile_cont``): one scan for the aggregates and approximate brackets,
    one for the value counts, which give the mode, the exact distinct count and the quantiles.
    ``quantiles="approx"`` uses ``percentile_approx`` in the first scan instead for very large columns where an approximation is enough.
    """
    if quantiles not in ("exact", "approx"):
        raise ExploreError("quantiles must be 'exact' or 'approx'")
    c = _column(df, column, schema)
    name = c.physical_name
    numeric = c.data_type in NUMERIC
    ordered = numeric or c.data_type in TEMPORAL
    dtype = df.schema[name].dataType
    df, name = df.select(col_of(name).alias("_x")), "_x"
    x = F.col(name)
    key = F.lit(c.column_id).alias("column_id")

    raw = [
        key,
        F.count(F.lit(1)).alias("row_count"),
        F.count(x).alias("valid_count"),
        (F.min(x) if ordered else F.lit(None).cast(dtype)).alias("minimum"),
        (F.max(x) if ordered else F.lit(None).cast(dtype)).alias("maximum"),
        (F.avg(x.cast("double")) if numeric else F.lit(None).cast("double")).alias("mean"),
        (F.stddev_samp(x.cast("double")) if numeric else F.lit(None).cast("double")).alias("stddev"),
    ]
    counts = kept_counts(df, name)  # mode, distinct values and quantiles come from one scan
    quarters, quarter_names = [0.25, 0.5, 0.75], ["q1", "median", "q3"]
    if numeric and quantiles == "exact":
        exact = position_quantiles(value_positions(None, name, counts=counts), name, quarters, quarter_names)
        base = df.agg(*raw).join(F.broadcast(exact))  # one row each
    elif numeric:
        sketch = F.percentile_approx(x.cast("double"), quarters, 10000).alias("_q")
        base = df.agg(*raw, sketch).select("*", *[F.col("_q")[i].alias(n) for i, n in enumerate(quarter_names)])
    else:
        base = df.agg(*raw).select("*", *[F.lit(None).cast("double").alias(q) for q in quarter_names])
    mode = counts.agg(
        key,
        F.count(F.lit(1)).alias("distinct_count"),
        F.min_by(x, F.struct((-F.col("n")).alias("k"), x.alias("v"))).alias("mode"),
        F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("mode_count"),
    )
    out = base.join(mode, "column_id")
    return out.select(
        "column_id",
        F.lit(c.display_name).alias("column_name"),
        F.lit(c.data_type).alias("data_type"),
        "row_count",
        "valid_count",
        (F.col("row_count") - F.col("valid_count")).alias("missing_count"),
        "distinct_count",
        "minimum",
        "maximum",
        "mean",
        "stddev",
        "q1",
        "median",
        "q3",
        "mode",
        "mode_count",
    )


# -- E5 frequencies / E9 bar -------------------------------------------------
def frequencies(df: DataFrame, column: str, limit: int = 30, schema: DatasetSchema | None = None) -> DataFrame:
    """Top ``limit`` values by count (NULL is a value, sorted last among ties)."""
    if not 1 <= limit <= 100:
        raise ExploreError("frequency limit must be between 1 and 100")
    c = _column(df, column, schema)
    x = col_of(c.physical_name)
    grouped = df.groupBy(x.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    top = grouped.orderBy(F.col("count").desc(), F.col("value").asc_nulls_last()).limit(limit + 1)
    ranked = top.withColumn(
        "rank",
        F.row_number().over(Window.orderBy(F.col("count").desc(), F.col("value").asc_nulls_last())).cast("bigint"),
    )
    totals = grouped.agg(
        F.coalesce(F.sum("count"), F.lit(0)).cast("bigint").alias("total_rows"),
        (F.count(F.lit(1)) > F.lit(limit)).alias("truncated"),
    )
    out = spread(ranked, totals).where(F.col("rank") <= limit)
    return out.select(
        "rank",
        "value",
        "count",
        F.when(F.col("total_rows") == 0, F.lit(0.0))
        .otherwise(F.round(F.col("count") * 100.0 / F.col("total_rows"), 4))
        .alias("percentage"),
        "total_rows",
        "truncated",
    )


def bar(df: DataFrame, column: str, limit: int = 30, schema: DatasetSchema | None = None) -> DataFrame:
    """Bar chart data: frequencies with text labels, NULL shown as ``(missing)``."""
    if not 1 <= limit <= 100:
        raise ExploreError("bar limit must be between 1 and 100")
    freq = frequencies(df, column, limit, schema)
    return freq.select(
        "rank",
        F.coalesce(F.col("value").cast("string"), F.lit(MISSING_LABEL)).alias("label"),
        "count",
        "percentage",
    )


# -- E6 correlation / E15 heatmap ---------------------------------------------
def correlation(df: DataFrame, columns: list[str] | None = None, schema: DatasetSchema | None = None) -> DataFrame:
    """Pearson matrix (pairwise-complete) in long form: i, j, row_column, column_column, r.

    Every row is unfolded into one (pair, x, y) record per column pair i <= j
    and ONE grouped aggregate computes n, co-moment and both variances per
    pair.  The per-row work equals that of a wide k*k aggregate, but the plan
    stays inside whole-stage codegen (a wide aggregate of hundreds of moment
    buffers does not), and only pairs x tasks partial rows are shuffled.  A
    constant column gives NULL (no division by zero under ANSI).
    """
    schema = schema or DatasetSchema.of(df)
    cols = [schema.resolve(c) for c in columns] if columns else [c for c in schema.columns if c.is_numeric]
    if not 2 <= len(cols) <= 20:
        raise ExploreError("correlation needs 2 to 20 numeric columns")
    for c in cols:
        if not c.is_numeric:
            raise ExploreError(f"column {c.display_name} must be numeric")
    names = [c.physical_name for c in cols]
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    records = F.array(
        *[
            F.struct(
                F.lit(i * k + j).alias("pair"),
                col_of(names[i]).cast("double").alias("x"),
                col_of(names[j]).cast("double").alias("y"),
            )
            for i, j in pairs
        ]
    )
    long = df.select(F.inline(records)).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    stats = long.groupBy("pair").agg(
        F.try_divide(F.covar_pop("x", "y"), F.sqrt(F.var_pop("x") * F.var_pop("y"))).alias("r")
    )
    r = F.when(F.isnan("r"), F.lit(None)).otherwise(F.col("r"))
    # Mirror the upper triangle; the cell table is k*k literals (k <= 20).
    cells = F.array(
        *[
            F.struct(
                F.lit(min(i, j) * k + max(i, j)).alias("pair"),
                F.lit(i).alias("i"),
                F.lit(j).alias("j"),
                F.lit(cols[i].display_name).alias("row_column"),
                F.lit(cols[j].display_name).alias("column_column"),
            )
            for i in range(k)
            for j in range(k)
        ]
    )
    grid = df.sparkSession.range(1).select(F.inline(cells))
    # Left join from the fixed grid: a pair with no complete rows still has a (NULL) cell.
    return grid.join(F.broadcast(stats.select("pair", r.cast("double").alias("r"))), "pair", "left").select(
        "i", "j", "row_column", "column_column", "r"
    )


def heatmap(df: DataFrame, columns: list[str] | None = None, schema: DatasetSchema | None = None) -> DataFrame:
    """Correlation heatmap cells: x (column), y (row), value."""
    corr = correlation(df, columns, schema)
    return corr.select(
        F.col("column_column").alias("x"), F.col("row_column").alias("y"), F.col("r").alias("value")
    )


# -- E7 crosstab -------------------------------------------------------------
def _top_levels(df: DataFrame, name: str, limit: int) -> list:
    x = col_of(name)
    rows = (
        df.where(x.isNotNull())
        .groupBy(x.alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col("v").asc())
        .limit(limit + 1)
        .collect()
    )
    return [r["v"] for r in rows]


def crosstab(
    df: DataFrame, row: str, column: str, limit: int = 12, schema: DatasetSchema | None = None
) -> DataFrame:
    """Dense counts over the top ``limit`` levels of two categorical columns.

    Long form: row_value, column_value, count (zero-filled), row_total,
    column_total, total (over kept cells), row_truncated, column_truncated.
    The levels (<= limit + 1 per side) are fetched first; the grid is a
    ``pivot`` over the column levels, so no level-by-level product is formed.
    """
    schema = schema or DatasetSchema.of(df)
    if schema.resolve(row).column_id == schema.resolve(column).column_id:
        raise ExploreError("crosstab columns must be different")
    if not 2 <= limit <= 20:
        raise ExploreError("crosstab category limit must be between 2 and 20")
    rc, cc = schema.resolve(row), schema.resolve(column)
    if rc.data_type not in CATEGORICAL_ROLE or cc.data_type not in CATEGORICAL_ROLE:
        raise ExploreError("crosstab requires categorical columns")
    r_all = _top_levels(df, rc.physical_name, limit)
    c_all = _top_levels(df, cc.physical_name, limit)
    r_levels, c_levels = r_all[:limit], c_all[:limit]
    if not r_levels or not c_levels:
        raise ExploreError("crosstab requires observed values in both columns")
    rx, cx = col_of(rc.physical_name), col_of(cc.physical_name)
    keys = [f"_c{i}" for i in range(len(c_levels))]
    wide = (
        df.where(rx.isin(r_levels))
        .withColumn("_ck", F.coalesce(*[F.when(cx == F.lit(v), F.lit(k)) for v, k in zip(c_levels, keys)]))
        .groupBy(rx.alias("row_value"))
        .pivot("_ck", keys)
        .agg(F.count(F.lit(1)))
    )
    cells = wide.select(
        "row_value",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(v).alias("column_value"), F.coalesce(F.col(k), F.lit(0)).cast("bigint").alias("count"))
                    for v, k in zip(c_levels, keys)
                ]
            )
        ),
    )
    w_row = Window.partitionBy("row_value")
    w_col = Window.partitionBy("column_value")
    whole = Window.partitionBy()
    # cells has at most limit x limit rows: the windows below run on a bounded grid.
    return cells.select(
        "row_value",
        "column_value",
        "count",
        F.sum("count").over(w_row).alias("row_total"),
        F.sum("count").over(w_col).alias("column_total"),
        F.sum("count").over(whole).alias("total"),
        F.lit(len(r_all) > limit).alias("row_truncated"),
        F.lit(len(c_all) > limit).alias("column_truncated"),
    )


def crosstab_totals_frame(df: DataFrame, row: str, column: str) -> DataFrame:
    """Marginal and grand totals with ``cube``: kind in (cell, row, column, total)."""
    cubed = df.cube(col_of(row).alias("row_value"), col_of(column).alias("column_value")).agg(
        F.count(F.lit(1)).alias("count"), F.grouping_id().alias("_g")
    )
    kind = (
        F.when(F.col("_g") == 0, "cell")
        .when(F.col("_g") == 1, "row")
        .when(F.col("_g") == 2, "column")
        .otherwise("total")
    )
    return cubed.select(kind.alias("kind"), "row_value", "column_value", "count")


def crosstab_totals(
    df: DataFrame, row: str, column: str, limit: int = 12, schema: DatasetSchema | None = None
) -> DataFrame:
    """Totals over the kept levels, from one ``cube`` aggregation."""
    schema = schema or DatasetSchema.of(df)
    rc, cc = schema.resolve(row), schema.resolve(column)
    r_levels = _top_levels(df, rc.physical_name, limit)[:limit]
    c_levels = _top_levels(df, cc.physical_name, limit)[:limit]
    kept = df.where(col_of(rc.physical_name).isin(r_levels) & col_of(cc.physical_name).isin(c_levels))
    return crosstab_totals_frame(kept, rc.physical_name, cc.physical_name).where(F.col("kind") != "cell")


# -- E8 histogram --------------------------------------------------------------
def histogram(df: DataFrame, column: str, bins: int = 20, schema: DatasetSchema | None = None) -> DataFrame:
    """Equal-width bins between min and max; empty bins omitted."""
    if not 5 <= bins <= 100:
        raise ExploreError("histogram bins must be between 5 and 100")
    c = _numeric(df, column, schema)
    x = col_of(c.physical_name)
    bounds = df.agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"), F.count(x).alias("n")).first()
    spark = df.sparkSession
    schema_out = "bin int, start double, end double, count bigint"
    if bounds is None or bounds["lo"] is None:
        return spark.createDataFrame([], schema_out)
    lo, hi = float(bounds["lo"]), float(bounds["hi"])
    if lo == hi:
        return df.where(x.isNotNull()).agg(
            F.lit(0).alias("bin"), F.lit(lo).alias("start"), F.lit(hi).alias("end"), F.count(F.lit(1)).alias("count")
        )
    width = (hi - lo) / bins
    b = F.least(F.lit(bins - 1), F.floor((x.cast("double") - F.lit(lo)) / F.lit(width)).cast("int"))
    grouped = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return grouped.select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("start"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("end"),
        "count",
    )


# -- E10 line ------------------------------------------------------------------
def line(df: DataFrame, x: str, y: str, limit: int = 1000, schema: DatasetSchema | None = None) -> DataFrame:
    """Mean of y per x (complete pairs), ordered by x, first ``limit`` points."""
    if not 5 <= limit <= 1000:
        raise ExploreError("line chart limit must be between 5 and 1000")
    schema = schema or DatasetSchema.of(df)
    xc, yc = schema.resolve(x), _numeric(df, y, schema)
    if xc.data_type not in NUMERIC | TEMPORAL:
        raise ExploreError("line chart x column must be numeric or temporal")
    xx, yy = col_of(xc.physical_name), col_of(yc.physical_name)
    return (
        df.where(xx.isNotNull() & yy.isNotNull())
        .groupBy(xx.alias("x"))
        .agg(F.avg(yy).alias("y"))
        .orderBy("x")
        .limit(limit)
    )


# -- E11 scatter / L6 sample --------------------------------------------------
def sample_rows(df: DataFrame, n: int, seed: int = 42, key_cols: list[str] | None = None) -> DataFrame:
    """Uniform sample of min(n, N) rows.

    Every row gets its own uniform number -- equal rows get different ones -- and the ``n``
    smallest are kept: a top-k (per-partition heaps, then a merge of n x partitions), never a full
    sort.  The numbers depend on the seed and the partitioning of ``df``; name the columns of a
    unique row key in ``key_cols`` to make the sample independent of the partitioning.
    """
    u = F.xxhash64(*[col_of(c) for c in key_cols], F.lit(seed)) if key_cols else F.rand(seed)
    return df.withColumn("_u", u).orderBy("_u").limit(n).drop("_u")


def scatter(
    df: DataFrame, x: str, y: str, limit: int = 5000, seed: int = 42, schema: DatasetSchema | None = None
) -> DataFrame:
    if not 5 <= limit <= 5000:
        raise ExploreError("chart limit must be between 5 and 5000")
    schema = schema or DatasetSchema.of(df)
    xc, yc = _numeric(df, x, schema), _numeric(df, y, schema)
    pairs = df.select(
        col_of(xc.physical_name).cast("double").alias("x"), col_of(yc.physical_name).cast("double").alias("y")
    ).dropna()
    return sample_rows(pairs, limit, seed)


# -- E12/E13 box ---------------------------------------------------------------
def box(
    df: DataFrame, x: str, group: str | None = None, schema: DatasetSchema | None = None, top: int | None = BOX_GROUPS
) -> DataFrame:
    """Five-number summary of x (exact quantiles), optionally per group.

    With a group, the ``top`` largest groups by non-null count are kept (ties
    by label); a NULL group is labelled ``(missing)``.
    """
    schema = schema or DatasetSchema.of(df)
    xc = _numeric(df, x, schema)
    name = xc.physical_name
    valid = df.where(col_of(name).isNotNull())
    value = col_of(name).alias("_x")
    if group is None:
        data = valid.select(value, F.lit(xc.display_name).alias("category"))
    else:
        gc = schema.resolve(group)
        label = F.coalesce(col_of(gc.physical_name).cast("string"), F.lit(MISSING_LABEL))
        data = valid.select(value, label.alias("category"))
    name = "_x"
    if group is not None:
        if top is not None:
            levels = (
                data.groupBy("category")
                .agg(F.count(F.lit(1)).alias("n"))
                .orderBy(F.col("n").desc(), F.col("category").asc())
                .limit(top)
                .collect()
            )
            data = data.where(F.col("category").isin([r["category"] for r in levels]))
    x = F.col(name).cast("double")
    out = exact_quantiles(
        data, name, [0.25, 0.5, 0.75], ["q1", "median", "q3"], by=["category"],
        aggs=[F.min(x).alias("minimum"), F.max(x).alias("maximum"), F.count(F.lit(1)).alias("n")],
    )
    return out.select("category", "minimum", "q1", "median", "q3", "maximum", "n")


# -- E14 Q-Q -------------------------------------------------------------------
@F.pandas_udf(T.DoubleType())
def norm_ppf_udf(p: pd.Series) -> pd.Series:
    nd = NormalDist()
    return p.map(lambda v: nd.inv_cdf(v) if 0.0 < v < 1.0 else float("nan"))


def plotting_positions(sorted_values: DataFrame, value: str, n_col: str = "sample_size") -> DataFrame:
    """Filliben positions for rows carrying a 1-based ``i`` and the sample size."""
    n = F.col(n_col).cast("double")
    i = F.col("i").cast("double")
    last = F.pow(F.lit(0.5), 1.0 / n)
    p = F.when(F.col("i") == 1, 1.0 - last).when(F.col("i") == F.col(n_col), last).otherwise((i - 0.3175) / (n + 0.365))
    return sorted_values.withColumn("p", p)


def qq_points(sample: DataFrame, value: str) -> DataFrame:
    """Normal Q-Q points of a bounded sample: i, p, theoretical, ordered."""
    ranked = sample.select(F.col(value).cast("double").alias("ordered")).withColumn(
        "i", F.row_number().over(Window.orderBy("ordered"))
    )
    ranked = ranked.withColumn("sample_size", F.count(F.lit(1)).over(Window.partitionBy()))
    ranked = ranked.where("sample_size >= 3")  # fewer values make no plot
    pts = plotting_positions(ranked, "ordered")
    return pts.select("i", "p", norm_ppf_udf(F.col("p")).alias("theoretical"), "ordered", "sample_size")


def qq(
    df: DataFrame, x: str, limit: int = 5000, seed: int = 42, schema: DatasetSchema | None = None
) -> tuple[DataFrame, DataFrame]:
    """(points, fit) for a normal Q-Q plot of a seeded sample of <= limit values."""
    if not 5 <= limit <= 5000:
        raise ExploreError("chart limit must be between 5 and 5000")
    xc = _numeric(df, x, schema)
    values = df.select(col_of(xc.physical_name).cast("double").alias("v")).where(F.col("v").isNotNull())
    if values.limit(3).count() < 3:
        raise ExploreError("Q-Q plot requires at least three observed values")
    sample = sample_rows(values, limit, seed)
    pts = qq_points(sample, "v")
    return pts, qq_fit(pts)


def qq_fit(points: DataFrame) -> DataFrame:
    """Least-squares line through the Q-Q points: slope, intercept, r, sample_size."""
    return points.agg(
        F.regr_slope("ordered", "theoretical").alias("slope"),
        F.regr_intercept("ordered", "theoretical").alias("intercept"),
        F.corr("ordered", "theoretical").alias("r"),
        F.count(F.lit(1)).alias("sample_size"),
    )
