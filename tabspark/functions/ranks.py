"""Order statistics without a global sort: value positions, midranks, exact quantiles.

``value_positions`` turns a numeric column into one row per distinct value
(optionally per group) with

* ``n``      -- how many rows hold the value,
* ``before`` -- how many rows of the same group hold a smaller value,
* ``total``  -- rows in the group.

Rows are first collapsed to value counts (map-side combine, so a hot value
costs one row) and written once: the only scan of the data.  The counts are
dealt into ranges of about ``RANGE_ROWS`` distinct values by one range
shuffle, the totals of the ranges give each range its offset, and only the
values of one range are ordered together.  Counts that fit one range need
neither.

``quantiles`` needs no positions: one scan takes counts and an approximate bracket around every
quantile, a second one counts the rows below each bracket and keeps only the values inside, whose
exact order gives the exact quantile.  A quantile outside its bracket is taken from the positions.

From positions follow midranks (``before + (n + 1) / 2``, ties averaged),
the tie term ``sum(t^3 - t)`` and exact linear-interpolated quantiles
(the ``quantile_cont`` definition) as plain aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

RANGE_ROWS = 1_000_000  # distinct values ordered together, about
LOCAL_GROUPS = 10_000  # groups whose brackets may be broadcast
ACCURACY = 2000  # of the sketch that gives the brackets
MARGIN = 4.0 / ACCURACY  # share of the rows on either side of a quantile


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Non-null values of ``value`` with their multiplicity ``n`` (per group)."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def kept_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``value_counts``, written: one scan for everything that is taken from them."""
    return written(value_counts(df, value, by), "value-counts")


def value_positions(
    df: DataFrame | None, value: str, by: Sequence[str] = (), counts: DataFrame | None = None, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """One row per (group, distinct value): n, before, total (see module doc).

    ``counts`` (written value counts with an ``n`` column) may replace the scan of ``df``.
    """
    by = list(by)
    counts = counts if counts is not None else kept_counts(df, value, by)
    ranges = -(-counts.count() // range_rows)
    group = [F.col(c) for c in by] or [F.lit(0)]
    out = [*by, value, F.col("n").cast("bigint").alias("n")]
    if ranges <= 1:
        smaller = F.sum("n").over(Window.partitionBy(*group).orderBy(value)) - F.col("n")
        total = F.sum("n").over(Window.partitionBy(*group))
        return counts.select(*out, smaller.cast("bigint").alias("before"), total.cast("bigint").alias("total"))
    dealt = counts.repartitionByRange(ranges, *by, value).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "value-ranges")
    # One row a group and range.  Group keys may be NULL (a NULL group is a group).
    sums = dealt.groupBy(*by, "_range").agg(F.sum("n").alias("_rn"))
    sums = sums.select(
        *(F.col(c).alias(f"_o_{c}") for c in by), F.col("_range").alias("_o"),
        (F.sum("_rn").over(Window.partitionBy(*group).orderBy("_range")) - F.col("_rn")).alias("_offset"),
        F.sum("_rn").over(Window.partitionBy(*group)).alias("total"),
    )
    joined = dealt.join(sums, [F.col("_range") == F.col("_o")] + [F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in by])
    within = F.sum("n").over(Window.partitionBy("_range", *by).orderBy(value)) - F.col("n")
    before = (F.col("_offset") + within).cast("bigint").alias("before")
    return joined.select(*out, before, F.col("total").cast("bigint").alias("total"))


def midrank(positions: DataFrame) -> Column:
    """Average rank of tied values (1-based), as double."""
    return F.col("before").cast("double") + (F.col("n").cast("double") + 1.0) / 2.0


def tie_term() -> Column:
    """sum over distinct values of t^3 - t, in double (t^3 overflows bigint)."""
    t = F.col("n").cast("double")
    return F.sum(t * t * t - t)


def quantile_exprs(value: str, probs: Sequence[float], names: Sequence[str]) -> list[Column]:
    """Aggregates over ``value_positions`` rows giving exact ``quantile_cont`` values."""
    out = []
    v = F.col(value).cast("double")
    before = F.col("before")
    upto = F.col("before") + F.col("n")
    for p, name in zip(probs, names):
        pos = (F.col("total") - 1).cast("double") * F.lit(float(p))
        lo = F.floor(pos)
        hi = F.ceil(pos)
        v_lo = F.max(F.when((before <= lo) & (lo < upto), v))
        v_hi = F.max(F.when((before <= hi) & (hi < upto), v))
        frac = F.max(pos - lo)
        out.append((v_lo + frac * (v_hi - v_lo)).alias(name))
    return out


def position_quantiles(positions: DataFrame, value: str, probs: Sequence[float], names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles (per group) from value positions."""
    return positions.groupBy(*by).agg(*quantile_exprs(value, probs, names))


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    names: Sequence[str] | None = None,
    by: Sequence[str] = (),
    aggs: Sequence[Column] = (),
    counts: DataFrame | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` (per group) beside the aggregates ``aggs``.

    Scan 1 takes ``aggs``, counts and a sketch; its rows (one per group) are the only data that may
    be broadcast, and only up to LOCAL_GROUPS of them.  Scan 2 keeps a value if it lies inside a
    bracket and a count if it lies below; brackets hold about 2 * MARGIN of the rows, or all of them
    for small groups.  Groups with a quantile outside its bracket go through ``value_positions``.
    ``counts`` (value counts with a column n) may replace scan 2.
    """
    if len(probs) > 60:
        raise ValueError("at most 60 quantiles at once")
    names, by = list(names or [f"q{int(round(p * 100))}" for p in probs]), list(by)
    spark = df.sparkSession
    sketch = [min(1.0, max(0.0, c)) for p in probs for c in (p - MARGIN, p + MARGIN)]
    v = F.col(value).cast("double")
    stats = df.groupBy(*by).agg(
        F.count(value).alias("_total"),
        F.min(v).alias("_lo"),
        F.max(v).alias("_hi"),
        F.percentile_approx(v, sketch, ACCURACY).alias("_sketch"),
        *aggs,
    )
    known = stats.limit(LOCAL_GROUPS + 1).collect()
    local = len(known) <= LOCAL_GROUPS
    stats = spark.createDataFrame(known, stats.schema) if local else written(stats, "quantile-stats")
    ends = F.array(*[F.col("_hi" if i % 2 else "_lo") for i in range(len(sketch))])
    brackets = stats.where(F.col("_total") > 0).select(
        *[F.col(c).alias(f"_b_{c}") for c in by],
        F.lit(0).alias("_one"),
        F.col("_total").alias("_n_all"),
        F.when(F.col("_total") <= ACCURACY, ends).otherwise(F.col("_sketch")).alias("_cut"),
    )
    source = (df.withColumn("n", F.lit(1)) if counts is None else counts).where(F.col(value).isNotNull())
    source = source.select(*by, v.alias("_v"), F.col("n").alias("_n"), F.lit(0).alias("_zero"))
    cond = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by] or [F.col("_zero") == F.col("_one")]
    # Without groups the brackets are one row; with groups their number was just checked.
    met = source.join(F.broadcast(brackets) if local else brackets, cond)
    # A row shrinks to its value if a bracket holds it, and to the set of brackets that it lies below.
    cut, x = F.col("_cut"), F.col("_v")
    inside_any, below = F.lit(False), F.lit(0).cast("bigint")
    for j in range(len(probs)):
        inside_any = inside_any | ((x >= cut[2 * j]) & (x <= cut[2 * j + 1]))
        below = below + F.when(x < cut[2 * j], F.lit(1 << j)).otherwise(F.lit(0))
    small = met.groupBy(*by, F.when(inside_any, x).alias("_x"), below.alias("_below")).agg(F.sum("_n").alias("_n"))
    sides = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by] or [F.col("_zero") == F.col("_one")]
    small = small.withColumn("_zero", F.lit(0)).join(F.broadcast(brackets) if local else brackets, sides)
    cells = [
        F.when(F.col("_below").bitwiseAND(F.lit(1 << j)) != 0, F.struct(F.lit(j).alias("j"), F.lit(None).cast("double").alias("x"))).when(
            (F.col("_x") >= cut[2 * j]) & (F.col("_x") <= cut[2 * j + 1]), F.struct(F.lit(j).alias("j"), F.col("_x").alias("x"))
        )
        for j in range(len(probs))
    ]
    kept = small.select(*by, "_n_all", "_n", F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())))
    kept = kept.groupBy(*by, "_n_all", "j", "x").agg(F.sum("_n").alias("n"))
    order = Window.partitionBy(*by, "j").orderBy(F.col("x").asc_nulls_first())
    kept = kept.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside, upto = F.col("x").isNotNull(), F.col("before") + F.col("n")
    found, missed = [], F.lit(False)
    for j, (p, name) in enumerate(zip(probs, names)):
        pos = (F.col("_n_all") - 1).cast("double") * F.lit(float(p))
        at = lambda i, j=j: F.max(F.when((F.col("j") == j) & inside & (F.col("before") <= i) & (i < upto), F.col("x")))
        low, high, frac = at(F.floor(pos)), at(F.ceil(pos)), F.max(pos - F.floor(pos))
        missed = missed | low.isNull() | high.isNull()
        found.append((low + frac * (high - low)).alias(name))
    picked = kept.groupBy(*by).agg(F.max("_n_all").alias("_seen"), *found, missed.alias("_missed"))
    back = lambda left, right: [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)]
    if local:  # at most LOCAL_GROUPS rows
        picked = spark.createDataFrame(picked.collect(), picked.schema)
    else:
        picked = written(picked, "quantiles")
    lost = picked.where("_missed or _missed is null").select(*[F.col(c).alias(f"_m_{c}") for c in by])
    picked = picked.where("not _missed").select(*by, *names)
    if not lost.isEmpty():
        rows = df if counts is None else counts
        rows = rows.join(lost, back(by, [f"_m_{c}" for c in by]), "left_semi") if by else rows
        rest = kept_counts(rows, value, by) if counts is None else written(rows.select(*by, value, "n"), "value-counts")
        exact = position_quantiles(value_positions(None, value, by, rest), value, probs, names, by)
        picked = picked.union(exact.select(*by, *names))
    picked = picked.select(*[F.col(c).alias(f"_p_{c}") for c in by], F.lit(0).alias("_two"), *names)
    out = stats.withColumn("_three", F.lit(0)).join(picked, back(by, [f"_p_{c}" for c in by]) or [F.col("_three") == F.col("_two")], "left")
    extra = [c for c in stats.columns if c not in (*by, "_total", "_lo", "_hi", "_sketch")]
    return out.select(*by, *extra, *names)
