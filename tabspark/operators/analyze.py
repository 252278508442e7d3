"""A whole analysis: the test's result row with its summaries, diagnostics and linked evidence.

``analyze`` knows which parts belong to which test.  Every part is a small DataFrame that runs when
it is read: one result row, one row per group or column, one row per diagnostic, chart points.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DatasetSchema
from . import diagnostics as D
from . import explore as X
from . import hypothesis as H

GROUPED = ("welch_t", "welch_anova", "mann_whitney", "kruskal")
PAIRED = ("paired_t", "wilcoxon")
DIAGNOSTIC = ("name", "statistic", "p_value", "status", "sample_size", "message")


@dataclass(frozen=True)
class Analysis:
    result: DataFrame
    summaries: DataFrame | None = None
    diagnostics: DataFrame | None = None
    evidence: dict[str, DataFrame] = field(default_factory=dict)


def _all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*DIAGNOSTIC) for p in parts])


def analyze(
    df: DataFrame,
    test_id: str,
    x: str,
    y: str | None = None,
    group: str | None = None,
    reference_value: float | None = None,
    confidence_level: float = 0.95,
    alternative: str = "two-sided",
    schema: DatasetSchema | None = None,
) -> Analysis:
    """Run a test with everything that belongs to it."""
    schema = schema or DatasetSchema.of(df)
    result = H.run_test(df, test_id, x, y, group, reference_value, confidence_level, alternative, schema)
    if test_id in GROUPED:
        evidence = {"box": X.box(df, x, group=group, schema=schema, top=None)}
        if test_id in ("mann_whitney", "kruskal"):
            checks = D.notes(H.grouped_values(df, x, group, schema), test_id)
        else:
            checks = _all(
                D.shapiro(df, x, group, confidence_level, schema), D.levene(df, x, group, confidence_level, schema, test_id)
            )
            evidence["qq"], evidence["qq_fit"] = D.residual_qq(df, x, group, schema)
        return Analysis(result, D.group_summaries(df, x, group, schema), checks, evidence)
    if test_id in PAIRED:
        summaries = D.column_summaries(df, [x, y], schema)
        diffs = D.paired_differences(df, x, y, schema)
        if test_id == "wilcoxon":
            return Analysis(result, summaries, D.notes(diffs, test_id))
        points, fit = D.paired_qq(df, x, y, schema)
        checks = D.shapiro(diffs.withColumnRenamed("d", "Paired differences"), "Paired differences", None, confidence_level)
        return Analysis(result, summaries, checks, {"qq": points, "qq_fit": fit})
    if test_id == "one_sample_t":
        points, fit = D.residual_qq(df, x, None, schema)
        checks = D.shapiro(df, x, None, confidence_level, schema)
        return Analysis(result, D.column_summaries(df, [x], schema), checks, {"qq": points, "qq_fit": fit})
    if test_id in ("pearson", "spearman"):
        pairs = H._pairs(df, x, y, schema)[0]
        return Analysis(result, None, D.notes(pairs, test_id), {"scatter": D.scatter_evidence(df, x, y, schema)})
    low = H.expected_cells(df, x, y, schema)
    checks = low.select(
        "name", F.col("minimum_expected").alias("statistic"), F.lit(None).cast("double").alias("p_value"), "status", "sample_size", "message"
    )
    return Analysis(result, None, checks, {"residuals": H.chi_cells(df, x, y, schema)})
