"""Profile queries (E1-E3, D2) over a projection with NULLs and duplicates."""

from __future__ import annotations

from ..operators import profile as PR
from ..schema import DatasetSchema
from .inputs import LINEITEM_FLAGS_SQL, lineitem_flags
from .registry import register

_FLAG_COLS = ("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
_FLAG_TYPES = ("string", "string", "float", "float")
_FLAG_STORAGE = ("STRING", "STRING", "DOUBLE", "DOUBLE")


def _profile_columns_sql() -> str:
    parts = []
    for i, (name, kind, storage) in enumerate(zip(_FLAG_COLS, _FLAG_TYPES, _FLAG_STORAGE)):
        parts.append(
            f"SELECT {i} AS position, 'col_{name}' AS column_id, '{name}' AS name, '{name}' AS display_name, "
            f"'{kind}' AS data_type, '{storage}' AS storage_type, TRUE AS nullable, "
            f"CAST(COUNT(*) - COUNT({name}) AS BIGINT) AS null_count, "
            f"CASE WHEN COUNT(*) = 0 THEN 0.0 ELSE ROUND(100.0 * (COUNT(*) - COUNT({name})) / COUNT(*), 2) END "
            f"AS null_percentage, CAST(COUNT(DISTINCT {name}) AS BIGINT) AS distinct_count "
            f"FROM {LINEITEM_FLAGS_SQL} t"
        )
    return " UNION ALL ".join(parts)


@register("profile_columns", _profile_columns_sql())
def profile_columns(spark, d):
    df = lineitem_flags(spark, d)
    return PR.column_profiles(df, DatasetSchema.of(df), exact_distinct=True)


@register("profile_columns_approx")
def profile_columns_approx(spark, d):
    # HyperLogLog++ counts differ from other engines' sketches: rows-only check.
    df = lineitem_flags(spark, d)
    return PR.column_profiles(df, DatasetSchema.of(df))


_DUPS_SQL = (
    "(SELECT COALESCE(SUM(n - 1), 0) AS d FROM (SELECT COUNT(*) AS n FROM "
    f"{LINEITEM_FLAGS_SQL} t GROUP BY l_returnflag, l_linestatus, l_quantity, l_discount HAVING COUNT(*) > 1) g)"
)
_MISSING_SQL = (
    "(SELECT COUNT(*) AS n, (COUNT(*) - COUNT(l_returnflag)) + (COUNT(*) - COUNT(l_linestatus)) + "
    "(COUNT(*) - COUNT(l_quantity)) + (COUNT(*) - COUNT(l_discount)) AS m FROM "
    f"{LINEITEM_FLAGS_SQL} t)"
)


@register(
    "profile_dataset",
    "SELECT CAST(s.n AS BIGINT) AS row_count, CAST(4 AS BIGINT) AS column_count, "
    "CAST(NULL AS BIGINT) AS byte_size, CAST(s.m AS BIGINT) AS missing_cells, "
    "CASE WHEN s.n = 0 THEN 0.0 ELSE ROUND(100.0 * s.m / (s.n * 4), 2) END AS missing_percentage, "
    "CAST(dd.d AS BIGINT) AS duplicate_rows, "
    "CASE WHEN s.n = 0 THEN 0.0 ELSE ROUND(100.0 * dd.d / s.n, 2) END AS duplicate_percentage "
    f"FROM {_MISSING_SQL} s, {_DUPS_SQL} dd",
)
def profile_dataset(spark, d):
    df = lineitem_flags(spark, d)
    return PR.dataset_profile(df, DatasetSchema.of(df))


@register("duplicate_rows", f"SELECT CAST(d AS BIGINT) AS duplicate_rows FROM {_DUPS_SQL} x")
def duplicate_rows(spark, d):
    return PR.duplicate_rows(lineitem_flags(spark, d))


def _warnings_sql() -> str:
    consts = " + ".join(
        f"CASE WHEN COUNT(*) > 0 AND COUNT(DISTINCT {c}) <= 1 AND COUNT({c}) > 0 THEN 1 ELSE 0 END"
        for c in _FLAG_COLS
    )
    missing = " + ".join(f"CASE WHEN COUNT({c}) < COUNT(*) THEN 1 ELSE 0 END" for c in _FLAG_COLS)
    base = f"(SELECT {missing} AS mc, {consts} AS cc FROM {LINEITEM_FLAGS_SQL} t)"
    return (
        "SELECT code, severity, message, affected FROM ("
        "SELECT 'missing_values' AS code, 'warning' AS severity, "
        "CAST(mc AS VARCHAR) || ' column(s) contain missing values.' AS message, CAST(mc AS BIGINT) AS affected "
        f"FROM {base} a UNION ALL "
        "SELECT 'duplicate_rows', 'warning', CAST(d AS VARCHAR) || ' duplicate row(s) were detected.', "
        f"CAST(d AS BIGINT) FROM {_DUPS_SQL} b UNION ALL "
        "SELECT 'constant_columns', 'info', CAST(cc AS VARCHAR) || ' column(s) have one observed value.', "
        f"CAST(cc AS BIGINT) FROM {base} c) w WHERE affected > 0"
    )


@register("quality_warnings", _warnings_sql())
def quality_warnings(spark, d):
    df = lineitem_flags(spark, d)
    return PR.profile_warnings(df, DatasetSchema.of(df), exact_distinct=True)
