"""Data-quality profile: per-column null and distinct counts, duplicate rows, warnings.

``column_profiles`` is one scan with partial aggregation (no shuffle).
``dataset_profile`` and ``profile_warnings`` also need the duplicate-row
count, which is a group-by over every column.  Both are derived from the
same grouped frame, so the whole profile is one shuffle: the per-column
null counts are sums of the group counts and distinct counts do not change
when duplicates are collapsed.  Map-side partial aggregation collapses a
hot duplicate group before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DatasetSchema, col_of

_ROWS = "_rows"


def _distinct(name: str, exact: bool) -> Column:
    c = F.col(name)
    return F.count_distinct(c) if exact else F.approx_count_distinct(c)


def _pct(num: Column, den: Column, digits: int = 2) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(
        F.round(num.cast("double") * 100.0 / den.cast("double"), digits)
    )


def _metrics_row(df: DataFrame, schema: DatasetSchema, exact: bool, with_duplicates: bool) -> DataFrame:
    """One row: _rows, [_dups], _null_i, _distinct_i for every column i."""
    # Plain names inside, so a column may have any name.
    df = df.select(*[col_of(name).alias(f"_c{i}") for i, name in enumerate(schema.names)])
    names = df.columns
    if with_duplicates:
        grouped = df.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
        exprs = [
            F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias(_ROWS),
            F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)).cast("bigint").alias("_dups"),
        ]
        for i, name in enumerate(names):
            exprs.append(
                F.coalesce(F.sum(F.when(F.col(name).isNull(), F.col("_n"))), F.lit(0)).cast("bigint").alias(f"_null_{i}")
            )
            exprs.append(_distinct(name, exact).cast("bigint").alias(f"_distinct_{i}"))
        return grouped.agg(*exprs)
    exprs = [F.count(F.lit(1)).alias(_ROWS)]
    for i, name in enumerate(names):
        exprs.append((F.count(F.lit(1)) - F.count(F.col(name))).alias(f"_null_{i}"))
        exprs.append(_distinct(name, exact).cast("bigint").alias(f"_distinct_{i}"))
    return df.agg(*exprs)


def _long(row: DataFrame, schema: DatasetSchema) -> DataFrame:
    """Unpivot the metrics row into one row per column (metadata as literals)."""
    parts = []
    for i, c in enumerate(schema.columns):
        parts.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c.column_id).alias("column_id"),
                F.lit(c.physical_name).alias("name"),
                F.lit(c.display_name).alias("display_name"),
                F.lit(c.data_type).alias("data_type"),
                F.lit(c.storage_type).alias("storage_type"),
                F.lit(c.nullable).alias("nullable"),
                F.col(f"_null_{i}").alias("null_count"),
                _pct(F.col(f"_null_{i}"), F.col(_ROWS)).alias("null_percentage"),
                F.col(f"_distinct_{i}").alias("distinct_count"),
            )
        )
    return row.select(F.inline(F.array(*parts)))


def column_profiles(df: DataFrame, schema: DatasetSchema | None = None, exact_distinct: bool = False) -> DataFrame:
    """One row per column -- nulls, null %, (approximate) distinct values."""
    schema = schema or DatasetSchema.of(df)
    return _long(_metrics_row(df, schema, exact_distinct, with_duplicates=False), schema)


def _dataset_cols(schema: DatasetSchema, byte_size: int | None) -> list[Column]:
    k = len(schema.columns)
    missing = sum((F.col(f"_null_{i}") for i in range(k)), F.lit(0)).cast("bigint")
    rows = F.col(_ROWS)
    return [
        rows.alias("row_count"),
        F.lit(k).cast("bigint").alias("column_count"),
        F.lit(byte_size).cast("bigint").alias("byte_size"),
        missing.alias("missing_cells"),
        _pct(missing, rows * F.lit(k)).alias("missing_percentage"),
        F.col("_dups").alias("duplicate_rows"),
        _pct(F.col("_dups"), rows).alias("duplicate_percentage"),
    ]


def dataset_profile(
    df: DataFrame,
    schema: DatasetSchema | None = None,
    byte_size: int | None = None,
) -> DataFrame:
    """One row -- rows, columns, bytes, missing cells/%, duplicate rows/%."""
    schema = schema or DatasetSchema.of(df)
    row = _metrics_row(df, schema, exact=False, with_duplicates=True)
    return row.select(*_dataset_cols(schema, byte_size))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """SUM(n-1) over groups of identical rows (0 when none)."""
    grouped = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return grouped.agg(
        F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n") - 1)), F.lit(0)).cast("bigint").alias("duplicate_rows")
    )


def _warning_rows(row: DataFrame, schema: DatasetSchema) -> DataFrame:
    k = len(schema.columns)
    rows = F.col(_ROWS)
    with_missing = sum((F.when(F.col(f"_null_{i}") > 0, 1).otherwise(0) for i in range(k)), F.lit(0))
    constant = sum(
        (
            F.when(
                (rows > 0) & (F.col(f"_distinct_{i}") <= 1) & (F.col(f"_null_{i}") < rows), 1
            ).otherwise(0)
            for i in range(k)
        ),
        F.lit(0),
    )
    candidates = F.array(
        F.struct(
            F.lit("missing_values").alias("code"),
            F.lit("warning").alias("severity"),
            F.format_string("%d column(s) contain missing values.", with_missing).alias("message"),
            with_missing.cast("bigint").alias("affected"),
        ),
        F.struct(
            F.lit("duplicate_rows").alias("code"),
            F.lit("warning").alias("severity"),
            F.format_string("%d duplicate row(s) were detected.", F.col("_dups")).alias("message"),
            F.col("_dups").cast("bigint").alias("affected"),
        ),
        F.struct(
            F.lit("constant_columns").alias("code"),
            F.lit("info").alias("severity"),
            F.format_string("%d column(s) have one observed value.", constant).alias("message"),
            constant.cast("bigint").alias("affected"),
        ),
    )
    return row.select(F.inline(F.filter(candidates, lambda w: w["affected"] > 0)))


def profile_warnings(df: DataFrame, schema: DatasetSchema | None = None, exact_distinct: bool = False) -> DataFrame:
    """Quality warnings (missing values, duplicate rows, constant columns)."""
    schema = schema or DatasetSchema.of(df)
    return _warning_rows(_metrics_row(df, schema, exact_distinct, with_duplicates=True), schema)


def profile(
    df: DataFrame,
    schema: DatasetSchema | None = None,
    byte_size: int | None = None,
    exact_distinct: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Full profile as (dataset row, column rows, warnings) from ONE grouped scan.

    The metrics row is tiny (2k+2 numbers); it is cached so the three
    results share the scan and the shuffle.
    """
    schema = schema or DatasetSchema.of(df)
    row = _metrics_row(df, schema, exact_distinct, with_duplicates=True).cache()
    return row.select(*_dataset_cols(schema, byte_size)), _long(row, schema), _warning_rows(row, schema)
