"""Pages of a version and read-only previews of a transformation.

Without an order key a page follows the files: the rows of a Parquet scan, or what filters and
projections leave of it, keep their addresses (``functions.row_order``), so a page reads only the
chunks that hold it.  With an order key, or where the addresses are lost (duplicates removed),
``orderBy(...).offset(o).limit(l)`` plans as a top-k (TakeOrderedAndProject); all other columns break
ties, so pages never overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from ..functions import row_order
from ..schema import DatasetSchema, col_of
from . import prepare as P

MAX_PREVIEW_ROWS = 200


def _order(keys) -> list[Column]:
    cols = []
    for key in keys:
        if isinstance(key, tuple):
            name, direction = key
            c = col_of(name)
            cols.append(c.desc_nulls_last() if direction == "desc" else c.asc_nulls_last())
        elif isinstance(key, Column):
            cols.append(key)
        else:
            cols.append(col_of(key).asc_nulls_last())
    return cols


def _ties(df: DataFrame) -> list[Column]:
    """Every column that can be ordered; maps and variants cannot."""
    return [col_of(f.name).asc_nulls_last() for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def _check(offset: int, limit: int) -> None:
    if not 1 <= limit <= MAX_PREVIEW_ROWS:
        raise ValueError(f"a page has 1 to {MAX_PREVIEW_ROWS} rows, not {limit}")
    if offset < 0:
        raise ValueError(f"a page cannot start at row {offset}")


def preview(df: DataFrame, offset: int = 0, limit: int = 50, order_by=None) -> DataFrame:
    """L1/L2: rows ``offset .. offset+limit`` in file order or under ``order_by`` (names or (name, dir))."""
    _check(offset, limit)
    if not order_by and row_order.has_address(df):
        return row_order.page(df, offset, limit)
    out = df.orderBy(*_order(order_by or []), *_ties(df))
    if offset:
        out = out.offset(offset)
    return out.limit(limit)


def transform_counts(df: DataFrame, ops, schema: DatasetSchema | None = None) -> DataFrame:
    """Input and output row counts of a pipeline as one row (two scans, no join)."""
    schema = schema or DatasetSchema.of(df)
    out = P.run(df, ops, schema)
    counts = df.agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit("input_rows")).unionByName(
        out.agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit("output_rows"))
    )
    return counts.groupBy().pivot("k", ["input_rows", "output_rows"]).agg(F.first("n"))


def transform_preview(
    df: DataFrame,
    ops,
    schema: DatasetSchema | None = None,
    limit: int = 50,
    order_by=None,
) -> tuple[DataFrame, DataFrame, DatasetSchema]:
    """L3: (first ``limit`` output rows, counts row, evolved schema); nothing is written."""
    _check(0, limit)
    schema = schema or DatasetSchema.of(df)
    child = P.evolve(schema, ops)
    out = P.run(df, ops, schema)
    return preview(out, 0, limit, order_by), transform_counts(df, ops, schema), child
