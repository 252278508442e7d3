"""Prepare DSL queries (filters, drop, fill, rename, select, cast, dedup, pages)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prepare as P
from ..schema import DatasetSchema
from .inputs import (
    EVENTS_NULLED_SQL,
    LINEITEM_FLAGS_SQL,
    LINEITEM_NULLED_SQL,
    events_nulled,
    lineitem_flags,
    lineitem_nulled,
    table,
)
from .registry import register

LI_COLS = (
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
    "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
)
LN_COLS = (
    "l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus, l_shipdate"
)


def _ops(df, *ops):
    return P.run(df, list(ops), DatasetSchema.of(df))


# -- filters -------------------------------------------------------------
@register("filter_eq", f"SELECT {LI_COLS} FROM lineitem WHERE l_returnflag = 'R'")
def filter_eq(spark, d):
    return _ops(table(spark, d, "lineitem"), P.Filter("col_l_returnflag", "eq", "R"))


@register("filter_neq", f"SELECT {LN_COLS} FROM {LINEITEM_NULLED_SQL} t WHERE l_quantity <> 10")
def filter_neq(spark, d):
    return _ops(lineitem_nulled(spark, d), P.Filter("col_l_quantity", "neq", 10))


@register("filter_gt", f"SELECT {LI_COLS} FROM lineitem WHERE l_extendedprice > 50000")
def filter_gt(spark, d):
    return _ops(table(spark, d, "lineitem"), P.Filter("col_l_extendedprice", "gt", 50000))


@register("filter_gte", f"SELECT {LI_COLS} FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00'")
def filter_gte(spark, d):
    return _ops(table(spark, d, "lineitem"), P.Filter("col_l_shipdate", "gte", "1998-01-01"))


@register("filter_lt", f"SELECT {LI_COLS} FROM lineitem WHERE l_discount < 0.03")
def filter_lt(spark, d):
    return _ops(table(spark, d, "lineitem"), P.Filter("col_l_discount", "lt", 0.03))


@register(
    "filter_lte",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority "
    "FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30 00:00:00'",
)
def filter_lte(spark, d):
    return _ops(table(spark, d, "orders"), P.Filter("col_o_orderdate", "lte", "1996-06-30"))


@register("filter_is_null", f"SELECT {LN_COLS} FROM {LINEITEM_NULLED_SQL} t WHERE l_quantity IS NULL")
def filter_is_null(spark, d):
    return _ops(lineitem_nulled(spark, d), P.Filter("col_l_quantity", "is_null"))


@register(
    "filter_not_null",
    f"SELECT event_id, ts, user_id, event_type, value FROM {EVENTS_NULLED_SQL} t WHERE event_type IS NOT NULL",
)
def filter_not_null(spark, d):
    return _ops(events_nulled(spark, d), P.Filter("col_event_type", "not_null"))


@register("filter_string_literal", f"SELECT {LI_COLS} FROM lineitem WHERE l_returnflag = 'x'' OR TRUE --'")
def filter_string_literal(spark, d):
    # A hostile literal is a value, never SQL text: it matches nothing.
    return _ops(table(spark, d, "lineitem"), P.Filter("col_l_returnflag", "eq", "x' OR TRUE --"))


# -- columns ---------------------------------------------------------------
@register(
    "drop_columns",
    "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus, l_shipdate FROM lineitem",
)
def drop_columns(spark, d):
    return _ops(table(spark, d, "lineitem"), P.DropColumns(("col_l_partkey", "col_l_suppkey")))


@register(
    "fill_null",
    "SELECT l_orderkey, l_linenumber, COALESCE(l_quantity, 0) AS l_quantity, l_extendedprice, l_discount, "
    f"l_tax, l_returnflag, l_linestatus, l_shipdate FROM {LINEITEM_NULLED_SQL} t",
)
def fill_null(spark, d):
    return _ops(lineitem_nulled(spark, d), P.FillNull("col_l_quantity", 0))


@register(
    "fill_null_text",
    f"SELECT event_id, ts, user_id, COALESCE(event_type, 'Unknown') AS event_type, value FROM {EVENTS_NULLED_SQL} t",
)
def fill_null_text(spark, d):
    return _ops(events_nulled(spark, d), P.FillNull("col_event_type", "Unknown"))


@register(
    "rename_column",
    "SELECT o_orderkey, o_custkey, o_orderstatus AS status, o_totalprice, o_orderdate, o_orderpriority FROM orders",
)
def rename_column(spark, d):
    return _ops(table(spark, d, "orders"), P.Rename("col_o_orderstatus", "status"))


@register("select_columns", "SELECT o_totalprice, o_orderkey FROM orders")
def select_columns(spark, d):
    df = table(spark, d, "orders")
    return P.run(df, [], DatasetSchema.of(df), select=["col_o_totalprice", "col_o_orderkey"])


@register(
    "deduplicate",
    f"SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM {LINEITEM_FLAGS_SQL} t",
)
def deduplicate(spark, d):
    df = lineitem_flags(spark, d)
    return _ops(df, P.DropColumns(("col_l_discount",)), P.Deduplicate())


@register(
    "prepare_chain",
    "SELECT DISTINCT l_returnflag AS flag, l_linestatus, COALESCE(l_quantity, -1.0) AS l_quantity "
    f"FROM {LINEITEM_FLAGS_SQL} t WHERE l_discount >= 0.05",
)
def prepare_chain(spark, d):
    df = lineitem_flags(spark, d)
    return _ops(
        df,
        P.Filter("col_l_discount", "gte", 0.05, operation_id="f"),
        P.FillNull("col_l_quantity", -1.0, operation_id="fill"),
        P.DropColumns(("col_l_discount",), operation_id="drop"),
        P.Deduplicate(operation_id="dedup"),
        P.Rename("col_l_returnflag", "flag", operation_id="rename"),
    )


# -- casts -----------------------------------------------------------------
def _half(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 2).alias("half"))


@register(
    "cast_integer",
    "SELECT l_orderkey, l_linenumber, CAST(l_quantity / 2 AS BIGINT) AS half FROM lineitem",
)
def cast_integer(spark, d):
    return _ops(_half(spark, d), P.Cast("col_half", "integer"))


@register(
    "cast_integer_text",
    "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity / 2 AS VARCHAR) AS BIGINT) AS half FROM lineitem",
)
def cast_integer_text(spark, d):
    df = _half(spark, d)
    return _ops(df, P.Cast("col_half", "string"), P.Cast("col_half", "integer", operation_id="c2"))


@register(
    "cast_float",
    "SELECT l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber FROM lineitem",
)
def cast_float(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return _ops(df, P.Cast("col_l_linenumber", "float"))


@register(
    "cast_string",
    "SELECT l_orderkey, l_linenumber, CAST(l_discount AS VARCHAR) AS l_discount FROM lineitem",
)
def cast_string(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return _ops(df, P.Cast("col_l_discount", "string"))


@register(
    "cast_boolean",
    "SELECT l_orderkey, l_linenumber, CAST(l_discount AS BOOLEAN) AS l_discount FROM lineitem",
)
def cast_boolean(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return _ops(df, P.Cast("col_l_discount", "boolean"))


@register(
    "cast_date",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders",
)
def cast_date(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return _ops(df, P.Cast("col_o_orderdate", "date"))


@register(
    "cast_datetime",
    "SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS TIMESTAMP) AS o_orderdate FROM orders",
)
def cast_datetime(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return _ops(
        df,
        P.Cast("col_o_orderdate", "date"),
        P.Cast("col_o_orderdate", "string", operation_id="s"),
        P.Cast("col_o_orderdate", "datetime", operation_id="t"),
    )


# -- pages -------------------------------------------------------------------
@register(
    "preview_page",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority "
    "FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100",
)
def preview_page(spark, d):
    df = table(spark, d, "orders")
    return P.run(df, [], DatasetSchema.of(df), order_by=["col_o_orderkey"], limit=50, offset=100)


@register(
    "preview_file_order",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders LIMIT 50 OFFSET 7000",
)
def preview_file_order(spark, d):
    """A deep page without an order key."""
    from ..operators.preview import preview

    return preview(table(spark, d, "orders"), offset=7000, limit=50)


@register(
    "prepared_file_order",
    "SELECT l_orderkey, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS l_quantity FROM "
    "(SELECT *, row_number() OVER () AS rn FROM lineitem) WHERE l_quantity > 25 ORDER BY rn LIMIT 200 OFFSET 12345",
)
def prepared_file_order(spark, d):
    """The rows that a filter leaves keep their places through casts and renames."""
    df = table(spark, d, "lineitem")
    ops = [P.Filter("col_l_quantity", "gt", 25), P.Rename("col_l_linenumber", "line"), P.Cast("col_l_quantity", "integer")]
    return P.run(df, ops, DatasetSchema.of(df), select=["col_l_orderkey", "col_l_linenumber", "col_l_quantity"], limit=200, offset=12345)


@register(
    "prepared_preview_page",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' "
    "ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5",
)
def prepared_preview_page(spark, d):
    from ..operators.preview import preview

    df = table(spark, d, "orders")
    out = P.run(df, [P.Filter("col_o_orderstatus", "eq", "F")], DatasetSchema.of(df),
                select=["col_o_orderkey", "col_o_totalprice"])
    return preview(out, offset=5, limit=20, order_by=[("o_totalprice", "desc"), "o_orderkey"])


@register(
    "transform_preview_counts",
    "SELECT CAST((SELECT COUNT(*) FROM lineitem) AS BIGINT) AS input_rows, "
    "CAST((SELECT COUNT(*) FROM lineitem WHERE l_extendedprice > 50000) AS BIGINT) AS output_rows",
)
def transform_preview_counts(spark, d):
    from ..operators.preview import transform_counts

    df = table(spark, d, "lineitem")
    return transform_counts(df, [P.Filter("col_l_extendedprice", "gt", 50000)])


@register(
    "transform_preview_rows",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders "
    "WHERE o_totalprice > 200000 ORDER BY o_orderkey LIMIT 50",
)
def transform_preview_rows(spark, d):
    from ..operators.preview import transform_preview

    df = table(spark, d, "orders")
    rows, _counts, _schema = transform_preview(
        df, [P.Filter("col_o_totalprice", "gt", 200000)], DatasetSchema.of(df), limit=50, order_by=["o_orderkey"]
    )
    return rows
