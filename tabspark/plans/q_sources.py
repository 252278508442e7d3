"""Source / sink queries: ingest, manifest, versioned apply, lineage, export, saved results.

Each query writes into a fresh folder under the session's shared
checkpoint folder and reads the written data back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import explore as X
from ..operators import prepare as P
from ..schema import DatasetSchema
from ..session import work_dir
from ..sources.ingest import export_csv, normalize_types, read_source
from ..sources.versions import Catalog
from .inputs import table
from .registry import register

ORDERS_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def _orders_csv(spark, d) -> str:
    path = work_dir(spark, "orders-csv") + "/orders.csv"
    export_csv(table(spark, d, "orders"), path)
    return path


@register("ingest_parquet", f"SELECT {ORDERS_COLS} FROM orders")
def ingest_parquet(spark, d):
    cat = Catalog(spark, work_dir(spark, "catalog"))
    vid = cat.ingest(f"{d}/orders.parquet", "orders")
    df, _ = cat.read(vid)
    return df


@register("ingest_csv", f"SELECT {ORDERS_COLS} FROM orders")
def ingest_csv(spark, d):
    cat = Catalog(spark, work_dir(spark, "catalog"))
    vid = cat.ingest(_orders_csv(spark, d), "orders_csv", fmt="csv")
    df, _ = cat.read(vid)
    return df


def _orders_dialect(spark, d, name: str, **options) -> str:
    """Orders as a CSV of another dialect."""
    path = work_dir(spark, name) + "/orders.csv"
    options = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss", "escape": '"', **options}
    table(spark, d, "orders").select(*ORDERS_COLS.split(", ")).write.options(**options).csv(path)
    return path


def _ingested(spark, path: str):
    cat = Catalog(spark, work_dir(spark, "catalog"))
    return cat.read(cat.ingest(path, "orders_csv", fmt="csv"))[0]


@register("ingest_csv_semicolon", f"SELECT {ORDERS_COLS} FROM orders")
def ingest_csv_semicolon(spark, d):
    """The delimiter is found, every field quoted in single quotes."""
    return _ingested(spark, _orders_dialect(spark, d, "semicolon", header=True, delimiter=";", quote="'", escape="'", quoteAll=True))


@register("ingest_csv_tab", f"SELECT {ORDERS_COLS} FROM orders")
def ingest_csv_tab(spark, d):
    return _ingested(spark, _orders_dialect(spark, d, "tab", header=True, delimiter="\t"))


@register(
    "ingest_csv_headerless",
    "SELECT o_orderkey AS column0, o_custkey AS column1, o_orderstatus AS column2, o_totalprice AS column3, "
    "o_orderdate AS column4, o_orderpriority AS column5 FROM orders",
)
def ingest_csv_headerless(spark, d):
    return _ingested(spark, _orders_dialect(spark, d, "headerless", header=False, delimiter="|"))


@register("ingest_csv_line_breaks", "SELECT doc_id, text FROM documents")
def ingest_csv_line_breaks(spark, d):
    """Quoted line breaks are found from the head."""
    path = work_dir(spark, "breaks") + "/documents.csv"
    export_csv(table(spark, d, "documents").select("doc_id", "text"), path)
    return _ingested(spark, path)


@register(
    "ingest_manifest",
    "SELECT 'csv' AS source_format, 'parquet' AS canonical_format, COUNT(*) AS row_count, 6 AS column_count FROM orders",
)
def ingest_manifest(spark, d):
    cat = Catalog(spark, work_dir(spark, "catalog"))
    vid = cat.ingest(_orders_csv(spark, d), "orders_csv", fmt="csv")
    return cat.versions().where(F.col("version_id") == vid).select(
        F.get_json_object("operation", "$.source_format").alias("source_format"),
        F.get_json_object("operation", "$.canonical_format").alias("canonical_format"),
        "row_count",
        F.size(F.from_json("schema_json", "array<string>")).alias("column_count"),
    )


@register(
    "schema_types",
    "SELECT * FROM (VALUES (0, 'o_orderkey', 'integer'), (1, 'o_custkey', 'integer'), (2, 'o_orderstatus', 'string'), "
    "(3, 'o_totalprice', 'float'), (4, 'o_orderdate', 'datetime'), (5, 'o_orderpriority', 'string')) "
    "v(position, physical_name, data_type) WHERE (SELECT COUNT(*) FROM orders) >= 0",
)
def schema_types(spark, d):
    cat = Catalog(spark, work_dir(spark, "catalog"))
    vid = cat.ingest(_orders_csv(spark, d), "orders_csv", fmt="csv")
    _, schema = cat.read(vid)
    return schema.to_frame(spark).select("position", "physical_name", "data_type")


@register("apply_version", f"SELECT {ORDERS_COLS} FROM orders WHERE o_orderstatus = 'F'")
def apply_version(spark, d):
    cat = Catalog(spark, work_dir(spark, "catalog"))
    vid = cat.ingest(f"{d}/orders.parquet", "orders")
    _, schema = cat.read(vid)
    child = cat.apply(vid, P.Filter(schema.resolve("o_orderstatus").column_id, "eq", "F"))
    again = cat.apply(vid, P.Filter(schema.resolve("o_orderstatus").column_id, "eq", "F"))
    assert again == child, "apply must be idempotent"
    df, _ = cat.read(child)
    return df


@register(
    "lineage_history",
    "WITH f AS (SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus = 'F') "
    "SELECT version_number, op, n AS row_count, depth FROM (VALUES (2, 'Filter', 2), (3, 'DropColumns', 1), "
    "(4, 'Rename', 0)) v(version_number, op, depth), f",
)
def lineage_history(spark, d):
    cat = Catalog(spark, work_dir(spark, "catalog"))
    v1 = cat.ingest(f"{d}/orders.parquet", "orders")
    _, s = cat.read(v1)
    v2 = cat.apply(v1, P.Filter(s.resolve("o_orderstatus").column_id, "eq", "F"))
    v3 = cat.apply(v2, P.DropColumns((s.resolve("o_orderpriority").column_id,)))
    v4 = cat.apply(v3, P.Rename(s.resolve("o_totalprice").column_id, "total_price"))
    hist = cat.history(v4)
    return hist.select(
        "version_number", F.get_json_object("operation", "$.type").alias("op"), "row_count", "depth"
    )


@register(
    "export_csv",
    "SELECT event_id, ts, user_id AS \"user.id\", event_type, value FROM events",
)
def export_csv_roundtrip(spark, d):
    """Timestamps with microseconds and a dotted column name."""
    df = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    base = DatasetSchema.of(df)
    ops = [P.Rename("col_user_id", "user.id")]
    path = work_dir(spark, "export") + "/events.csv"
    export_csv(P.run(df, ops, base), path, P.evolve(base, ops))
    return normalize_types(read_source(spark, path, "csv"))


@register("export_csv_text", "SELECT doc_id, text FROM documents")
def export_csv_text(spark, d):
    """Texts with quotes, line breaks and spaces at either end."""
    path = work_dir(spark, "export") + "/documents.csv"
    export_csv(table(spark, d, "documents").select("doc_id", "text"), path)
    return normalize_types(read_source(spark, path, "csv", multi_line=True))


@register(
    "saved_results",
    "SELECT 'analysis' AS kind, 'flags' AS title, l_returnflag AS value, COUNT(*) AS count FROM lineitem GROUP BY 3",
)
def saved_results(spark, d):
    cat = Catalog(spark, work_dir(spark, "catalog"))
    vid = cat.ingest(f"{d}/lineitem.parquet", "lineitem")
    df, schema = cat.read(vid)
    payload = X.frequencies(df, "l_returnflag", schema=schema)
    first = cat.save_result(vid, "analysis", "flags", {"column": "l_returnflag"}, payload)
    second = cat.save_result(vid, "analysis", "flags", {"column": "l_returnflag"}, payload)
    assert first == second, "a repeated save returns the saved result"
    saved = cat.list_results(vid).select("kind", "title")
    return saved.join(F.broadcast(cat.result_payload(first)).select("value", "count"))  # one result row


@register("export_parquet", f"SELECT {ORDERS_COLS} FROM orders WHERE o_orderpriority = '1-URGENT'")
def export_parquet(spark, d):
    from ..sources.ingest import export_parquet as export

    cat = Catalog(spark, work_dir(spark, "catalog"))
    vid = cat.ingest(f"{d}/orders.parquet", "orders")
    _, s = cat.read(vid)
    child = cat.apply(vid, P.Filter(s.resolve("o_orderpriority").column_id, "eq", "1-URGENT"))
    return spark.read.parquet(export(cat.data_path(child)))
