"""Rows in file order: pages and evenly spaced samples without a sort of the table.

A row of a Parquet scan has a stable address: its file and its index in the file.  The address
survives filters and projections, so the rows that are left still have an order.  ``chunk_starts``
counts them by chunks of ``CHUNK`` consecutive row indexes and sums the counts: first over the files,
then over the chunks of each file, never over rows.  A page or a set of positions then names the few
chunks that hold it, only those files are read again, and only rows of one chunk are ordered together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import col_of

CHUNK = 8192  # row indexes of a chunk; the most rows ordered together
FILE, ROW = "_row_file", "_row_index"


def with_address(df: DataFrame) -> DataFrame:
    """``df`` with the address of every row; ``df`` must be a scan of Parquet files."""
    return df.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def has_address(df: DataFrame) -> bool:
    """Whether the rows of ``df`` still know where they were read: projections and filters of a scan."""
    todo = [df._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        if node.nodeName() not in ("Project", "Filter", "SubqueryAlias") and node.children().size():
            return False
        todo += [node.children().apply(i) for i in range(node.children().size())]
    try:
        return FILE in df.columns or with_address(df).schema is not None
    except AnalysisException:
        return False


def addressed(df: DataFrame) -> DataFrame:
    return df if FILE in df.columns else with_address(df)


def _chunk() -> Column:
    return F.floor(F.col(ROW) / CHUNK)


def chunk_starts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, file, chunk, k, start, total) of the chunks that have rows; start counts the rows before.

    Files are ordered by path.  One row a chunk and group at most.
    """
    by = list(by)
    counts = df.groupBy(*(col_of(c) for c in by), FILE, _chunk().alias("_chunk")).agg(F.count(F.lit(1)).alias("_k"))
    files = counts.groupBy(*(col_of(c) for c in by), FILE).agg(F.sum("_k").alias("_fk"))
    group = [col_of(c) for c in by] or [F.lit(0)]
    # One row a file (and group) passes these windows.
    files = files.select(
        *(col_of(c).alias(f"_g{i}") for i, c in enumerate(by)), F.col(FILE).alias("_f"),
        (F.sum("_fk").over(Window.partitionBy(*group).orderBy(FILE)) - F.col("_fk")).alias("_base"),
        F.sum("_fk").over(Window.partitionBy(*group)).alias("_total"),
    )
    inside = Window.partitionBy(*(col_of(c) for c in by), FILE).orderBy("_chunk")
    counts = counts.withColumn("_within", F.sum("_k").over(inside) - F.col("_k"))
    same = [F.col(FILE) == F.col("_f")] + [col_of(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
    start = F.col("_base") + F.col("_within")
    return counts.join(files, same).select(*(col_of(c) for c in by), FILE, "_chunk", "_k", start.alias("_start"), "_total")


def page(df: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows ``offset .. offset + limit`` of ``df`` in file order; the address columns stay out.

    ``df`` is a scan of Parquet files or what filters and projections leave of one.  The page reads
    the chunks that overlap it, at most ``limit`` of them, and orders their rows only.
    """
    rows = addressed(df)
    starts = chunk_starts(rows).filter((F.col("_start") < offset + limit) & (F.col("_start") + F.col("_k") > offset))
    held = starts.select(FILE, "_chunk", "_start").orderBy("_start").limit(limit).collect()  # each holds a row of the page
    out = [col_of(c) for c in df.columns if c not in (FILE, ROW)]
    if not held:
        return rows.filter(F.lit(False)).select(*out)
    chunks = {}
    for r in held:
        chunks.setdefault(r[FILE], []).append(int(r["_chunk"]))
    wanted = None
    for path, numbers in chunks.items():
        some = (F.col(FILE) == path) & _chunk().between(min(numbers), max(numbers))
        wanted = some if wanted is None else wanted | some
    # The filter on the file prunes the scan to the named files.
    first = offset - int(held[0]["_start"])
    return rows.filter(wanted).orderBy(FILE, ROW).offset(first).limit(limit).select(*out)


def _positions_within(first: Column, last: Column, total: Column, count: int) -> Column:
    """Those of ``count`` evenly spaced positions of 0 .. total - 1 (both ends included, all positions of
    a smaller total) that lie in first .. last - 1."""
    step = (total - 1).cast("double") / F.lit(float(count - 1))
    # Candidates by inverting the formula, then the formula itself decides.
    low = F.greatest(F.floor(first / step) - 1, F.lit(0)).cast("int")
    high = F.least(F.ceil(last / step) + 1, F.lit(count - 1)).cast("int")
    at = F.transform(
        F.sequence(low, high),
        lambda j: F.when(j == count - 1, total - 1).otherwise(F.floor(j.cast("double") * step)).cast("bigint"),
    )
    spaced = F.filter(at, lambda p: (p >= first) & (p < last))
    return F.when(total > count, spaced).otherwise(F.sequence(first.cast("bigint"), (last - 1).cast("bigint")))


def systematic_rows(df: DataFrame, count: int, by: Sequence[str] = ()) -> DataFrame:
    """The rows of ``df`` at ``count`` evenly spaced positions in file order (all rows of a smaller group).

    ``by``: positions are taken within each group; their number times ``count`` rows come back.
    Only chunks that hold a position are ordered.
    """
    if count < 2:
        raise ValueError("a systematic sample needs two rows or more")
    by, rows = list(by), addressed(df)
    starts = chunk_starts(rows, by)
    first, last = F.col("_start"), F.col("_start") + F.col("_k")
    at = _positions_within(first, last, F.col("_total"), count)
    keys = [*(f"_s{i}" for i in range(len(by))), "_sf", "_sc"]
    picks = starts.select(
        *(col_of(c).alias(f"_s{i}") for i, c in enumerate(by)), F.col(FILE).alias("_sf"), F.col("_chunk").alias("_sc"),
        F.explode(F.transform(at, lambda p: p - first)).alias("_at"),
    )

    def same(left: Sequence[Column], right: Sequence[str]) -> list[Column]:
        return [a.eqNullSafe(F.col(b)) for a, b in zip(left, right)]

    here = [*(col_of(c) for c in by), F.col(FILE), _chunk()]
    touched = rows.join(picks.select(*keys).distinct(), same(here, keys))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(ROW)) - 1
    touched = touched.withColumn("_place", place.cast("bigint"))
    chosen = picks.select(*(F.col(k).alias(f"_p{k}") for k in keys), "_at")
    met = touched.join(chosen, [F.col("_place") == F.col("_at"), *same([F.col(k) for k in keys], [f"_p{k}" for k in keys])])
    return met.select(*(col_of(c) for c in df.columns if c not in (FILE, ROW)))
