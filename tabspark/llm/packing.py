"""Best-fit packing with large-item matching.

Documents become pieces of at most ``capacity`` tokens (only longer documents are cut).  Pieces
above a third of the capacity fit at most twice into a sequence, so they are matched greedily:
the longest with the longest partner that still fits.  Smaller pieces then best-fit the remaining
gaps, longest first, and open new sequences only where no gap holds them.

Both steps depend on lengths alone.  They run on the histogram of lengths -- at most ``capacity``
rows whatever the corpus size -- and yield slots: the pieces of one length with ranks lo..hi-1 go to
sequences base, base+1, ... at one offset.  Ranks are dealt out on Spark: rows are numbered inside
(length, bucket) groups of bounded size, plus the bucket's start.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col_of, saved
from .tokenize import default_path, tokens

CAPACITY = 1024
END_ID = 2
BUCKET_ROWS = 100_000  # rows numbered by one window group, about


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; only the first may be shorter."""
    first = n % capacity or capacity
    return [(0, min(n, first)), *((s, capacity) for s in range(first, n, capacity))]


def pieces(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    tokenizer: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the cut documents.

    A null or empty text is the end id alone.  Every text is tokenized whole.
    """
    path = tokenizer or default_path()
    rows = df.select(col_of(id_col).alias("doc_id"), col_of(text_col).cast("string").alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches):
        encode = tokens(path).ids
        for b in batches:
            owner, cells, ids_out = [], [], []
            for row, text in enumerate(b.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    owner.append(row)
                    cells.append((k, start, length, zlib.crc32(part.tobytes())))
                    if with_ids:
                        ids_out.append(part.astype(np.int32))
            piece, start, length, crc = (np.array(c, np.int64) for c in zip(*cells)) if cells else [np.zeros(0, np.int64)] * 4
            cols = [b.column(0).take(pa.array(owner, pa.int64())), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids_out, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, lo, hi, base, offset) that hold ``counts[length]`` pieces of each length.

    The piece of that length with rank r in lo..hi-1 stands in sequence base + r - lo at offset.
    Bins with equal contents are handled as one class, so the work depends on the capacity only.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("a piece is empty or longer than the capacity")
    gaps: list[int] = []  # sorted gaps that have classes
    classes: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    done: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def put(content: tuple[tuple[int, int], ...], n: int) -> None:
        gap = capacity - sum(size * k for size, k in content)
        if not gap:
            done.append((content, n))
            return
        if gap not in classes:
            classes[gap] = []
            insort(gaps, gap)
        classes[gap].append((content, n))

    def take(gap: int) -> tuple[tuple[tuple[int, int], ...], int]:
        got = classes[gap].pop()
        if not classes[gap]:
            del classes[gap]
            gaps.remove(gap)
        return got

    large = sorted(k for k in left if 3 * k > capacity)
    small = sorted(k for k in left if 3 * k <= capacity)
    for size in reversed(large):
        while left[size]:
            # the longest piece that fits beside this one; itself only if there are two
            at = bisect_left(large, min(size, capacity - size) + 1) - 1
            while at >= 0 and left[large[at]] < (2 if large[at] == size else 1):
                at -= 1
            if at < 0:
                put(((size, 1),), left[size])
                left[size] = 0
            elif large[at] == size:
                put(((size, 2),), left[size] // 2)
                left[size] %= 2
            else:
                n = min(left[size], left[large[at]])
                put(((size, 1), (large[at], 1)), n)
                left[size] -= n
                left[large[at]] -= n
    for size in reversed(small):
        while left[size]:
            at = bisect_left(gaps, size)
            gap = gaps[at] if at < len(gaps) else capacity
            content, n = take(gap) if at < len(gaps) else ((), left[size])
            per = gap // size
            full = min(n, left[size] // per)
            rest = left[size] - full * per if full < n else 0
            if full:
                put((*content, (size, per)), full)
            if 0 < rest < per:
                put((*content, (size, rest)), 1)
            else:
                rest = 0
            untouched = n - full - bool(rest)
            if untouched and content:
                put(content, untouched)
            left[size] -= full * per + rest
    slots, used, base = [], dict.fromkeys(counts, 0), 0
    for content, n in [*done, *(c for group in classes.values() for c in group)]:
        offset = 0
        for size, k in content:
            for _ in range(k):
                slots.append((size, used[size], used[size] + n, base, offset))
                used[size] += n
                offset += size
        base += n
    return slots


def assign(rows: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add sequence_id and offset to pieces (any columns, among them ``length``)."""
    spark = rows.sparkSession
    numbered = saved(rows.withColumn("_uid", F.monotonically_increasing_id()), "packing-pieces")
    counts = {r["length"]: r["count"] for r in numbered.groupBy("length").count().collect()}  # <= capacity rows
    slots = spark.createDataFrame(plan(counts, capacity), "_len long, _lo long, _hi long, _base long, offset long")
    n_buckets = 1 + sum(counts.values()) // bucket_rows
    keyed = numbered.withColumn("_bucket", F.pmod("_uid", F.lit(n_buckets)))
    sizes = keyed.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_uid")) - 1
    ranked = keyed.withColumn("_in", inside).join(starts, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_start") + F.col("_in"))
    # The slots depend on the capacity alone, not on the data's size.
    placed = ranked.join(
        F.broadcast(slots),
        (F.col("length") == F.col("_len")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")),
    )
    return placed.select(
        *(col_of(c) for c in rows.columns), (F.col("_base") + F.col("_rank") - F.col("_lo")).alias("sequence_id"), "offset"
    )


def pack(df: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, **options) -> DataFrame:
    """Cut, tokenize and place every row of ``df``: one row per piece.

    Null and empty texts give the end id alone, repeated rows and null ids are packed like any
    other, an empty table gives no rows.  Only the id and text columns are read.
    """
    return assign(pieces(df, capacity=capacity, with_ids=with_ids, **options), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence of pieces packed with their ids."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    return parts.select("sequence_id", F.flatten(F.col("_p").getField("ids")).alias("ids"))
