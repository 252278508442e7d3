"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a word of the
perfect binary [23, 12, 7] Golay code (the missing high bits are zero).  A word is decoded to the
indices of its nearby codewords: every codeword within distance 3, and within 4 when the nearest
one is at distance 3 (one or six indices).  Two words that differ in at most two bits always share
such an index.

Pigeonhole for at most four differing bits over three segments: either one segment agrees exactly
and one of the others differs in at most two bits -- key: that segment and a codeword index of the
other -- or two segments differ in one bit each, so a half of either agrees exactly, and the third
differs in at most two bits -- key: the two halves and a codeword index of the third.  Any linked
pair shares at least one key; keys have 33 or more bits, so unrelated fingerprints rarely meet.
Every candidate is verified on the full fingerprints.

Only distinct fingerprints take part, and no group is expanded into pairs:

1. each key's smallest fingerprint is compared with the key's other fingerprints (as many rows
   as keys), and the components of the verified links are found;
2. only keys with three or more fingerprints that still lie in different components can hide a
   further link; there every fingerprint outside the key's largest component is compared with
   those of other components, and only verified links leave the join;
3. the components of both link sets are the exact components of the full link graph.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col_of, saved, slices
from .components import components

SHINGLE = 4  # words per shingle (fixed by the contract)
MAX_BITS = 4  # differing bits that still link (fixed by the contract)
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # lowest bit, width
GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the binary Golay code
_CHUNK = 65_536  # shingles counted at once, bounds the memory of a long text


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a UTF-8 text over word shingles, repeats included."""
    words = data.lower().split() if data else []  # bytes: ASCII lower-case, ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    first, last = starts[:n].tolist(), ends[k - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for part in slices(n, _CHUNK):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(first[part], last[part])], ">u8")
        ones += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndrome of the high 12 bits, error patterns by syndrome, whether a pattern counts)."""
    unit = [1 << i for i in range(11)]
    for i in range(11, 23):
        s = unit[-1] << 1
        unit.append(s ^ GENERATOR if s & 0x800 else s)
    high = np.zeros(4096, np.int64)
    for i in range(12):
        high[np.arange(4096) >> i & 1 == 1] ^= unit[11 + i]
    patterns: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            s = 0
            for b in bits:
                s ^= unit[b]
            if weight < 4 or patterns[s][0].bit_count() == 3:
                patterns[s].append(sum(1 << b for b in bits))
    errors = np.array([p + [p[0]] * (6 - len(p)) for p in patterns], np.int64)
    valid = np.array([[True] * len(p) + [False] * (6 - len(p)) for p in patterns])
    return high, errors, valid


def nearby_codewords(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (n x 6) and which of them count."""
    high, errors, valid = _golay()
    syndrome = high[word >> 11] ^ (word & 0x7FF)
    return (word[:, None] ^ errors[syndrome]) >> 11, valid[syndrome]


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, positions in fps): the bucket keys of each fingerprint (uint64)."""
    seg = [(fps >> np.uint64(lo) & np.uint64((1 << w) - 1)).astype(np.int64) for lo, w in SEGMENTS]
    near = [nearby_codewords(s) for s in seg]
    keys, use = [], []

    def add(tag: int, key: np.ndarray, ok: np.ndarray) -> None:
        keys.append(key | tag << 40)
        use.append(np.broadcast_to(ok, key.shape))

    tag = 0
    for i in range(3):
        for j in range(3):
            if i != j:  # segment i agrees exactly, segment j differs in at most two bits
                add(tag, seg[i][:, None] << 12 | near[j][0], near[j][1])
                tag += 1
    halves = [(s & 0x7FF, s >> 11) for s in seg]
    for i, j, third in ((0, 1, 2), (0, 2, 1), (1, 2, 0)):
        for a in halves[i]:
            for b in halves[j]:  # a half of either agrees exactly, the third differs in at most two bits
                add(tag, (a << 23 | b << 12)[:, None] | near[third][0], near[third][1])
                tag += 1
    key, ok = np.concatenate(keys, axis=1), np.concatenate(use, axis=1)
    rows, cols = np.nonzero(ok)
    return key[rows, cols], rows


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long; a null text counts as empty."""
    rows = df.select(col_of(id_col).cast("long").alias("doc_id"), col_of(text_col).cast("binary").alias("_text"))

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, "doc_id long, fp long")


def _keys(fps: DataFrame) -> DataFrame:
    """(key, fp) of distinct fingerprints."""

    def run(batches):
        for b in batches:
            every = b.column(0).to_numpy().view(np.uint64)
            for part in slices(len(every), 8192):
                key, row = keys_of(every[part])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(every[part][row].view(np.int64))], names=["key", "fp"]
                )

    return fps.select("fp").mapInArrow(run, "key long, fp long")


def link_components(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root) for the distinct fingerprints ``fps`` that have a link; root is a fingerprint."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"max_bits must be 0..{MAX_BITS}: the segments are cut for {MAX_BITS}")
    close = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits
    keys = _keys(fps)
    shared = keys.groupBy("key").agg(F.min("fp").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # A fingerprint has about ninety keys, but Spark sizes the keys like the fingerprints: never a broadcast.
    buckets = saved(keys.join(shared.hint("merge"), "key"), "simhash-buckets")
    star = buckets.filter((F.col("fp") != F.col("lead")) & close("fp", "lead"))
    star = saved(star.select(F.col("fp").alias("a"), F.col("lead").alias("b")).distinct(), "simhash-star")
    first = components(star)

    # Pairs without the key's leader, in keys whose fingerprints lie in several components.
    own = buckets.filter("n > 2").select("key", "fp").join(first, F.col("fp") == F.col("v"), "left")
    own = own.select("key", "fp", F.coalesce("root", "fp").alias("comp"))
    sizes = own.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(
        F.max(F.struct("n", "comp")).getField("comp").alias("home"), F.count(F.lit(1)).alias("k")
    ).filter("k > 1").select("key", "home")
    open_rows = saved(own.join(mixed, "key"), "simhash-open")
    strays = open_rows.filter("comp <> home").select(
        F.col("key").alias("_key"), F.col("fp").alias("a"), F.col("comp").alias("_ca")
    )
    others = open_rows.select("key", F.col("fp").alias("b"), F.col("comp").alias("_cb"), "home")
    cross = strays.join(
        others,
        (F.col("_key") == F.col("key"))
        & (F.col("_ca") != F.col("_cb"))
        & ((F.col("_cb") == F.col("home")) | (F.col("a") < F.col("b")))
        & close("a", "b"),
    )
    # Contract to component labels before the second pass.
    links = saved(cross.select(F.col("_ca").alias("a"), F.col("_cb").alias("b")).distinct(), "simhash-cross")
    if links.isEmpty():
        return first.select(F.col("v").alias("fp"), "root")
    second = components(links).select(F.col("v").alias("_v"), F.col("root").alias("_r"))
    known = first.select("v", "root").union(
        second.join(first, F.col("_v") == F.col("v"), "left_anti").select(F.col("_v").alias("v"), F.col("_v").alias("root"))
    )
    merged = known.join(second, F.col("root") == F.col("_v"), "left")
    return saved(merged.select(F.col("v").alias("fp"), F.coalesce("_r", "root").alias("root")), "simhash-roots")


def _classes(docs: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root, least_id): the component and smallest document id of each distinct fingerprint."""
    fps = saved(docs.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-fps")
    roots = link_components(fps, max_bits).withColumnRenamed("fp", "_fp")
    return fps.join(roots, F.col("fp") == F.col("_fp"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id", F.col("root").isNotNull().alias("linked"))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row per row of ``df``: doc_id, fp (signed long), component_id (smallest id reachable).

    Null and blank texts have fingerprint zero and link like any other; texts shorter than a
    shingle are one shingle.  Repeated rows stay and share a component.  A null id stays null and
    never names a component unless all its members are null.  An empty table gives no rows.  Only
    the id and the text are read, so further columns may have any name.
    """
    docs = saved(fingerprints(df, id_col, text_col, shingle), "simhash-docs")
    classes = saved(_classes(docs, max_bits), "simhash-classes")
    least = classes.filter("linked").groupBy("root").agg(F.min("least_id").alias("cid"))
    names = classes.join(least, "root", "left").select("fp", F.coalesce("cid", "least_id").alias("component_id"))
    return docs.join(names, "fp").select("doc_id", "fp", "component_id")


def deduplicate(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """The rows of ``df`` (all columns) that stay: one of each component, that with the smallest id.

    Rows with a null id stay only where no row of the component has an id.  Of rows with the same id
    and text that stays whose columns come first as JSON text.  Columns may have any names; ids are
    integers.
    """
    text_hash = F.xxhash64(col_of(text_col).cast("string"))
    rows = df.select(col_of(id_col).cast("long").alias("doc_id"), text_hash.alias("text_hash"), col_of(text_col).cast("binary").alias("_text"))

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    docs = saved(rows.mapInArrow(run, "doc_id long, text_hash long, fp long"), "simhash-docs")
    classes = _classes(docs, max_bits).select("fp", "root")
    # Copies shrink to their best row before they meet the rest of their component.
    one = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    best = docs.groupBy("fp").agg(F.min(one).alias("m")).join(classes, "fp").groupBy("root").agg(F.min("m").alias("m"))
    keep = best.select(F.col("m.doc_id").alias("_keep_id"), F.col("m.text_hash").alias("_keep_hash"))
    repeated = docs.groupBy("doc_id", "text_hash").count().filter("count > 1").select(F.col("doc_id").alias("_rep_id"), F.col("text_hash").alias("_rep_hash"))
    repeated = repeated.withColumn("_repeated", F.lit(True))
    keep = keep.join(repeated, F.col("_keep_id").eqNullSafe(F.col("_rep_id")) & (F.col("_keep_hash") == F.col("_rep_hash")), "left")
    keep = saved(keep.select("_keep_id", "_keep_hash", F.coalesce("_repeated", F.lit(False)).alias("_repeated")), "simhash-keep")
    # The caller's columns travel in one struct, so they may have any names.
    packed = df.select(F.struct("*").alias("row"), col_of(id_col).cast("long").alias("id"), text_hash.alias("hash"))
    same = F.col("id").eqNullSafe(F.col("_keep_id")) & (F.col("hash") == F.col("_keep_hash"))
    single = packed.join(keep.filter(~F.col("_repeated")), same, "left_semi").select("row.*")
    several = packed.join(keep.filter("_repeated"), same, "left_semi").groupBy("id", "hash")
    return single.union(several.agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))


def hex_fingerprint(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
