"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

Every benchmark item becomes windows of ``window`` consecutive words (a shorter item is one window).
A window is the set of its word shingles with their positions.  Exact containment needs all of
them, so one necessary prefix token is enough: the shingle that is rarest in the corpus.

One pass over the texts splits and hashes them, counts their words and keeps the places of benchmark
shingles (through a bitmap of fixed size, then an exact join).  Rarity and the prefix join work on
these places only: windows whose rarest shingle never occurs drop out, the others meet documents on
that shingle and pass the length and positional bounds.  Only documents with a candidate are read
again, and their words at the candidate places are compared with the window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bitmap, col_of, in_bitmap, kept_rows, saved, words_col

WINDOW = 10  # words (fixed by the contract)
SHINGLE = 4  # words of a prefix token


def _hashed(hashes: Column, n: Column, k: int, row: Callable[[Column, Column], Column]) -> Column:
    """``row(position, hash)`` of every k-word shingle of n >= k word hashes."""
    return F.transform(F.sequence(F.lit(0), n - k), lambda i: row(i, F.xxhash64(*(F.get(hashes, i + j) for j in range(k)))))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(wid, words, len) of the distinct windows and (wid, item_id) of the items that hold them."""
    rows = items.select(col_of(id_col).alias("item_id"), words_col(col_of(text_col).cast("string")).alias("w"))
    n = F.size("w")
    cut = F.when(
        n >= window, F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.slice("w", i, F.lit(window)))
    ).otherwise(F.array(F.col("w")))
    every = saved(rows.filter(n > 0).select("item_id", F.explode(cut).alias("words")).distinct(), "item-windows")
    windows = every.select("words").distinct()
    windows = saved(
        windows.select(F.monotonically_increasing_id().alias("wid"), "words", F.size("words").alias("len")), "windows"
    )
    owners = every.join(windows, "words").select("wid", "item_id").distinct()
    return windows, saved(owners, "window-items")


def _scan(docs: DataFrame, id_col: str, text_col: str, lengths: list[int], bits: Column) -> DataFrame:
    """(doc_id, text_hash, n_words, maybe): the places (k, pos, sh) of shingles that may be the benchmark's."""
    text = col_of(text_col).cast("string")
    words = docs.select(col_of(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.transform(words_col(text), lambda w: F.xxhash64(w)).alias("wh"))
    n, hashes = F.size("wh"), F.col("wh")
    maybe = F.array().cast("array<struct<k:int,pos:int,sh:bigint>>")
    for k in lengths:
        places = _hashed(hashes, n, k, lambda i, sh, k=k: F.struct(F.lit(k).alias("k"), i.alias("pos"), sh.alias("sh")))
        hits = F.filter(places, lambda s: in_bitmap(bits, s.getField("sh")))
        maybe = F.concat(maybe, F.when(n >= k, hits).otherwise(F.array().cast("array<struct<k:int,pos:int,sh:bigint>>")))
    return saved(words.select("doc_id", "text_hash", n.cast("long").alias("n_words"), maybe.alias("maybe")), "decontaminate-scan")


def _occurrences(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scan, occurrences, owners), see ``occurrences``; scan has doc_id, text_hash, n_words of every row."""
    windows, owners = item_windows(items, item_col, item_text_col, window)
    k_of = F.least(F.col("len"), F.lit(shingle))
    lengths = sorted(r[0] for r in windows.select(k_of).distinct().collect())  # at most ``shingle`` of them
    of_k = windows.select("wid", "len", k_of.alias("k"), F.transform("words", lambda w: F.xxhash64(w)).alias("wh"))
    cut = F.array().cast("array<struct<off:int,sh:bigint>>")
    for k in lengths:
        one = _hashed(F.col("wh"), F.col("len"), k, lambda i, sh: F.struct(i.alias("off"), sh.alias("sh")))
        cut = F.when(F.col("k") == k, one).otherwise(cut)
    tokens = saved(of_k.select("wid", "len", "k", F.explode(cut).alias("t")).select("wid", "len", "k", "t.off", "t.sh"), "shingles")
    scan = _scan(docs, id_col, text_col, lengths, bitmap(tokens.select("sh").distinct()))
    places = scan.select("doc_id", "text_hash", "n_words", F.explode("maybe").alias("m")).select("doc_id", "text_hash", "n_words", "m.*")
    counts = places.groupBy("k", "sh").agg(F.count(F.lit(1)).alias("n"))
    # The rarest shingle of each window; a window with an unseen shingle occurs nowhere.
    ranked = tokens.join(counts, ["k", "sh"], "left").select("wid", "len", "k", "off", "sh", F.coalesce("n", F.lit(0)).alias("n"))
    prefix = ranked.groupBy("wid", "len", "k").agg(F.min(F.struct("n", "sh", "off")).alias("p")).filter("p.n > 0")
    prefix = saved(prefix.select("wid", "len", "k", "p.sh", "p.off"), "window-prefixes")
    start = F.col("pos") - F.col("off")
    met = places.join(prefix, ["k", "sh"]).filter((start >= 0) & (start + F.col("len") <= F.col("n_words")))
    met = saved(met.select("doc_id", "text_hash", "wid", "len", start.alias("start")).distinct(), "candidates")

    # The words at the candidate places, from the texts of documents that have any.
    keys = met.groupBy(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h")).agg(F.collect_set(F.struct("start", "len")).alias("at"))
    keys = saved(keys, "candidate-documents")  # a document has no more places than words and lengths
    seen = bitmap(keys.select(F.xxhash64("_d", "_h")))
    text = col_of(text_col).cast("string")
    again = docs.select(col_of(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    again = again.filter(in_bitmap(seen, F.xxhash64("doc_id", "text_hash")))
    again = again.join(keys, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")))
    again = again.select("doc_id", "text_hash", words_col(F.col("text")).alias("w"), "at")
    slices = F.transform("at", lambda p: F.struct(p.getField("start").alias("start"), F.slice("w", p.getField("start") + 1, p.getField("len")).alias("words")))
    shown = again.select("doc_id", "text_hash", F.explode(slices).alias("p")).select("doc_id", "text_hash", "p.start", F.col("p.words").alias("seen"))
    shown = shown.distinct().withColumnsRenamed({"doc_id": "_d", "text_hash": "_h", "start": "_s"})
    cases = met.join(windows.select("wid", "words"), "wid")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")) & (F.col("start") == F.col("_s")) & (F.col("words") == F.col("seen"))
    found = cases.join(shown, same).select("doc_id", "text_hash", "start", "len", "wid")
    return scan, saved(found, "occurrences"), owners


def occurrences(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[DataFrame, DataFrame]:
    """((doc_id, text_hash, start, len, wid), (wid, item_id)): where benchmark windows occur.

    ``start`` counts words from 0.  Repeated documents (same id and text) are one document here.
    """
    return _occurrences(docs, items, id_col, text_col, **options)[1:]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or wordless text has no words and no hits.  Items without words have no windows; an item
    with a null id still marks words but is not counted or listed.  Repeated rows stay, ids may be
    null, either table may be empty, and only the named columns are read.
    """
    scan, occ, owners = _occurrences(docs, items, id_col, text_col, **options)
    key = ["doc_id", "text_hash"]
    words = occ.select(*key, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("pos"))
    n_hit = words.distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_hit"))
    listed = occ.select(*key, "wid").distinct().join(owners, "wid").filter("item_id is not null")
    listed = listed.select(*key, F.col("item_id").cast("string").alias("item")).distinct()
    names = listed.groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("names"))
    hit = n_hit.join(names.withColumnsRenamed({"doc_id": "_d", "text_hash": "_h"}), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")), "left")
    hit = hit.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "n_hit", "names")
    rows = scan.select("doc_id", "text_hash", "n_words")
    out = rows.join(hit, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")), "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` (all columns) in which no benchmark window occurs."""
    occ, _ = occurrences(docs, items, id_col, text_col, **options)
    bad = occ.select("doc_id", "text_hash").distinct()
    return kept_rows(docs, [col_of(id_col), F.xxhash64(col_of(text_col).cast("string"))], bad, "left_anti")
