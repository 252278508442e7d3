"""MinHash near-duplicates by an inverted join on signature coordinates.

A text is the set of its distinct word shingles, its signature the least element of the set under each
of ``COORDS`` orders.  Texts with one set are one vertex.  A vertex is posted under its coordinates
and their values; two sets of similarity 0.85 or more agree in ``MATCHES`` of the 64 coordinates at least,
but for a chance below 2e-8 (binomial tail at exactly 0.85, less above).

A posting's value is that of ``WIDTH`` neighbouring coordinates together, so texts that have a passage
in common seldom share a list: two sets of similarity 0.85 share SHARED of the 32 lists at least, but
for a chance below 2e-8 too.  Counting collisions with prefix and skip merging: a vertex with fewer
than SHARED shared postings has no partner.  Of the others only the rarest lists are merged -- all but
the SHARED - 1 longest, one of which any partner must share -- and the longest lists are skipped.
Pairs of too different sizes or fewer than MATCHES equal coordinates drop out, the rest is confirmed
on the full sets.

No group is expanded into pairs.  Each vertex first meets one vertex only, the most central one of
most of its merged lists; the verified links give components.  Of lists that still hold several
components the vertices travel with short signatures, one row a list: a task compares those of a list
(longer ones in tiles of ``BLOCK`` vertices, those outside the list's largest component with all others).
A pair is looked at in the first list that both are in.  The full sets of vertices with a likely partner
follow, pairs that are already connected are skipped, and only the links that connect something are emitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col_of, saved, slices
from .components import components

SHINGLE = 5  # words (fixed by the contract)
PERCENT = 85  # similarity that links, in percent (fixed by the contract)
COORDS, MATCHES = 64, 34
WIDTH, SHARED = 2, 8  # coordinates of a list; lists that linked vertices share at least
BLOCK = 256  # vertices of a tile, about
_SHORT = 0x7FFFFFFF  # bits of a coordinate that lists and short signatures have
STAR = 1000  # vertices compared with one copy of a central vertex
SEED = 42
BITS = 1 << 22  # of the bitmap of wanted texts
_CACHE = 500_000  # word hashes kept in a task
_CHUNK = 4096  # shingles mapped at once, bounds the memory of a long text
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_DRAWN = np.random.default_rng(SEED)
_A = _DRAWN.integers(0, 1 << 31, COORDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _DRAWN.integers(0, 1 << 32, COORDS, dtype=np.uint32)
_TAG = _DRAWN.integers(0, 1 << 63, COORDS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sets of 64-bit shingle hashes; the hashes of frequent words are kept."""

    def __init__(self, shingle: int = SHINGLE):
        self.shingle, self.known = shingle, {}

    def set_of(self, data: bytes | None) -> np.ndarray:
        """The distinct shingles of a UTF-8 text, ascending; a shorter text is one shingle."""
        words = data.lower().split() if data else []  # bytes: ASCII lower-case, ASCII white space
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > _CACHE:
            self.known.clear()
        known, digest = self.known, xxhash.xxh64_intdigest
        for w in set(words).difference(known):
            known[w] = digest(w, SEED)
        hashes = np.array([known[w] for w in words], np.uint64)
        k = min(self.shingle, len(words))
        n = len(words) - k + 1
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out = out * _ODD + hashes[j : j + n]
        return np.unique(_mixed(out))


def signature(elements: np.ndarray) -> np.ndarray:
    """One 64-bit value a coordinate: its least element, named after the coordinate."""
    best, at = np.full(COORDS, 1 << 32, np.uint64), np.zeros(COORDS, np.uint64)
    for part in slices(len(elements), _CHUNK):
        ranks = (elements[part] >> np.uint64(32)).astype(np.uint32)[None, :] * _A[:, None] + _B[:, None]
        least = ranks.argmin(axis=1)
        value = ranks[np.arange(COORDS), least]
        better = value < best
        best[better], at[better] = value[better], elements[part][least[better]]
    return _mixed(at ^ _TAG)


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = col_of(text_col).cast("string")
    return df.select(col_of(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))


def signatures(df: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, n, sid, sig): set size, digest and signature of every text.

    sid and sig are null for texts without words.
    """
    rows = _rows(df, id_col, text_col)

    def run(batches):
        shingler = Shingler(shingle)
        for b in batches:
            for part in slices(b.num_rows, 512):
                sets = [shingler.set_of(t.as_py()) for t in b.column(2)[part.start : part.stop]]
                empty = np.array([len(s) == 0 for s in sets])
                sids = pa.array([None if e else xxhash.xxh3_128_digest(s.tobytes()) for s, e in zip(sets, empty)], pa.binary())
                sigs = pa.array([None if e else signature(s).view(np.int64) for s, e in zip(sets, empty)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[part.start : part.stop], b.column(1)[part.start : part.stop], pa.array([len(s) for s in sets], pa.int64()), sids, sigs],
                    names=["doc_id", "text_hash", "n", "sid", "sig"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n long, sid binary, sig array<long>")


def _bitmap(keys: DataFrame) -> np.ndarray:
    """The key hashes (id, hash) as BITS bits, whatever their number: at most BITS / 64 rows."""
    h = F.pmod(F.xxhash64("_id", "_hash"), F.lit(BITS))
    rows = keys.select(h.alias("h")).selectExpr("shiftright(h, 6) AS at", "shiftleft(1L, cast(h % 64 AS int)) AS bit")
    words = np.zeros(BITS // 64, np.int64)
    for r in rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():
        words[r["at"]] = r["bits"]
    return words


def _sets(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(vid, sig, elements) of the wanted vertices (vid, id, hash, sig), from the texts again.

    A bitmap of fixed size leaves most other texts out before the shuffle; a full one lets all pass.
    """
    keys = saved(wanted.select("vid", F.col("id").alias("_id"), F.col("hash").alias("_hash")), "minhash-wanted")
    rows, bits = _rows(df, id_col, text_col), _bitmap(keys)
    rows = rows.select("doc_id", "text_hash", "text", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(BITS)).alias("h"))

    def run(batches):
        shingler = Shingler(shingle)
        for b in batches:
            h = b.column(3).to_numpy()
            b = b.filter(pa.array((bits[h >> 6] >> (h & 63)) & 1 == 1))
            for part in slices(b.num_rows, 512):
                sets = [shingler.set_of(t.as_py()).tobytes() for t in b.column(2)[part.start : part.stop]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[part.start : part.stop], b.column(1)[part.start : part.stop], pa.array(sets, pa.binary())],
                    names=["doc_id", "text_hash", "elements"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, text_hash long, elements binary")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    found = found.join(keys, same).select("vid", "elements").dropDuplicates(["vid"])
    return saved(found.join(wanted.select("vid", "sig"), "vid"), "minhash-sets")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), COORDS)


def _link_batch(links: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    if links:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])


def _star(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The linked pairs (a, b) of ``pairs``; a central vertex with many partners meets them in parts."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
    pairs = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    centre = pairs.select("a", "part").distinct().join(sets.withColumnRenamed("vid", "a"), "a")
    centre = centre.select("a", "part", F.lit(0).alias("tag"), F.col("a").alias("vid"), "sig", "elements")
    other = pairs.join(sets.withColumnRenamed("vid", "b"), "b").select("a", "part", F.lit(1).alias("tag"), F.col("b").alias("vid"), "sig", "elements")
    dealt = centre.union(other).repartition("a", "part").sortWithinPartitions("a", "part", "tag").select("a", "tag", "vid", "sig", "elements")

    def run(batches):
        sig = elements = None
        for b in batches:
            a, vid, out = b.column(0).to_pylist(), b.column(2).to_pylist(), []
            sigs, tags = _matrix(b.column(3)), b.column(1).to_pylist()
            for i, tag in enumerate(tags):
                mine = b.column(4)[i]
                if tag == 0:
                    sig, elements = sigs[i].copy(), np.frombuffer(mine.as_py(), np.uint64)
                elif (sigs[i] == sig).sum() >= MATCHES and _linked(elements, np.frombuffer(mine.as_py(), np.uint64), percent):
                    out.append((a[i], vid[i]))
            yield from _link_batch(out)

    return dealt.mapInArrow(run, "a long, b long")


class _Union:
    def __init__(self, labels: list[int]):
        self.up = {c: c for c in labels}

    def root(self, c: int) -> int:
        while self.up[c] != c:
            self.up[c] = self.up[self.up[c]]
            c = self.up[c]
        return c

    def join(self, a: int, b: int) -> None:
        self.up[a] = b


def _block_links(left: list, right: list, percent: int, chosen: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of two blocks of (vid, comp, n, sig, elements) that connect different components.

    ``chosen``: which pairs to look at, by default all.
    """
    if not left or not right:
        return []
    union, out = _Union([r[1] for r in left] + [r[1] for r in right]), []
    sigs, sizes = np.stack([r[3] for r in right]), np.array([r[2] for r in right])
    comps = np.array([r[1] for r in right])
    for i, (vid, comp, n, sig, elements) in enumerate(left):
        maybe = (comps != comp) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
        some = np.flatnonzero(maybe if chosen is None else maybe & chosen[i])
        hits = (sigs[some] == sig).sum(axis=1)
        # The likeliest first: what is connected already needs no check.
        for j in some[np.argsort(-hits, kind="stable")][: int((hits >= MATCHES).sum())].tolist():
            a, b = union.root(comp), union.root(right[j][1])
            if a != b and _linked(elements, right[j][4], percent):
                union.join(a, b)
                out.append((vid, right[j][0]))
    return out


def _likely(sigs: np.ndarray, lists: np.ndarray, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the pairs (left, right) of rows agree in enough coordinates and have ``at`` as their first common list.

    ``sigs``: short signatures; ``lists``: bits of the lists that a row's vertex is compared in.
    """
    out = np.zeros(len(left), bool)
    bits = np.arange(COORDS // WIDTH)
    for part in slices(len(left), 1 << 14):
        same = sigs[left[part]] == sigs[right[part]]
        common = same.reshape(len(same), -1, WIDTH).all(axis=2) & ((lists[left[part]] & lists[right[part]])[:, None] >> bits & 1 == 1)
        out[part] = (same.sum(axis=1) >= MATCHES) & (common.argmax(axis=1) == at[part])
    return out


_LIST = COORDS // WIDTH - 1  # the bits of a list's key that are its number


def _likely_seats(percent: int):
    """Keeps the rows (tok, x, y, side, vid, comp, lists) of the vertices that have a likely partner in their tiles."""
    corners: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def pairs(start: int, stop: int, one: bool, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = stop - start
        if one:
            if n not in corners:
                corners[n] = np.triu_indices(n, 1)
            a, b = corners[n]
            return a + start, b + start
        k = n - int(sides[start:stop].sum())
        return np.repeat(np.arange(start, start + k), n - k), np.tile(np.arange(start + k, stop), k)

    def seats(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        tok, x, y, side, comp, size, lists = (table.column(c).to_numpy() for c in ("tok", "x", "y", "side", "comp", "size", "lists"))
        sigs = _matrix(table.column("short").combine_chunks())
        keep = np.zeros(len(tok), bool)
        found = [pairs(a, b, x[a] == y[a], side) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        left, right = (np.concatenate(c) for c in zip(*found))
        maybe = (comp[left] != comp[right]) & (100 * np.minimum(size[left], size[right]) >= percent * np.maximum(size[left], size[right]))
        left, right = left[maybe], right[maybe]
        likely = _likely(sigs, lists, left, right, tok[left] & _LIST)
        keep[left[likely]] = keep[right[likely]] = True
        rows = table.select(["tok", "x", "y", "side", "vid", "comp", "lists"]).slice(0, len(keep)).filter(pa.array(keep))
        yield from rows.to_batches()

    def run(batches):
        rest = None
        for b in batches:
            table = pa.Table.from_batches([b])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            keys = [table.column(c).to_numpy() for c in ("tok", "x", "y")]
            new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            if len(new):  # whole groups; the last one may go on
                yield from seats(table.slice(0, int(new[-1])), np.concatenate(([0], new)))
                table = table.slice(int(new[-1]))
            rest = table
        if rest is not None and rest.num_rows:
            yield from seats(rest, np.array([0, rest.num_rows]))

    return run


def _tile_links(key: tuple, tiles: tuple[list, list], masks: tuple[list, list], percent: int) -> list[tuple[int, int]]:
    """Links of a tile (key: list, x, y) with another one, or within one (x = y)."""
    one = key is not None and key[1] == key[2]
    other = 0 if one else 1
    if not tiles[0] or not tiles[other]:
        return []
    sigs = np.stack([r[3] for r in tiles[0] + tiles[other]]) & _SHORT
    n, m = len(tiles[0]), len(tiles[other])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n, n + m), indexing="ij"))
    chosen = _likely(sigs, np.array(masks[0] + masks[other], np.int64), a, b, np.full(len(a), key[0] & _LIST)).reshape(n, m)
    return _block_links(tiles[0], tiles[other], percent, np.triu(chosen, 1) if one else chosen)


def _open_lists(postings: DataFrame, comps: DataFrame) -> DataFrame:
    """(tok, x, y, side, vid, comp): the vertices of the lists (tok, vid) with several components, by tiles that meet.

    A list of at most BLOCK vertices is one tile that meets itself.  Of a longer one the strays, those outside
    its largest component, are dealt to tiles that meet every tile, the others to tiles that meet the strays'.
    """
    own = postings.join(comps.withColumnRenamed("v", "vid"), "vid", "left").select("tok", "vid", F.coalesce("root", "vid").alias("comp"))
    sizes = own.groupBy("tok", "comp").agg(F.count(F.lit(1)).alias("k"))
    home = F.max(F.struct("k", "comp"))
    mixed = sizes.groupBy("tok").agg(home.alias("home"), F.sum("k").alias("every"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    small = F.col("every") <= BLOCK
    tiles = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = mixed.select(
        "tok", F.when(~small, F.col("home.comp")).alias("home"),
        F.when(small, 1).otherwise(tiles(F.col("every") - F.col("home.k"))).alias("xs"), F.when(small, 0).otherwise(tiles(F.col("home.k"))).alias("ys"),
    )
    rows = own.join(mixed, "tok").withColumn("stray", F.col("home").isNull() | (F.col("home") != F.col("comp")))
    dealt = lambda n: F.pmod(F.xxhash64("vid"), n).cast("int")
    mine = F.when(F.col("stray"), dealt(F.col("xs"))).otherwise(F.col("xs") + dealt(F.greatest("ys", F.lit(1))))
    rows = rows.withColumn("mine", mine)
    last = F.when(F.col("stray"), F.col("xs") + F.col("ys")).otherwise(F.col("xs")) - 1
    rows = rows.select("tok", "vid", "comp", "mine", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return rows.select("tok", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), (F.col("other") < F.col("mine")).cast("int").alias("side"), "vid", "comp")


def _cross(postings: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that share a list of ``postings`` (tok, vid)."""
    rows = saved(_open_lists(postings, comps), "minhash-open")
    number = F.col("tok").bitwiseAND(F.lit(_LIST)).cast("int")
    lists = rows.groupBy("vid").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), number)).alias("lists"))
    # By signature first, so that full sets go only where a vertex has a likely partner.
    short = F.transform("sig", lambda v: v.bitwiseAND(F.lit(_SHORT)).cast("int"))
    brief = sets.select("vid", short.alias("short"), (F.octet_length("elements") / 8).cast("long").alias("size"))
    seats = rows.join(brief.join(lists, "vid"), "vid").select("tok", "x", "y", "side", "vid", "comp", "size", "lists", "short")
    seats = seats.repartition("tok", "x", "y").sortWithinPartitions("tok", "x", "y", "side")
    seats = saved(seats.mapInArrow(_likely_seats(percent), "tok long, x int, y int, side int, vid long, comp long, lists long"), "minhash-seats")
    dealt = seats.join(sets, "vid").select("tok", "x", "y", "side", "vid", "comp", "lists", "sig", "elements")
    dealt = dealt.repartition("tok", "x", "y").sortWithinPartitions("tok", "x", "y", "side")

    def run(batches):
        key, tiles, masks = None, ([], []), ([], [])
        for b in batches:
            ids = [b.column(i).to_pylist() for i in range(7)]
            sigs = _matrix(b.column(7))
            for i, (tok, x, y, side, vid, comp, mask) in enumerate(zip(*ids)):
                if (tok, x, y) != key:
                    yield from _link_batch(_tile_links(key, tiles, masks, percent))
                    key, tiles, masks = (tok, x, y), ([], []), ([], [])
                elements = np.frombuffer(b.column(8)[i].as_py(), np.uint64)
                tiles[side].append((vid, comp, len(elements), sigs[i].copy(), elements))
                masks[side].append(mask)
        yield from _link_batch(_tile_links(key, tiles, masks, percent))

    return dealt.mapInArrow(run, "a long, b long")


def _postings(vertices: DataFrame) -> DataFrame:
    """(tok, vid, lead): the merged lists of two or more vertices; lead is the most central one."""
    value = lambda at: F.get("sig", F.lit(at)).bitwiseAND(F.lit(_SHORT))
    key = lambda at: F.xxhash64(F.lit(at), *[value(at + j) for j in range(WIDTH)])
    tok = lambda at: key(at).bitwiseAND(F.lit(~_LIST)).bitwiseOR(F.lit(at // WIDTH))  # the last bits number the list
    every = vertices.select("vid", F.explode(F.array(*map(tok, range(0, COORDS, WIDTH)))).alias("tok"))
    shared = saved(every.groupBy("tok").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "minhash-shared")
    lists = every.join(shared, "tok").groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("k", "tok"))).alias("t"))
    lists = lists.filter(F.size("t") >= SHARED)  # at most COORDS / WIDTH lists a vertex
    merged = F.slice("t", F.lit(1), F.size("t") - (SHARED - 1))
    score = F.aggregate("t.k", F.lit(0).cast("long"), lambda x, y: x + y)
    rows = saved(lists.select("vid", score.alias("score"), F.explode(merged).alias("m")).select("vid", "score", "m.tok"), "minhash-merged")
    best = rows.groupBy("tok").agg(F.max(F.struct("score", (-F.col("vid")).alias("v"))).alias("best"), F.count(F.lit(1)).alias("c"))
    best = best.filter("c > 1").select("tok", (-F.col("best.v")).alias("lead"))
    return saved(rows.select("vid", "tok").join(best, "tok"), "minhash-postings")


def link_roots(df: DataFrame, vertices: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """(v, root) of the vertices that have a link; root is a vertex."""
    postings = _postings(vertices)
    wanted = vertices.join(postings.select("vid").distinct(), "vid", "left_semi")
    sets = _sets(df, wanted, id_col, text_col, shingle)
    # Each vertex meets the centre that it shares the most lists with; the blocks do the rest.
    met = postings.filter("vid <> lead").groupBy("vid", "lead").agg(F.count(F.lit(1)).alias("c"))
    best = F.max(F.struct("c", (-F.col("lead")).alias("v")))
    pairs = met.groupBy(F.col("vid").alias("b")).agg((-best.getField("v")).alias("a")).select("a", "b")
    links = saved(_star(saved(pairs, "minhash-pairs"), sets, percent), "minhash-star")
    first = saved(components(links), "minhash-first")
    more = saved(_cross(postings, first, sets, percent), "minhash-cross")
    return first if more.isEmpty() else components(links.union(more))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id (smallest id reachable), kept.

    Sets are held as 64-bit hashes of their shingles.  Texts without words, null ones included, have
    an empty set and link with nothing; a text shorter than a shingle is one shingle.  Repeated rows
    stay and share a component.  A null id stays null and names a component only if all its members
    are null; kept is true where the id is the component's.  An empty table gives no rows.  Only the
    id and the text are read, so further columns may have any name; ids keep their type.
    """
    if not PERCENT <= percent <= 100:
        raise ValueError(f"percent must be {PERCENT}..100: the number of matches is chosen for {PERCENT}")
    docs = saved(signatures(df, id_col, text_col, shingle), "minhash-docs")
    one = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    distinct = docs.filter("sid is not null").groupBy("sid").agg(
        F.min(one).alias("rep"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies")
    )
    vid = F.monotonically_increasing_id().alias("vid")
    vertices = saved(distinct.select(vid, "sid", F.col("rep.doc_id").alias("id"), F.col("rep.text_hash").alias("hash"), "sig", "copies"), "minhash-vertices")
    roots = link_roots(df, vertices, id_col, text_col, shingle, percent)
    linked = vertices.select("vid", "sid", "id", "copies").join(roots, F.col("vid") == F.col("v"), "left")
    linked = linked.filter("root is not null or copies > 1").select("sid", "id", F.coalesce("root", "vid").alias("root"))
    linked = saved(linked, "minhash-linked")
    least = linked.groupBy("root").agg(F.min("id").alias("least"))
    names = saved(linked.join(least, "root").select(F.col("sid").alias("_sid"), "least", F.lit(True).alias("named")), "minhash-names")
    out = docs.select("doc_id", "n", "sid").join(names, F.col("sid") == F.col("_sid"), "left")
    component = F.when(F.col("named"), F.col("least")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
