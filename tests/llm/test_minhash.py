import random

import numpy as np
from pyspark.sql import functions as F

from tabspark.llm import minhash as M


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in groups.items()}
    return sorted(((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def corpus():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}é"
    rows, n = [], 1000

    def add(words):
        nonlocal n
        rows.append((n, rng.choice([" ", "  ", "\n"]).join(words)))
        n += rng.choice([1, 2])

    for _ in range(30):
        add([word() for _ in range(rng.randrange(1, 200))])
    for _ in range(8):  # families of near copies around the border
        base = [word() for _ in range(rng.randrange(40, 160))]
        for _ in range(rng.randrange(2, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            add([w.upper() if rng.random() < 0.1 and w.isascii() else w for w in copy])
    drift = [word() for _ in range(120)]
    for _ in range(60):  # a chain: each links to the next, few to the first
        drift[rng.randrange(120)] = word()
        add(drift)
    template = [word() for _ in range(100)]
    for _ in range(60):  # a template: much in common, no links
        add(template[:70] + [word() for _ in range(60)])
    long = [word() for _ in range(12_000)]
    add(long)
    add(long[:-20] + ["x"])
    rng.shuffle(rows)
    return rows + [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one two"), (None, "alone null"), (7, rows[0][1]), (7, rows[0][1]), (8, "a b c"), (9, "a b  C")]


def test_equals_brute_force(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("vid", "sig", "sid", "a", "n", "_id", "text_hash")})
    want = brute(rows)
    for block, star in ((M.BLOCK, M.STAR), (8, 3)):
        monkeypatch.setattr(M, "BLOCK", block)
        monkeypatch.setattr(M, "STAR", star)
        got = [(r.doc_id, r.n_shingles, r.component_id, r.doc_id is not None and r.kept) for r in M.near_duplicates(df.repartition(6)).collect()]
        assert sorted(got, key=repr) == [(d, n, c, d is not None and k) for d, n, c, k in want]


def test_text_ids_and_empty_tables(spark):
    rows = [("b", "one two three four five six"), ("a", "One two three four five six"), ("c", None)]
    got = {tuple(r) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {("b", 2, "a", False), ("a", 2, "a", True), ("c", 0, "c", True)}
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_collisions_follow_similarity():
    rng = np.random.default_rng(1)
    hits = []
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        a, b = M.signature(np.sort(x[:925])), M.signature(np.sort(x[75:]))  # similarity 0.85
        hits.append(int((a == b).sum()))
    assert abs(np.mean(hits) / M.COORDS - 0.85) < 0.01 and 2.2 < np.std(hits) < 3.6 and min(hits) >= M.MATCHES


def test_no_pair_of_a_group_leaves_the_blocks():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64)) for _ in range(3)]
    rows = [(i, i, 500, M.signature(sets[i % 3]), sets[i % 3]) for i in range(90)]
    links = M._block_links(rows[:45], rows[45:], 85)
    assert len(links) == 87 and all(a % 3 == b % 3 for a, b in links)


def test_a_vertex_is_posted_under_pairs_of_coordinates(spark, monkeypatch):
    shared = []
    real = M.saved

    def saved(df, name):
        out = real(df, name)
        if name == "minhash-shared":
            shared.append(out.count())
        return out

    monkeypatch.setattr(M, "saved", saved)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:399], "x"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in M.near_duplicates(df).collect()}
    assert got == {0: 0, 1: 0}
    assert M.SHARED <= shared[0] <= M.COORDS // 2  # one list a coordinate before


def test_open_lists_grow_with_their_vertices(spark):
    """Many short lists across many vertices leave one row a posting (blocks of vertices met by pairs before)."""
    from pyspark.sql import Row

    rng = random.Random(9)
    postings = [Row(tok=32 * t, vid=v, lead=0) for t in range(600) for v in rng.sample(range(3000), 2)]
    comps = spark.createDataFrame([], "v long, root long")
    rows = M._open_lists(spark.createDataFrame(postings), comps).collect()
    assert len(rows) == len(postings) and all(r.x == r.y == r.side == 0 for r in rows)
    # A long list: all pairs of strays with others meet in some tiles, rows in proportion where strays are few.
    n = 4 * M.BLOCK
    long = spark.createDataFrame([Row(tok=32, vid=v, lead=0) for v in range(n)])
    comps = spark.createDataFrame([(v, 0) for v in range(n - 10)], "v long, root long")
    rows = M._open_lists(long, comps).collect()
    assert len(rows) < 1.1 * n
    seats = {}
    for r in rows:
        seats.setdefault(r.vid, set()).add((r.x, r.y))
    assert all(seats[a] & seats[b] for a in range(n - 10, n) for b in range(n))
