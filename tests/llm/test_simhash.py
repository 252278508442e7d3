import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabspark.llm import simhash as S


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (id, fp) -> {id: smallest id reachable}."""
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {rows[i][0]: least[find(i)] for i in range(len(rows))}


def near_words(seed, n):
    rng = random.Random(seed)
    return [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(n)]


def test_golay_decoding_is_perfect_and_covers_two_errors():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 3000)
    index, ok = S.nearby_codewords(words)
    assert set(ok.sum(axis=1)) == {1, 6}
    for a, i, u in zip(words, index, ok):
        flips = rng.choice(23, 2, replace=False)
        for b in (a ^ (1 << int(flips[0])), a ^ (1 << int(flips[0])) ^ (1 << int(flips[1]))):
            j, v = S.nearby_codewords(np.array([b]))
            assert set(i[u]) & set(j[0][v[0]])


def test_any_pair_within_four_bits_shares_a_key():
    rng = random.Random(5)
    for _ in range(1500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(5)):
            b ^= 1 << bit
        keys, row = S.keys_of(np.array([a, b], np.uint64))
        assert set(keys[row == 0]) & set(keys[row == 1])
        assert len(set(keys[row == 0])) == (row == 0).sum()


def test_fingerprint_equals_brute_force():
    for text in (None, "", " \t\n", "One", "two Words", "a b c d", "É à\x0bb C\x85d e", " ".join(near_words(1, 700))):
        assert S.fingerprint(text.encode() if text else None) == brute_fingerprint(text)


def corpus():
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "one"), (5, "one")]
    base = near_words(2, 120)
    rng = random.Random(9)
    for i in range(60):  # near copies, a few words changed
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "x%d" % rng.randrange(50)
        rows.append((100 + i, " ".join(w)))
    rows += [(300 + i, " ".join(near_words(50 + i, 40))) for i in range(60)]
    rows += [(900, "word " * 30_000)]
    return rows


def test_components_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"fp": F.lit("x"), "key": F.lit(1), "root": F.lit(2)}
    )
    got = S.near_duplicates(df).collect()
    want = brute_components([(d, brute_fingerprint(t)) for d, t in rows])
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fp % 2**64 for r in got} == {d: brute_fingerprint(t) for d, t in rows}


def test_links_on_dense_fingerprints(spark):
    rng = random.Random(11)
    fps = set()
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(150):
            f = base
            for bit in rng.sample(range(64), rng.randrange(9)):
                f ^= 1 << bit
            fps.add(f)
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for _, f in rows], "fp long")
    roots = {r.fp % 2**64: r.root for r in S.link_components(df).collect()}
    want = brute_components(rows)
    groups = {}
    for i, f in rows:
        groups.setdefault(want[i], set()).add(roots.get(f, ("alone", f)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_empty_table_null_id_and_bits(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).count() == 0
    got = S.near_duplicates(spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (None, "z")], "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got.collect()) == [(0, 0), (0, 7), (7, 7)]
    with pytest.raises(ValueError):
        S.link_components(empty.selectExpr("doc_id fp"), 5)


def test_deduplicate_with_helper_names_and_repeated_ids(spark):
    from tabspark.llm.simhash import deduplicate

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "b", 1, 1), (1, text, "a", 2, 2), (2, text, "c", 3, 3), (3, "other words here that stand alone", "d", 4, 4), (None, text, "e", 5, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _keep_id string, _keep_hash long, row long")
    for parts in (1, 4):  # the same row of equal ids and texts at any partitioning
        got = deduplicate(df.repartition(parts))
        assert got.columns == df.columns
        assert sorted((r.doc_id, r._keep_id) for r in got.collect()) == [(1, "a"), (3, "d")]
    assert deduplicate(df.filter("false")).count() == 0


def test_keys_are_never_broadcast(spark, monkeypatch):
    """Every fingerprint has about ninety keys; sized like the fingerprints, they went to the driver."""
    seen, saved = {}, S.saved
    monkeypatch.setattr(S, "saved", lambda df, name: (seen.setdefault(name, df), saved(df, name))[1])
    fps = saved(spark.range(1 << 7).select(F.xxhash64("id").alias("fp")), "test-fps")
    S.link_components(fps)
    plan = seen["simhash-buckets"]._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
