import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabspark.llm import packing as P
from tabspark.llm.tokenize import default_path, tokens


def fill(slots, counts, capacity):
    """Place every piece; check that nothing overlaps and no gap is inside."""
    bins = {}
    for size, lo, hi, base, offset in slots:
        for r in range(lo, hi):
            bins.setdefault(base + r - lo, []).append((offset, size))
    seen = {}
    for parts in bins.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
            seen[size] = seen.get(size, 0) + 1
        assert at <= capacity
    assert seen == {k: n for k, n in counts.items() if n}
    return bins


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 40), max_size=25))
def test_plan_places_every_piece(counts):
    bins = fill(P.plan(counts, 60), counts, 60)
    total = sum(k * n for k, n in counts.items())
    assert len(bins) >= -(-total // 60)


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fits = [g for g in gaps if g >= s]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - s)
        else:
            gaps.append(capacity - s)
    return len(gaps)


def test_plan_is_as_good_as_best_fit_decreasing():
    rng = random.Random(4)
    for _ in range(20):
        sizes = [min(100, int(rng.expovariate(1 / 30)) + 1) for _ in range(400)]
        counts = {s: sizes.count(s) for s in set(sizes)}
        n = len(fill(P.plan(counts, 100), counts, 100))
        assert n <= best_fit_decreasing(sizes, 100) * 1.01 + 1


def test_large_pieces_stand_at_most_twice():
    counts = {40: 7, 36: 5, 60: 3, 90: 2, 10: 30}
    for parts in fill(P.plan(counts, 100), counts, 100).values():
        assert sum(3 * size > 100 for _, size in parts) <= 2
    with pytest.raises(ValueError):
        P.plan({101: 1}, 100)


def test_cut():
    assert P.cut(1, 8) == [(0, 1)]
    assert P.cut(8, 8) == [(0, 8)]
    assert P.cut(19, 8) == [(0, 3), (3, 8), (11, 8)]


@settings(max_examples=120, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_library(text):
    t = tokens(default_path())
    for x in (text, text.encode("ascii", "ignore").decode(), f"É {text}<|endoftext|> it's 12\n\n  x"):
        assert t.ids(x) == t.slow.encode(x, add_special_tokens=False).ids


def test_pack_round_trip(spark):
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "no id"), (5, "word " * 9000), (6, "x" * 3000)]
    rows += [(100 + i, " ".join(rng.choice(["alpha", "beta", "ñandú", "x9"]) for _ in range(rng.randrange(1, 90)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"length": F.lit("x"), "offset": F.lit(1), "_uid": F.lit(0)})
    packed = P.pack(df, capacity=64, with_ids=True).cache()
    slow = tokens(default_path()).slow
    ids = {d: [*slow.encode(t or "", add_special_tokens=False).ids, 2] for d, t in rows}
    got = packed.collect()
    bins = {}
    for r in got:
        want = ids[r.doc_id][r.start : r.start + r.length]
        assert list(r.ids) == want and r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, seq in ids.items():
        n = sum(x == d for x, _ in rows)
        assert sum(r.length for r in got if r.doc_id == d) == n * len(seq)
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64
    whole = P.sequences(packed).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in got)


def test_buckets_number_without_gaps(spark):
    rows = spark.range(500).selectExpr("id", "cast(1 + id % 3 as long) length")
    got = P.assign(rows, 10, bucket_rows=37).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 500
    assert P.assign(rows.filter("id < 0"), 10).count() == 0
