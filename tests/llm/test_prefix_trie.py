import random
import zlib
from hashlib import sha256

from pyspark.sql import functions as F

from tabspark.llm import prefix_trie as T
from tabspark.llm.q_prefix_trie import rebuilt

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(convs):
    """Nodes over {conv_id: [(role, text), ...]}."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    below = {p: [q for q in members if q[: len(p)] == p] for p in members}
    out = []
    for p, cs in members.items():
        kids = [q for q in below[p] if len(q) == len(p) + 1]
        leaves = sum(not any(len(r) == len(q) + 1 for r in below[q]) for q in below[p])
        save = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below[p] if q)
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids), leaves, save, sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def case():
    rng = random.Random(4)
    turns = [("user", "a"), ("user", "bé😀"), ("bot", "a"), ("", "ccc"), ("bot", ""), ("", "")]
    convs = {}
    for c in range(260):
        n = rng.choice([1, 1, 2, 3, 4, 7])
        convs[c] = [rng.choice(turns[: 2 + i]) if i < 3 else rng.choice(turns) for i in range(n)]
    for c in range(300, 480):  # one sequence held by a third of all
        convs[c] = [("user", "hot"), ("bot", "same"), ("user", "end")]
    convs[500] = [("user", "x" * 5000)] * 300
    convs[599] = [("user", "x" * 5000)] * 299 + [("bot", "y")]
    return convs


def frame(spark, convs):
    rows = [(c, i or None, r or None if i % 2 else r, t or None if i % 3 else t) for c, ts in convs.items() for i, (r, t) in enumerate(ts)]
    random.Random(1).shuffle(rows)
    rows += [(None, 1, "user", "no conversation")]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"path": F.lit(1), "key": F.lit("x"), "t": F.lit(2), "task": F.lit(0)})


def test_trie_equals_brute_force_at_any_sharding(spark):
    convs = case()
    seqs = T.sequences(frame(spark, convs)).cache()
    want = brute(convs)
    for size, parts in ((T.SHARD, "3"), (40, "2"), (7, "23")):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = [tuple(r) for r in T.prefix_trie(seqs, shard_size=size).collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert sorted(got, key=repr) == want


def test_rebuilt_conversations(spark):
    rng = random.Random(9)
    convs = {c: [("u", f"{c % 7}-{i % 2}") for i in range(rng.randrange(1, 9))] for c in list(range(0, 130)) + [777, 200]}
    convs |= {c: [("u", "only")] for c in range(701, 713)}  # their base is absent
    want = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    df = spark.createDataFrame([(c, i, *t) for c, ts in convs.items() for i, t in enumerate(ts)], SCHEMA)
    got = [tuple(r) for r in T.prefix_trie(rebuilt(T.sequences(df))).collect()]
    assert any(not v for v in want.values())
    assert sorted(got, key=repr) == brute(want)


def test_tree_is_balanced_and_walks_deep_sequences():
    tree = T.TernaryTree()
    for i in T._median_order(1023):
        tree.insert([i], [1], [i])

    def height(at):
        return 0 if at < 0 else 1 + max(height(tree.low[at]), height(tree.high[at]))

    assert height(tree.same[0]) == 10
    tree.insert([5] * 50_000, [1] * 50_000, [9999])
    assert tree.sums()[1][0] == 1023 and tree.n[0] == 1024


def test_empty_table(spark):
    assert T.prefix_trie(T.sequences(spark.createDataFrame([], SCHEMA))).count() == 0
