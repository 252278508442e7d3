import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tabspark.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(root, the siblings of every node with its side)."""
    steps, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, p in enumerate(at):
            steps[i].append((level[p ^ 1] if p ^ 1 < len(level) else "", p % 2 == 1))
            at[i] = p // 2
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], steps


def brute(rows):
    groups, out = {}, []
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[g])]) for g in names]
    root, top = tree([t[0] for t in trees])
    for g, (sub, steps), up in zip(names, trees, top):
        for (known, doc, x), way in zip(sorted(groups[g]), steps):
            out.append((doc if known else None, x, sub, root, tuple(way + up)))
    return sorted(out, key=repr)


def case(n):
    rng = random.Random(n)
    rows = [(i, f"s{i % 3}", rng.choice(["en", "en", "en", "de", "é", "z"]), i * 7, f"text ü {i}") for i in range(n)]
    rows += [(3, None, None, None, None), (4, "", None, 0, ""), (None, "a", "en", 1, "x"), (None, "a", "en", 1, "y"), (5, "r", "en", 2, "same"), (5, "r", "en", 2, "same"), (5, "r", "en", 2, "other"), (9, "long", "one", 1, "é" * 100_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, n", [(2, 23), (4, 75), (256, 60)])
def test_proofs_equal_brute_force(spark, monkeypatch, block, n):
    monkeypatch.setattr(M, "BLOCK", block)
    rows = case(n)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("g", "pos", "n", "_row", "digest", "node", "root", "id")})
    out = M.proofs(df.repartition(5), carry={"tampered": F.when(F.col("doc_id") % 3 == 0, F.lit("0" * 64))})
    got = out.withColumns({"seen": M.folded(F.coalesce("tampered", "leaf"), F.col("path")), "proof": M.proof_digest(F.col("path"))}).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.sib, s.right) for s in r.path)) for r in got), key=repr) == brute(rows)
    for r in got:
        assert (r.seen == r.root) == (r.tampered is None)
        assert r.proof == h(*(s.sib for s in r.path))


def test_root_does_not_depend_on_the_partitioning(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 4)
    df = spark.createDataFrame(case(40), SCHEMA)
    roots = {M.proofs(d).select("root").distinct().first()[0] for d in (df.coalesce(1), df.repartition(9))}
    assert len(roots) == 1


def test_small_tables(spark):
    assert M.proofs(spark.createDataFrame([], SCHEMA)).count() == 0
    row = (1, None, "", 3, "a")
    got = M.proofs(spark.createDataFrame([row], SCHEMA)).collect()
    assert [(r.leaf, r.subroot, r.root, r.path) for r in got] == [(leaf(row),) * 3 + ([],)]
