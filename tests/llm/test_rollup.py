import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabspark.llm.common import words_of
from tabspark.llm.rollup import TokenRollup, counted
from tabspark.llm.tokenize import default_path, tokens

SCHEMA = "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long"


class Brute:
    def __init__(self):
        self.state = defaultdict(lambda: (0, 0))

    def apply(self, events):
        for kind in ("insert", "revise", "delete"):
            revised = {}
            for op, *key, n in events:
                key, n = tuple(key), n or 0
                if op != kind:
                    continue
                d, t = self.state[key]
                if op == "insert":
                    self.state[key] = (d + 1, t + n)
                elif op == "revise":
                    revised[key] = max(n, revised.get(key, 0))
                else:
                    self.state[key] = (0, 0)
            for key, n in revised.items():
                self.state[key] = (self.state[key][0], self.state[key][0] * n)

    def totals(self):
        out = defaultdict(lambda: [0, 0])
        for (_, *group), (d, t) in self.state.items():
            out[tuple(group)][0] += d
            out[tuple(group)][1] += t
        return {g: tuple(v) for g, v in out.items() if any(v)}


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}


def test_batches_equal_brute_force(spark, scratch):
    rng = random.Random(3)
    rollup, brute = TokenRollup(spark, f"file://{scratch}/r"), Brute()
    assert rollup.totals().count() == 0
    for batch in range(4):
        events = []
        for _ in range(60):
            d = rng.choice([None, *range(25)])
            key = (d, rng.choice(["hot", "hot", "hot", None, "b"]) if d is None else ["hot", "hot", None, "b"][d % 4], "en", rng.choice(["t1", "t2"]))
            op = "insert" if batch == 0 else rng.choice(["insert", "revise", "delete"])
            events.append((op, *key, rng.choice([None, rng.randrange(100)])))
        df = spark.createDataFrame(events, SCHEMA).withColumn("docs", F.lit("clash"))
        assert rollup.commit(f"batch {batch}", df)
        brute.apply(events)
        assert totals(rollup) == brute.totals()
        assert not rollup.commit(f"batch {batch}", df)  # again: no effect
        assert totals(rollup) == brute.totals()
    assert rollup.commit("empty", spark.createDataFrame([], SCHEMA)) and totals(rollup) == brute.totals()
    left = {tuple(r)[:4]: (r.docs, r.tokens) for r in rollup.ledger().collect()}
    assert left == {k: v for k, v in brute.state.items() if any(v)}


def test_failed_attempt_leaves_no_trace(spark, scratch):
    rollup = TokenRollup(spark, f"{scratch}/r")
    good = spark.createDataFrame([("insert", 1, "s", "en", "t", 5)], SCHEMA)
    bad = spark.createDataFrame([("upsert", 1, "s", "en", "t", 5)], SCHEMA)
    with pytest.raises(Exception, match="unknown op"):
        rollup.commit("b", bad)
    assert rollup.totals().count() == 0
    assert rollup.commit("b", good) and totals(rollup) == {("s", "en", "t"): (1, 5)}
    # an attempt that was written but never committed is not read
    src = next(iter(rollup.committed().values()))
    spark.read.parquet(f"{scratch}/r/attempts/{src}/totals").write.parquet(f"{scratch}/r/attempts/lost/totals")
    assert totals(rollup) == {("s", "en", "t"): (1, 5)}
    with pytest.raises(ValueError):
        rollup.commit("", good)


def test_half_written_commit_is_not_read(spark, scratch):
    rollup = TokenRollup(spark, f"{scratch}/r")
    good = spark.createDataFrame([("insert", 1, "s", "en", "t", 5)], SCHEMA)
    os.makedirs(f"{scratch}/r/commits")
    open(f"{scratch}/r/commits/.lost", "w").close()  # the driver went while it filled the file
    assert rollup.committed() == {} and rollup.commit("b", good) and not rollup.commit("b", good)
    assert totals(rollup) == {("s", "en", "t"): (1, 5)}
    name = next(n for n in os.listdir(f"{scratch}/r/commits") if not n.startswith("."))
    with pytest.raises(Exception, match="exist"):
        rollup._publish("commits", name, ["b", "other"])


def test_compaction_and_buckets(spark, scratch):
    rollup, brute = TokenRollup(spark, f"{scratch}/r"), Brute()

    def apply(name, events):
        assert rollup.commit(name, spark.createDataFrame(events, SCHEMA))
        brute.apply(events)
        assert totals(rollup) == brute.totals()

    apply("1", [("insert", d, "s", "en", "t", 10 + (d or 0)) for d in [None, *range(40)]])
    apply("2", [("revise", d, "s", "en", "t", 3) for d in range(0, 40, 2)])
    rollup.compact()
    assert totals(rollup) == brute.totals() and len(rollup._attempts()) == 1
    assert not rollup.commit("1", spark.createDataFrame([("insert", 1, "s", "en", "t", 1)], SCHEMA))  # still known
    apply("3", [("delete", d, "s", "en", "t", None) for d in [None, 1, 2, 99]])
    rollup.compact()
    apply("4", [("revise", 3, "s", "en", "t", 100)])
    assert len(rollup._attempts()) == 2
    left = {tuple(r)[:4]: (r.docs, r.tokens) for r in rollup.ledger().collect()}
    assert left == {k: v for k, v in brute.state.items() if any(v)}
    some = rollup.ledger([0, 1])
    assert "bucket" in some._jdf.queryExecution().toString().split("PartitionFilters")[1][:80]


def test_counts(spark):
    texts = [None, "", "One two-three", "é " * 5000, "x<|endoftext|>y"]
    df = spark.createDataFrame([(i, t, "s", "en", "clash") for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, n_tokens string")
    got = {(r.doc_id, r.tokenizer): r.n_tokens for r in counted(df, {"bpe": default_path(), "w": "words", "s": "space"}).collect()}
    slow = tokens(default_path()).slow
    for i, t in enumerate(texts):
        t = t or ""
        assert got[i, "bpe"] == len(slow.encode(t, add_special_tokens=False).ids)
        assert got[i, "w"] == len(words_of(t)) and got[i, "s"] == len(t.split())


def test_query(spark):
    from tabspark.llm.q_rollup import op3_token_counts

    root = "/root/testdata/sf0.001"
    if not os.path.isdir(root):
        return
    rows = spark.read.parquet(f"{root}/documents.parquet").collect()
    first = {}
    for r in rows:
        first[r.text] = min(first.get(r.text, r.doc_id), r.doc_id)
    want, bpe = defaultdict(lambda: [0, 0]), tokens(default_path())
    for r in rows:
        if first[r.text] == r.doc_id:
            for name, n in (("byte_bpe_50k", len(bpe.ids(r.text))), ("space_v1", len(words_of(r.text)))):
                want[r.source, r.lang, name][0] += 1
                want[r.source, r.lang, name][1] += n
    got = {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens] for r in op3_token_counts(spark, root).collect()}
    assert got == dict(want)
