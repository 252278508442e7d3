import hashlib
import random
import re

from pyspark.sql import functions as F

from tabspark.llm import decontaminate as D


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9)):
            if w:
                wins.setdefault(tuple(w[i : i + 10]), set()).add(item)
    out = []
    for d, text in docs:
        w, hit, ids = words(text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    ids |= wins[tuple(w[i : i + n])]
        names = sorted(str(i) for i in ids if i is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def case():
    rng = random.Random(3)
    vocab = ["the", "of", "Ñandú", "x9", *(f"w{i}" for i in range(25))]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([14, 10, 25]))) for i in range(12)]
    items += [(100, "w1 W2,w3"), (101, "lonely"), (102, None), (103, "..."), (7, items[0][1]), (None, "null id item"), (104, "the the the the the the the the the the the")]
    docs = [(i, text(rng.randrange(60))) for i in range(40)]
    for i in range(30):
        it = words(items[rng.randrange(12)][1])
        cut = it[: rng.randrange(8, len(it) + 1)]
        docs.append((200 + i, f"{text(5)} {' '.join(cut).upper()}! {text(5)} {'lonely' if i % 7 == 0 else ''}"))
    docs += [(300, None), (301, ""), (302, "?!"), (None, "w1 w2 w3"), (303, "a w1-w2_w3 b null id item"), (303, "a w1-w2_w3 b null id item"), (303, "other text"), (304, "the " * 3000)]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = case()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"w": F.lit(1), "words": F.lit(2), "text_hash": F.lit("x"), "wid": F.lit(0)})
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("len", F.lit("q"))
    got = [tuple(r) for r in D.contamination(df, it).collect()]
    assert sorted(got, key=repr) == sorted(brute(docs, items), key=repr)
    df = df.withColumns({"_bad_doc": F.lit(1), "row": F.lit(2), "left_0": F.lit(3), "right_1": F.lit(4)})
    kept = D.without_contaminated(df, it)
    bad = sum(b[-1] for b in brute(docs, items))
    assert kept.count() == len(docs) - bad and kept.columns == df.columns


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    got = D.contamination(docs, none).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(3, 0, False)]
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert D.contamination(docs.filter("doc_id < 0"), items).count() == 0
    assert D.without_contaminated(docs, none).count() == 1


def test_no_python_in_the_plan(spark):
    docs, items = case()
    df = spark.createDataFrame(docs, "doc_id long, text string").cache()
    plan = D.contamination(df, spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_skewed_benchmark_and_long_text(spark):
    """Windows that share one rarest shingle, and a text of many occurrences."""
    items = [(i, f"alpha beta gamma delta tail{i}") for i in range(300)]
    docs = [(1, " ".join(f"alpha beta gamma delta tail{i}" for i in range(300)) * 20), (2, "alpha beta gamma delta none"), (3, "x " * 50_000 + "alpha beta gamma delta tail7")]
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(brute(docs, items))


def test_text_ids(spark):
    docs = spark.createDataFrame([("d1", "a b c"), ("d2", "b c")], "doc_id string, text string")
    got = D.contamination(docs, spark.createDataFrame([("i", "a b")], "item_id string, text string")).collect()
    assert {(r.doc_id, r.n_hit) for r in got} == {("d1", 2), ("d2", 0)}
