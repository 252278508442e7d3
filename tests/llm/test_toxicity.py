import random

from pyspark.sql import functions as F

from tabspark.llm import toxicity as T


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def brute_match(word, terms):
    found = [(distance(word, t), t) for t in terms if distance(word, t) <= T.allowed_errors(t)]
    return min(found, default=None)


def test_automaton_equals_brute_force():
    rng = random.Random(2)
    letters = "abcé"
    terms = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 12))) for _ in range(60)]
    lexicon = T.Lexicon(terms)
    for _ in range(4000):
        if rng.random() < 0.5:
            word = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 13)))
        else:
            w = list(rng.choice(terms))
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randrange(2)] = rng.choice(["", "b", "é"])
            word = "".join(w) or "a"
        assert lexicon.match(word) == brute_match(word, terms), word


def test_quotation():
    lexicon = T.Lexicon(["idiot"])
    kinds = lambda text: [(w, q) for w, *_, q in T.find_matches(text, lexicon)]
    assert kinds("You IDIOT, an idiiot!") == [("idiot", False), ("idiiot", False)]
    assert kinds('the sign read "no idiot here" today') == [("idiot", True)]
    assert kinds("she called him an idiot") == [("idiot", True)]
    assert kinds("« idiot » et idiot") == [("idiot", True), ("idiot", False)]
    assert kinds('"open quote\nidiot') == [("idiot", False)]
    assert kinds(None) == kinds("") == []


def labelled(spark, n=300):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(30)]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(30), rng.choice(["grubbel", "snorfle", "Blorkmann"]))
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_fit_and_score(spark):
    df = labelled(spark).unionByName(spark.createDataFrame([(900, None, 1), (901, "", 0), (902, "x", None)], "doc_id long, text string, toxic int"))
    model = T.fit(df.withColumns({"y": F.lit("?"), "word": F.lit(1)}))
    assert sorted(model.terms) == ["blorkmann", "grubbel", "snorfle"]
    assert model.score("w1 grubbel w2 snorfle") > 0.9
    assert model.score("w1 grubbbel and blorkmaan w2") > T.THRESHOLD  # misspelled
    assert model.score("the word \"grubbel\" was printed") < T.THRESHOLD  # quoted
    assert model.score("w1 w2 w3") == model.score(None) == model.score("") < T.THRESHOLD
    assert model.score("w1 " * 50_000 + "grubbel snorfle") > 0.9
    rows = df.select("doc_id", T.score_column(model, F.col("text")).alias("s")).collect()
    assert len(rows) == 303 and all(0 <= r.s <= 1 for r in rows)
    found = T.explain(model, spark.createDataFrame([(None, "a grubbel!"), (2, None)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.word, r.start, r.end, r.quoted) for r in found] == [(None, "grubbel", 2, 9, False)]


def test_labelled_sample_is_bounded(spark):
    df = labelled(spark, 60)
    labels = df.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    assert T.labelled_sample(df, labels).count() == 60
    few = T.labelled_sample(df, labels, limit=10).collect()
    assert len(few) == 10 and sorted(few) == sorted(T.labelled_sample(df.repartition(3), labels, limit=10).collect())


def test_no_labels(spark):
    empty = spark.createDataFrame([], "text string, toxic int")
    model = T.fit(empty)
    assert model.terms == [] and 0 < model.score("anything") < T.THRESHOLD
    one = T.fit(spark.createDataFrame([("a b", 0), ("c", 0)], "text string, toxic int"))
    assert one.terms == [] and one.score("a") < T.THRESHOLD
