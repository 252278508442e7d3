import hashlib
import random
import re

from pyspark.sql import functions as F

from tabspark.llm import pii as P

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def ok(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 10 <= len(d) <= 15


def brute(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if ok(k, m[0])]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


def corpus():
    rng = random.Random(6)
    alphabet = ["a", "B", ".", "@", "-", "_", "1", "25", "256", " ", "+", "(", ")", "4", "é", "😀", "%", "\n", "0", "mail.com", "+1 (555) 555-1234", "10.0.0.1", "4111 1111 1111 1111", "4539578763621486"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += [None, "", "x@y.z_q@r.s", "a@b.c.d@e.f", "1.2.3.4.5.6.7.8", "001.02.3.255", "1.2.3.256", "a" * 30000 + "@", "1" * 20000, "1 " * 9000, "a@" + "b." * 9000 + "c", "+1" + " " * 20000 + "2"]
    return [(i, t) for i, t in enumerate(texts)] + [(3, "dup 10.1.1.1"), (3, "dup 10.1.1.1"), (None, "n 10.2.2.2 é 10.3.3.3")]


def test_base_spans_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"uid": F.lit(1), "kind": F.lit("x"), "_spans": F.lit(2), "start": F.lit(0)})
    got = P.personal_data(df).collect()
    want = sorted((str(d), hashlib.sha256(",".join(brute(t)).encode()).hexdigest(), tuple(sum(s.startswith(k) for s in brute(t)) for k in P.KINDS)) for d, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256, (r.n_email, r.n_ip, r.n_card, r.n_phone)) for r in got) == want
    spans = {}
    for r in got:
        spans.setdefault(r.doc_id, []).append(set(r.spans.split(",")))
    for d, t in rows:
        assert any(set(brute(t)) <= s for s in spans[d])


def test_bootstrap_finds_unseen_cards(spark):
    rows = [(i, f"text {i} card number 4{i:03d}111111111{i % 7}{i % 9}{c} paid today") for i in range(40) for c in range(10)]
    seeds = [(i, t) for i, t in rows if brute(t)]
    assert len(seeds) >= 30
    # the same context around numbers that the base pattern refuses
    rows = seeds + [(900, "here card number 4000123412341230 paid again"), (901, "in the year 20231234 all was well"), (902, "x 20231234 y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in P.personal_data(df).collect()}
    assert brute(rows[-3][1]) == [] and got[900] == "card:17:33"
    assert got[901] == got[902] == ""


def test_bootstrap_finds_values_without_digits_and_spaced_groups(spark):
    rows = []
    for i in range(40):
        rows += [(i, f"e-mail: user{i}@mail.example.com thanks"), (100 + i, f"please call +1 (555) 555-{1000 + i} tonight"), (200 + i, f"my card 4111 1111 1111 1111 and text {i}")]
    cards = [f"{n:015d}" for n in range(400000000000000, 400000000000040)]
    rows += [(300 + i, f"my card {c[:4]} {c[4:8]} {c[8:12]} {c[12:]}{next(d for d in '0123456789' if luhn(c + d))} expired") for i, c in enumerate(cards)]
    rows += [(900, "e-mail: maria.lopez@intranet thanks"), (901, "please call (555) 123-4567 tonight"), (902, "my card 4000 1234 1234 1231 expired"), (903, "in 2024 the plain words stand alone")]
    assert all(brute(t) == [] for i, t in rows if i >= 900)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans.split(",") for r in P.personal_data(df).collect()}
    assert "email:8:28" in got[900] and "phone:12:26" in got[901] and "card:8:27" in got[902] and got[903] == [""]
    clean = {r.doc_id: r.text for r in P.redact(df).collect()}
    assert clean[900] == "e-mail: <EMAIL> thanks" and clean[901] == "please call <PHONE> tonight"
    assert clean[902] == "my card <CARD> expired" and clean[903] == rows[-1][1]


def test_redact(spark):
    rows = [(1, "mail a.b@c.org or +1 (555) 555-1234."), (2, None), (3, "é 10.0.0.1"), (None, "10.0.0.1"), (4, "plain")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1))
    got = P.redact(df)
    assert got.columns == df.columns
    assert {(r.doc_id, r.text) for r in got.collect()} == {(1, "mail <EMAIL> or <PHONE>."), (2, None), (3, "é <IP>"), (None, "<IP>"), (4, "plain")}


def test_empty_table(spark):
    assert P.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_elements_are_the_tokens_and_the_words_between(spark):
    rng = random.Random(8)
    alphabet = ["a", "Z", "7", ".", "_", "%", "+", "@", "/", "=", "-", ":", " ", ",", "(", "\n", "\u00e9", "\U0001f600"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(500)] + ["-" * 30000, "=" * 5000 + "a", ""]
    other = r"|[^\x00-\x7F]+|[=:]"
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", F.regexp_extract_all("text", F.lit(P.ELEMENT), F.lit(0)).alias("new"), F.regexp_extract_all("text", F.lit(P.TOKENS["token"] + other), F.lit(0)).alias("old"))
    assert all(r.new == r.old for r in got.collect())


def test_last_word_is_the_first_of_the_reversed_text(spark):
    rows = [("one two, ", "two"), ("x = ", "="), (" ", None), ("a" * 50 + "B", "a" * 39 + "b"), ("?!", None), ("", None), ("w" + " " * 20000, "w"), ("\u00e9T\u00e9-", "\u00e9t\u00e9")]
    df = spark.createDataFrame(rows, "text string, want string")
    assert [r.got for r in df.select(P._word(F.col("text"), -1).alias("got")).collect()] == [w for _, w in rows]


def test_only_wanted_patterns_become_rows(spark):
    """The array that is exploded holds the patterns asked for, not all of a place."""
    from tabspark.llm.common import bitmap

    wanted = spark.createDataFrame([("call _",), ("call _ now",)], "pattern string")
    bits = bitmap(wanted.select(F.xxhash64("pattern")))
    places = spark.createDataFrame([("call", "now"), ("call", "then"), ("see", "now"), ("see", "then")], "l string, r string")
    got = places.select(P._wanted(P._pattern_list(F.col("l"), F.col("r")), bits).alias("p")).collect()
    assert [sorted(r["p"]) for r in got] == [["call _", "call _ now"], ["call _"], [], []]


def test_only_tokens_beside_patterns_become_rows(spark):
    """A text's other elements leave no rows where places are counted (they did, by an explode of the whole text)."""
    text = "plain words " * 300 + "call 99@x now and call abc-7. " + "more = words " * 300
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "call nobody"), (3, None)], "doc_id long, text string")
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    tokens = P._tokens(docs, spark.createDataFrame([("call _",)], "pattern string"))
    assert "posexplode" not in tokens._jdf.queryExecution().optimizedPlan().toString()
    want = [(d, text.index(v), text.index(v) + len(v), v) for d in (1, None) for v in ("99@x", "abc-7")] + [(2, 5, 11, "nobody")]
    assert sorted([(r.doc_id, r.start, r.end, r.value) for r in tokens.collect()], key=str) == sorted(want, key=str)


def test_lengths_cut_a_text_once(spark):
    """The pieces are an argument of the lambda's function; looked up inside it, the split ran once a match."""
    docs = spark.createDataFrame([("ab 1 c", 0), ("", 0)], "text string, n int")
    cut = docs.select(F.split("text", P.ELEMENT, -1).alias("p"), P._elements().alias("m"))
    lens = P._lengths(cut).select("lens", "blocks")
    assert not re.search(r"length\((get\()?split\(", lens._jdf.queryExecution().optimizedPlan().toString())
    assert [(r.lens, r.blocks) for r in lens.collect()] == [([2, 2, 2], [6]), ([], [0])]


def test_words_of_elements_stand_beside_them(spark):
    rng = random.Random(9)
    alphabet = ["a", "Z", "7", ".", "_", "%", "+", "@", "/", "=", "-", ":", " ", ",", "\u00e9", "\U0001f600"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(500)] + ["-" * 30000, "end. of, text"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select(P._elements().alias("m"), F.regexp_extract_all("text", F.lit(P.ONE_WORD), F.lit(1)).alias("w")).collect()
    for r in got:
        assert len(r.m) == len(r.w) and all(w in ("", m.rstrip("._%+@/-")) for m, w in zip(r.m, r.w))
    assert got[-1].w == ["end", "of", "text"]


def test_patterns_far_too_common_go_after_few_texts(spark):
    """Of them no row is made in the scan of all texts (rows of every induced pattern were, to be counted)."""
    texts = [f"the w{i}x{j} and" for i in range(1200) for j in range(2)] + ["call n1"] * 5
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    induced = spark.createDataFrame([("the _", 3), ("call _", 3), ("the _ and", 3), ("_ other", 3)], "pattern string, support long")
    rare = P._rare(docs, induced)
    assert sorted(r.pattern for r in rare.collect()) == ["_ other", "call _"]
    assert {r.pattern: r.instances for r in P._instances(P._hits(docs, rare), rare.select("pattern")).collect()} == {"call _": 1}
