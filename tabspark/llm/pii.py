"""Personal data: base patterns plus bootstrapped contextual extraction, DataFrame functions only.

Base spans come from fixed patterns and checks.  They seed the bootstrap: the words around each span
(by their WORD_CHARS nearest characters) are lexical patterns, every token and every group of digits
beside one of them is an instance, and the two form a graph of counted edges.  A few rounds score both
sides: a pattern's confidence for a kind is the share of its instances that are known to be of that
kind, an instance's score is the chance that at least one of its confident patterns is right.
Instances that end above the bar are spans of the kind too, wherever they stand outside base spans.

A pattern is induced by MIN_SUPPORT distinct seeds.  Patterns of which the seeds are less than OPEN_SHARE
of the distinct instances (words such as "the", which stand beside everything) are never opened.  Those
that are far beyond it already in a few texts go first; one scan of all texts then finds the instances of
all others, which are counted, and those of opened patterns become tokens.  The graph holds the instances of the opened patterns, aggregated by (pattern, instance) before any join;
rounds are written to the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, col_of, in_bitmap, kept_rows, saved

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns in a form without repeated scanning: possessive runs, and starts only
# where a run of the first class begins (or the previous match ended).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without these has no match that passes the checks.
NEEDED = {
    "email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]++\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){13}",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9]){9}",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
# Instances: every token, and digit groups joined by spaces, brackets and hyphens.
TOKENS = {
    "token": r"(?<![A-Za-z0-9._%+@/=-])[._%+@/=-]*+[A-Za-z0-9][A-Za-z0-9._%+@/=-]*+",
    "group": r"(?<![A-Za-z0-9._%+@/=-])[+(]{0,2}+[0-9][0-9\x20()-]*+(?:(?<=[\x20()-])|(?!\.?[A-Za-z0-9_%@/=]))",
}
EDGES = {"token": "._%+@/=-", "group": " (-"}  # characters cut off at the end (of a token at either end)
# What a text is cut into to find the context of its tokens: tokens, and the words between them.
# The tokens are those of TOKENS, in a form that looks behind only at signs.
# Characters one by one, not ranges: Java looks a class of single characters up in one table.
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
ELEMENT = "|".join((
    rf"[{_ALNUM}][{_ALNUM}._%+@/=-]*",
    rf"[._%+@/=-](?<![._%+@/=-]{{2}})[._%+@/=-]*+[{_ALNUM}][{_ALNUM}._%+@/=-]*",
    r"[^\x00-\x7F]+",
    "[=:]",
))
# The same elements; group 1 is the word of those that are one word with or without signs behind it, else empty.
ONE_WORD = (
    rf"([{_ALNUM}]++|[^\x00-\x7F]++)(?:(?<=[^\x00-\x7F])|[._%+@/-]*+(?![{_ALNUM}=]))|" + ELEMENT
)
BLOCK = 64  # tokens whose lengths are summed once
WORD_CHARS = 40  # nearest characters by which a context word is known
ROUNDS = 3
MIN_SUPPORT = 3  # distinct seeds a pattern needs
OPEN_SHARE = 0.1  # of a pattern's distinct instances that are seeds, for it to be opened
LOOK = 16  # patterns far too common are known from one text in so many, before all texts are searched
MIN_CONFIDENCE = 0.6  # of a pattern
MIN_SCORE = 0.8  # of a discovered instance


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = _digits(value)
    n = F.length(d)

    def add(total, i):
        v = F.substr(d, n - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, v).otherwise(v * 2 - F.when(v > 4, 9).otherwise(0))

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return F.when(n.between(14, 19), total % 10 == 0).otherwise(False)


def _valid(kind: Column, value: Column) -> Column:
    return (
        F.when(kind == "ip", value.rlike("^" + r"\.".join([_PART] * 4) + "$"))
        .when(kind == "card", _luhn(value))
        .when(kind == "phone", F.length(_digits(value)).between(10, 15))
        .otherwise(True)
    )


_W = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # a character of a context word; = and : are words too
_FIRST = rf"^(?:(?!{_W})[^=:])*+({_W}{{1,{WORD_CHARS}}}|[=:])"


def _word(text: Column, side: int) -> Column:
    """The last (-1) or first (1) context word of a text in lower case, null where it has none.

    The last one is the first of the reversed text: one anchored scan, whatever the length.
    """
    turned = F.reverse if side < 0 else lambda c: c
    found = F.lower(turned(F.regexp_extract(turned(text), _FIRST, 1)))
    return F.when(text != " ", F.nullif(found, F.lit("")))


def _plain_word(word: Column, side: int) -> Column:
    """``_word`` of a single word."""
    return F.lower(F.right(word, F.lit(WORD_CHARS)) if side < 0 else F.left(word, F.lit(WORD_CHARS)))


def _neighbours(pieces: Column, matches: Column, i: Column) -> tuple[Column, Column]:
    """The words before and after match ``i``: of the piece beside it, else of the match beyond, which has one."""
    left = F.coalesce(_word(F.get(pieces, i), -1), _word(F.get(matches, i - 1), -1), F.lit("^"))
    right = F.coalesce(_word(F.get(pieces, i + 1), 1), _word(F.get(matches, i + 1), 1), F.lit("$"))
    return left, right


def _raw_matches(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, text_hash, kind, start, end, value, before, after) of every pattern's matches
    in the texts that may hold valid ones.

    The pieces between matches give their places: start = lengths of all pieces and matches before.
    """
    text = F.col("text")
    kinds = PATTERNS
    cut = docs
    for kind, pattern in kinds.items():
        use = text.rlike(NEEDED[kind])
        cut = cut.withColumn(f"p_{kind}", F.when(use, F.split(text, pattern, -1)))
        cut = cut.withColumn(f"m_{kind}", F.when(F.col(f"p_{kind}").isNotNull(), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    empty = F.array().cast("array<struct<kind:string,pos:int,gap:int,value:string,before:string,after:string>>")

    def structs(kind: str) -> Column:
        piece = F.col(f"p_{kind}")
        one = lambda m, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("pos"),
            F.length(F.get(piece, i)).alias("gap"),
            m.alias("value"),
            _neighbours(piece, F.col(f"m_{kind}"), i)[0].alias("before"),
            _neighbours(piece, F.col(f"m_{kind}"), i)[1].alias("after"),
        )
        return F.coalesce(F.transform(f"m_{kind}", one), empty)

    parts = [structs(kind) for kind in kinds]
    rows = cut.select("uid", "doc_id", "text_hash", F.explode_outer(F.concat(*parts)).alias("m"))
    rows = saved(rows.filter("m is not null").select("uid", "doc_id", "text_hash", "m.*"), "pii-matches")
    order = Window.partitionBy("uid", "kind").orderBy("pos")
    end = F.sum(F.col("gap") + F.length("value")).over(order).cast("int")
    placed = rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))
    return placed.select("uid", "doc_id", "text_hash", "kind", "start", "end", "value", "before", "after")


def _patterns(before: Column, after: Column) -> Column:
    """Lexical patterns of a place: the word on either side, and both."""
    return F.array(*_pattern_list(before, after))


def _pattern_list(before: Column, after: Column) -> list[Column]:
    return [F.concat(before, F.lit(" _")), F.concat(F.lit("_ "), after), F.concat(before, F.lit(" _ "), after)]


def _wanted(patterns: list[Column], bits: Column) -> Column:
    """Those of the (different) patterns that may be in the bitmap: no row is made for the others."""
    some = [F.when(in_bitmap(bits, F.xxhash64(p)), p) for p in patterns]
    return F.array_except(F.array(*some), F.array(F.lit(None).cast("string")))


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda x, y: x + y)


def _lengths(cut: DataFrame) -> DataFrame:
    """Lengths of each piece with its match, and their sums by blocks: ends without a scan per match."""
    # Both arrays are arguments, not looked up by place: inlined into a lambda, a split would run once a match.
    cut = cut.withColumn("lens", F.zip_with(F.slice("p", F.lit(1), F.size("m")), "m", lambda p, m: F.length(p) + F.length(m)))
    starts = F.sequence(F.lit(0), F.floor(F.size("lens") / BLOCK).cast("int"))
    return cut.withColumn("blocks", F.transform(starts, lambda b: _total(F.slice("lens", b * BLOCK + 1, F.lit(BLOCK)))))


def _end(pos: Column) -> Column:
    """Where match ``pos`` ends."""
    b = F.floor(pos / BLOCK).cast("int")
    return _total(F.slice("blocks", F.lit(1), b)) + _total(F.slice("lens", b * BLOCK + 1, pos % BLOCK + 1))


def _word_bits(patterns: DataFrame) -> tuple[Column, Column]:
    """Bitmaps of the context words of the patterns: those on the left and those on the right."""
    w = F.split("pattern", " ")
    bits = lambda word: bitmap(patterns.select(word.alias("w")).filter("w <> '_'").select(F.xxhash64("w")))
    return bits(F.get(w, 0)), bits(F.element_at(w, -1))


def _beside(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(the columns of ``docs`` without text, pos, raw, pattern): tokens of the texts beside the patterns
    (and rare others, of the same hash).

    Rows, not array functions: elements look at their neighbours, those beside a word of no pattern go
    at once, and only rows of the patterns leave the compiled loop.
    """
    bits = bitmap(patterns.select(F.xxhash64("pattern")))
    left_bits, right_bits = _word_bits(patterns)
    others = [c for c in docs.columns if c != "text"]
    cut = docs.select(*others, _elements().alias("m"), F.regexp_extract_all("text", F.lit(ONE_WORD), F.lit(1)).alias("w"))
    rows = cut.select(*others, "m", "w", F.posexplode("m").alias("pos", "raw"))
    before, behind = F.get("w", F.col("pos") - 1), F.get("w", F.col("pos") + 1)
    # Few and small calls: Java does not compile a method of more than 8000 bytes.
    may = before.isNull() | behind.isNull() | (before == "") | (behind == "")
    may = may | in_bitmap(left_bits, F.xxhash64(_plain_word(before, -1))) | in_bitmap(right_bits, F.xxhash64(_plain_word(behind, 1)))
    rows = rows.filter(may & F.col("raw").rlike("[A-Za-z0-9]"))
    left = F.when(before == "", _word(F.get("m", F.col("pos") - 1), -1)).otherwise(_plain_word(before, -1))
    right = F.when(behind == "", _word(F.get("m", F.col("pos") + 1), 1)).otherwise(_plain_word(behind, 1))
    rows = rows.select(*others, "pos", "raw", F.coalesce(left, F.lit("^")).alias("left"), F.coalesce(right, F.lit("$")).alias("right"))
    return rows.select(*others, "pos", "raw", F.explode(_wanted(_pattern_list(F.col("left"), F.col("right")), bits)).alias("pattern"))


def _elements() -> Column:
    return F.regexp_extract_all("text", F.lit(ELEMENT), F.lit(0))


def _hits(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, text_hash, pos, raw, pattern): the elements beside the given patterns, written once."""
    return saved(_beside(docs.select("doc_id", "text_hash", "text"), patterns), "pii-hits")


def _tokens(docs: DataFrame, patterns: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_hash, start, end, value, patterns) of the instances beside the given patterns.

    ``hits``: the elements beside these and other patterns, if they have been found already.
    """
    bits, text = bitmap(patterns.select(F.xxhash64("pattern"))), F.col("text")
    keys = ["doc_id", "text_hash"]
    # One scan finds the tokens.  Their places are counted afterwards: each text that has some meets them in
    # one row, so only they become rows, not every element of such a text.
    hits = (_hits(docs, patterns) if hits is None else hits).filter(in_bitmap(bits, F.xxhash64("pattern")))
    hits = hits.groupBy(*keys).agg(F.collect_set(F.struct("pos", "raw", "pattern")).alias("hits"))
    hits = saved(hits.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "hits"), "pii-hits-by-text")
    cut = docs.filter(in_bitmap(bitmap(hits.select("_hash")), F.col("text_hash")))
    cut = _lengths(cut.select(*keys, F.split(text, ELEMENT, -1).alias("p"), _elements().alias("m"))).select(*keys, "lens", "blocks")
    cut = cut.join(hits.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash")))
    tokens = cut.select(*keys, "lens", "blocks", F.explode("hits").alias("t"))
    tokens = tokens.select(*keys, (_end(F.col("t.pos")) - F.length("t.raw")).alias("start"), "t.raw", "t.pattern")
    skip = F.length("raw") - F.length(F.ltrim("raw", F.lit(EDGES["token"])))  # without the punctuation around it
    tokens = tokens.withColumn("start", F.col("start") + skip).withColumn("raw", F.ltrim("raw", F.lit(EDGES["token"])))

    cut = docs.filter(text.rlike("[0-9]"))
    cut = cut.select(*keys, F.split(text, TOKENS["group"], -1).alias("p"), F.regexp_extract_all(text, F.lit(TOKENS["group"]), F.lit(0)).alias("m"))
    # Each piece and match gives its first and last word once; a group's context are its neighbours'.
    for name, column, side in (("pl", "p", -1), ("pf", "p", 1), ("ml", "m", -1), ("mf", "m", 1)):
        cut = cut.withColumn(name, _words(column, side))
    left = lambda i: F.coalesce(F.get("pl", i), F.get("ml", i - 1), F.lit("^"))
    right = lambda i: F.coalesce(F.get("pf", i + 1), F.get("mf", i + 1), F.lit("$"))
    one = lambda m, i: F.struct(i.alias("pos"), m.alias("raw"), _patterns(left(i), right(i)).alias("patterns"))
    rows = _lengths(cut).select(*keys, "lens", "blocks", F.explode(F.transform("m", one)).alias("t"))
    rows = rows.select(*keys, "lens", "blocks", "t.pos", "t.raw", F.explode("t.patterns").alias("pattern")).filter(in_bitmap(bits, F.xxhash64("pattern")))
    groups = rows.select(*keys, (_end(F.col("pos")) - F.length("raw")).alias("start"), "raw", "pattern")

    rows = tokens.withColumn("raw", F.rtrim("raw", F.lit(EDGES["token"]))).union(groups.withColumn("raw", F.rtrim("raw", F.lit(EDGES["group"]))))
    rows = rows.select(*keys, "start", (F.col("start") + F.length("raw")).alias("end"), F.col("raw").alias("value"), "pattern")
    # A plain number is a token and a group.
    return rows.groupBy(*keys, "start", "end", "value").agg(F.collect_set("pattern").alias("patterns"))


def _words(column: str, side: int) -> Column:
    return F.transform(column, lambda t: _word(t, side))


def _rare(docs: DataFrame, induced: DataFrame) -> DataFrame:
    """The patterns that may be opened: without those that have too many instances in a few texts alone.

    No pattern has fewer instances in all texts than in some.  The estimates are off by a few hundredths,
    and a pattern goes only at twice the limit, so it would not be opened by the count over all texts.
    """
    some = docs.filter(F.pmod("text_hash", F.lit(LOOK)) == 0)
    seen = _instances(_beside(some.select("text"), induced), induced.select("pattern"))
    often = induced.join(seen.withColumnRenamed("pattern", "_pattern"), F.col("pattern") == F.col("_pattern"), "left")
    often = often.filter(F.col("support") >= OPEN_SHARE / 2 * F.coalesce("instances", F.lit(0)))
    return saved(often.select("pattern", "support"), "pii-rare")


def _instances(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, instances): distinct instances (``raw`` of the rows) of each given pattern, estimated; one row a pattern."""
    counts = rows.groupBy(F.xxhash64("pattern").alias("h")).agg(F.approx_count_distinct(F.xxhash64("raw")).alias("instances"))
    return patterns.join(counts, F.xxhash64("pattern") == F.col("h")).select("pattern", "instances")


def _outside(tokens: DataFrame, base: DataFrame) -> DataFrame:
    """The tokens that overlap no base span: a running end before and the next start behind each."""
    rows = tokens.select("doc_id", "text_hash", "start", "end", "value", "patterns", F.lit(False).alias("b"))
    spans = base.select("doc_id", "text_hash", "start", "end", F.lit(None).cast("string").alias("value"), F.lit(None).cast("array<string>").alias("patterns"), F.lit(True).alias("b"))
    spans = kept_rows(spans, [F.col("doc_id"), F.col("text_hash")], tokens.select("doc_id", "text_hash").distinct(), "left_semi")
    order = Window.partitionBy("doc_id", "text_hash").orderBy("start")
    before = F.max(F.when(F.col("b"), F.col("end"))).over(order)
    behind = F.min(F.when(F.col("b"), F.col("start"))).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    all_rows = rows.union(spans).withColumn("before", before).withColumn("behind", behind)
    free = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.col("behind").isNull() | (F.col("behind") >= F.col("end")))
    return all_rows.filter(~F.col("b") & free).drop("b", "before", "behind")


def score_graph(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, confidence) and (inst, kind, score) of the instances that are no seeds.

    ``edges``: distinct (pattern, inst); ``seeds``: distinct (inst, kind).
    """
    totals = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("total"))
    known = seeds.withColumn("w", F.lit(1.0)).withColumn("seed", F.lit(1))
    patterns = found = None
    for _ in range(rounds):
        good = edges.join(known, "inst").groupBy("pattern", "kind").agg(F.sum("w").alias("good"), F.sum("seed").alias("support"))
        confidence = F.col("good") / (F.col("total") + 1)
        patterns = good.filter(F.col("support") >= MIN_SUPPORT).join(totals, "pattern")
        patterns = patterns.select("pattern", "kind", confidence.alias("confidence")).filter(F.col("confidence") >= MIN_CONFIDENCE)
        patterns = saved(patterns, "pii-patterns")
        score = 1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.99)))))
        found = edges.join(patterns, "pattern").groupBy("inst", "kind").agg(score.alias("score"))
        found = saved(found.join(seeds.select("inst").distinct(), "inst", "left_anti"), "pii-instances")
        known = seeds.withColumn("w", F.lit(1.0)).withColumn("seed", F.lit(1)).union(
            found.select("inst", "kind", "score", F.lit(0))
        )
    return patterns, found


def find_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, spans) of documents that have any: spans is an array of
    (start, end, kind, value, base) by start, then kind; code points, end exclusive."""
    text = F.coalesce(col_of(text_col).cast("string"), F.lit(""))
    docs = df.select(col_of(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    # Row numbers hold within one evaluation only; the rounds meet on id and hash.
    raw = _raw_matches(docs.withColumn("uid", F.monotonically_increasing_id()))
    base = saved(raw.filter(_valid(F.col("kind"), F.col("value"))), "pii-base")
    seeds = saved(base.select(F.col("value").alias("inst"), "kind").distinct(), "pii-seeds")
    beside = base.select(F.explode(_patterns(F.col("before"), F.col("after"))).alias("pattern"), F.col("value").alias("inst"), "kind").distinct()
    beside = saved(beside, "pii-beside")
    induced = beside.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= MIN_SUPPORT)
    induced = saved(induced.groupBy("pattern").agg(F.max("support").alias("support")), "pii-induced")
    if induced.isEmpty():
        return _arrays(base)
    # One scan of all texts serves the counts and, of the patterns that are opened, the tokens.
    rare = _rare(docs, induced)
    hits = _hits(docs, rare)
    seen = _instances(hits, rare.select("pattern")).withColumnRenamed("pattern", "_pattern")
    opened = rare.join(seen, F.col("pattern") == F.col("_pattern"), "left")
    # What stands beside a pattern only as part of a base span is no token; such a pattern is open.
    opened = opened.filter(F.col("support") >= OPEN_SHARE * F.coalesce("instances", F.lit(0)))
    opened = saved(opened.select("pattern"), "pii-opened")
    if opened.isEmpty():
        return _arrays(base)
    tokens = saved(_outside(saved(_tokens(docs, opened, hits), "pii-beside-tokens"), base), "pii-tokens")
    edges = beside.select("pattern", "inst").union(tokens.select(F.explode("patterns").alias("pattern"), F.col("value").alias("inst")))
    edges = saved(edges.distinct().join(opened, "pattern", "left_semi"), "pii-edges")
    _, found = score_graph(edges, seeds)
    best = found.filter(F.col("score") >= MIN_SCORE).groupBy("inst").agg(F.max(F.struct("score", "kind")).getField("kind").alias("found"))
    extra = tokens.join(best, F.col("value") == F.col("inst")).select("doc_id", "text_hash", "start", "end", F.col("found").alias("kind"), "value", F.lit(False).alias("base"))
    return _arrays(base, extra)


def _arrays(base: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    spans = base.select("doc_id", "text_hash", "start", "end", "kind", "value", F.lit(True).alias("base"))
    if extra is not None:
        spans = spans.union(extra)
    order = reduce(lambda c, k: c.when(F.col("kind") == k[1], k[0]), enumerate(KINDS), F.when(F.lit(False), 0))
    one = F.struct("start", order.alias("rank"), "end", "kind", "value", "base")
    # Repeated rows (same id and text) have the same spans.
    return saved(spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(one)).alias("spans")), "pii-spans")


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(col_of(text_col).cast("string"), F.lit("")))


def _keyed_spans(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return find_spans(df, id_col, text_col).select(
        F.col("doc_id").alias("_pii_doc"), F.col("text_hash").alias("_pii_hash"), F.col("spans").alias("_spans")
    )


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, counts of base spans by kind, base_sha256, spans.

    Null and empty texts have no spans; ids may be null or repeated; an empty table gives no rows;
    only the id and text columns are read, so further columns may have any name.
    """
    found = _keyed_spans(df, id_col, text_col)
    # Only ids and hashes meet the spans; no text is shuffled.
    docs = df.select(col_of(id_col).alias("doc_id"), _text_hash(text_col).alias("text_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_pii_doc")) & (F.col("text_hash") == F.col("_pii_hash"))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string,base:boolean>>")
    rows = docs.join(found, same, "left").select("doc_id", F.coalesce("_spans", empty).alias("s"))
    shown = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s.getField("kind"), s.getField("start").cast("string"), s.getField("end").cast("string"))), ","
    )
    base = F.filter("s", lambda s: s.getField("base"))
    count = lambda kind: F.size(F.filter("s", lambda s: s.getField("base") & (s.getField("kind") == kind))).cast("long")
    return rows.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("s")).alias("spans")
    )


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with every span of the text replaced by its kind, as <EMAIL>.

    Overlapping spans are replaced together, by the first one's kind.  Null texts stay null.
    """
    text = F.col("_row").getField(text_col)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(acc, s):
        out, at = acc.getField("out"), acc.getField("at")
        fresh = F.concat(out, F.substr(text, at + 1, s.getField("start") - at), F.lit("<"), F.upper(s.getField("kind")), F.lit(">"))
        return F.struct(
            F.when(s.getField("start") >= at, fresh).otherwise(out).alias("out"), F.greatest(at, s.getField("end")).alias("at")
        )

    done = F.aggregate("_spans", start, put)
    clean = F.concat(done.getField("out"), F.substr(text, done.getField("at") + 1, F.length(text)))
    # The spans grow with the corpus, so this is always a shuffled join: one plan at every size.  The
    # caller's columns travel in one struct, so they may have any names.
    found = _keyed_spans(df, id_col, text_col).hint("merge")
    packed = df.select(F.struct("*").alias("_row"), col_of(id_col).alias("_id"), _text_hash(text_col).alias("_hash"))
    same = F.col("_id").eqNullSafe(F.col("_pii_doc")) & (F.col("_hash") == F.col("_pii_hash"))
    rows = packed.join(found, same, "left")
    new = F.when(F.col("_spans").isNull(), text).otherwise(clean)
    return rows.select(*(new.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in df.columns))
