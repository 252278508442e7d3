"""Toxicity scores: Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned from labelled rows: words whose share of toxic documents is significantly
above the base rate.  A word of a text is matched by running the Levenshtein automaton of that word
along the trie of lexicon terms (no errors up to 3 letters, one up to 7, two beyond).  Misspelled
variants count with the precision seen for that very word, or else the pooled precision of its
term's variants, so terms that ordinary words resemble do not spread to them.  Each match is judged in a window of neighbouring characters: inside quotation
marks or after a reporting word it is a mention and weighs as such mentions did in the labelled
rows; otherwise it is abuse.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, col_of, words_col

MAX_LABELS = 20_000  # labelled rows a model is fitted on, chosen by a hash of their ids; bounds the lexicon too
MIN_PRECISION = 0.6  # share of toxic documents that a term needs
MIN_EVIDENCE = 0.5  # precision from which a matched word counts
PRIOR = 0.7  # precision of a variant that was never seen
OFTEN = 3  # documents from which a seen variant is judged by itself
ERROR_RATE = 0.01  # expected number of words that enter the lexicon by chance
WINDOW = 60  # characters on either side that decide between quotation and abuse
THRESHOLD = 0.3
_CACHE = 300_000  # words whose matches a Python worker remembers

# Words that report what somebody said (fixed values).
REPORTING = frozenset(
    "said says say called calls calling quote quotes quoted quoting word words term insult insults slur phrase".split()
)
_OPEN, _CLOSE = "\"“«„‘", "\"”»“’"


def allowed_errors(term: str) -> int:
    return 0 if len(term) <= 3 else 1 if len(term) <= 7 else 2


class Lexicon:
    """Levenshtein automata of all terms, intersected with the terms' trie.

    A state is a set of positions: trie nodes with the fewest errors that lead there, for the part of
    a word read so far.  States and their transitions are determinized when first met and kept, so a
    word costs one table look-up per letter and most words reach the dead state after a few.
    """

    _STATES = 30_000  # states kept before the tables start anew

    def __init__(self, terms: dict[str, int] | list[str], seen: dict[str, tuple[int, str]] | None = None):
        """``terms``: allowed errors by term (a plain list: ``allowed_errors``); ``seen``: known matches."""
        self.seen = seen or {}
        terms = terms if isinstance(terms, dict) else {t: allowed_errors(t) for t in terms}
        self.next: list[dict[str, int]] = [{}]  # by trie node
        self.term: list[str | None] = [None]
        self.limit = [0]  # most errors that a term below the node allows
        self.errors = terms
        for term, k in sorted(terms.items()):
            node = 0
            self.limit[0] = max(self.limit[0], k)
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.term.append(None)
                    self.limit.append(0)
                node = self.next[node][c]
                self.limit[node] = max(self.limit[node], k)
            self.term[node] = term
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.positions: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[int, str] | None] = []
        self.known: dict[str, tuple[int, str] | None] = dict(self.seen)
        self._state({0: 0})

    def _state(self, at: dict[int, int]) -> int:
        """The id of a set of positions, closed under missing letters; -1 if it is empty."""
        todo = sorted(at, key=at.get)
        for node in todo:  # grows while it runs
            e = at[node] + 1
            for child in self.next[node].values():
                if e <= self.limit[child] and e < at.get(child, 99):
                    at[child] = e
                    todo.append(child)
        if not at:
            return -1
        key, terms = frozenset(at.items()), self.errors
        if key not in self.ids:
            self.ids[key] = len(self.moves)
            self.positions.append(at)
            self.moves.append({})
            ends = ((e, self.term[n]) for n, e in at.items() if self.term[n] and e <= terms[self.term[n]])
            self.found.append(min(ends, default=None))
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        at: dict[int, int] = {}
        for node, e in self.positions[state].items():
            if e < self.limit[node]:  # a letter too many
                at[node] = min(at.get(node, 99), e + 1)
            for letter, child in self.next[node].items():
                cost = e + (letter != c)
                if cost <= self.limit[child] and cost < at.get(child, 99):
                    at[child] = cost
        self.moves[state][c] = new = self._state(at)
        return new

    def match(self, word: str) -> tuple[int, str] | None:
        """(errors, term) of the nearest term, the first in the alphabet on ties; else None."""
        if word in self.known:
            return self.known[word]
        if len(self.known) >= _CACHE or len(self.moves) >= self._STATES:
            self._reset()
        state = 0
        for c in word:
            new = self.moves[state].get(c)
            state = self._move(state, c) if new is None else new
            if state < 0:
                break
        self.known[word] = found = self.found[state] if state >= 0 else None
        return found


def is_quoted(text: str, start: int, end: int) -> bool:
    """Whether a match stands inside quotation marks or shortly after a reporting word."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    before, after = before.rpartition("\n")[2], after.partition("\n")[0]
    for o, c in zip(_OPEN, _CLOSE):
        inside = before.count(o) % 2 if o == c else before.rfind(o) > before.rfind(c)
        if inside and c in after:
            return True
    return any(w in REPORTING for w in WORD.findall(before)[-4:])


def find_matches(text: str | None, lexicon: Lexicon) -> list[tuple[str, int, str, int, int, bool]]:
    """(word, errors, term, start, end, quoted) of every match in the whole text."""
    if not text:
        return []
    low, match, out = ascii_lower(text), lexicon.match, []
    if not any(match(w) for w in set(WORD.findall(low))):
        return out
    for m in WORD.finditer(low):
        found = match(m[0])
        if found:
            out.append((m[0], *found, m.start(), m.end(), is_quoted(low, m.start(), m.end())))
    return out


@dataclass
class Model:
    base: float = 0.1  # share of toxic documents without any match
    rate: float = 0.1  # share of toxic documents
    mention: float = 0.25  # weight of a quoted match
    terms: list[str] = field(default_factory=list)
    seen: dict[str, tuple[int, str]] = field(default_factory=dict)  # errors and term of the words in precision
    precision: dict[str, float] = field(default_factory=dict)  # of words seen often in labelled rows
    rare: dict[tuple[str, int], float] = field(default_factory=dict)  # of other variants, by term and errors

    @cached_property
    def lexicon(self) -> Lexicon:
        """What can count: seen words by look-up, and unseen variants of the terms whose variants count.

        A term that ordinary words resemble has a low precision for variants; walking its
        neighbourhood in every text could only yield matches of no weight.
        """
        limits = {}
        for t in self.terms:
            k = allowed_errors(t)
            while k and self.rare.get((t, k), PRIOR) < MIN_EVIDENCE:
                k -= 1
            limits[t] = k
        return Lexicon(limits, self.seen)

    def weigh(self, word: str, errors: int, term: str) -> float:
        """Evidence (0 to 1) of one word: its precision above the share of toxic documents."""
        w = self.precision.get(word, self.rare.get((term, errors), PRIOR))
        return (w - self.rate) / (1 - self.rate) if w >= MIN_EVIDENCE else 0.0

    def score(self, text: str | None) -> float:
        direct, quoted = {}, {}
        for word, errors, term, _, _, is_quote in find_matches(text, self.lexicon):
            (quoted if is_quote else direct)[word] = self.weigh(word, errors, term)
        clean = 1.0
        for w in direct.values():
            clean *= 1 - w
        evidence = max([1 - clean, *(w * self.mention for w in quoted.values())])
        return self.base + (1 - self.base) * evidence**2  # a lone weak sign stays below the threshold


def _rate(good: float, n: float, prior: float, weight: float) -> float:
    return (good + prior * weight) / (n + weight)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", limit: int = MAX_LABELS
) -> DataFrame:
    """(text, label) of at most ``limit`` labelled rows: all of them, or those with the smallest hashes.

    The bound makes the labels small enough to broadcast, so no text is shuffled.
    """
    rows = labels.select(col_of(id_col).alias("_label_id"), col_of(label_col).alias(label_col)).dropna()
    chosen = rows.orderBy(F.xxhash64("_label_id"), "_label_id").limit(limit)
    texts = docs.select(col_of(id_col).alias("_doc"), col_of(text_col).cast("string").alias(text_col))
    return texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_label_id")).select(text_col, label_col)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn a model from labelled rows; null labels and empty tables teach nothing."""
    rows = labelled.select(
        col_of(text_col).cast("string").alias("text"), (col_of(label_col) > 0).cast("int").alias("y")
    ).filter("y is not null")
    vocabulary = (
        rows.select("y", F.explode(F.array_distinct(words_col(F.col("text")))).alias("word"))
        .groupBy("word")
        .agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n"))
        .persist()
    )
    total = rows.agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not total["t"] or total["t"] == total["n"]:
        vocabulary.unpersist()
        return Model(base=_rate(total["t"] or 0, total["n"], 0.1, 1))
    p = total["t"] / total["n"]
    n_words = vocabulary.count()
    t, n = F.col("t"), F.col("n")
    gain = t * F.log(t / (n * p)) + F.when(n > t, (n - t) * F.log((n - t) / (n * (1 - p)))).otherwise(0)
    significant = vocabulary.filter((t > 0) & (t / n >= MIN_PRECISION)).withColumn("g", gain)
    significant = significant.filter(F.col("g") > math.log(max(n_words, 2) / ERROR_RATE))
    best = significant.orderBy(F.desc("g"), "word").collect()  # words of the bounded sample
    model = Model(terms=[r["word"] for r in best])

    # Seen words that match the lexicon, with their labels.
    terms, model.rate = model.terms, p

    def match_words(batches):
        lexicon = Lexicon(terms)
        for pdf in batches:
            found = [lexicon.match(w) or (-1, None) for w in pdf["word"]]
            pdf = pdf.assign(errors=[f[0] for f in found], term=[f[1] for f in found])
            yield pdf[pdf["errors"] >= 0]

    if terms:
        seen = vocabulary.mapInPandas(match_words, "word string, t long, n long, errors int, term string").persist()
        # By words, not documents: one frequent clean word near a term says little about its misspellings.
        pool = seen.filter("errors > 0").groupBy("term", "errors")
        pool = pool.agg(F.sum((2 * t > n).cast("int")).alias("t"), F.count(F.lit(1)).alias("n"))
        for r in pool.collect():  # two rows a term at most
            model.rare[r["term"], r["errors"]] = _rate(r["t"], r["n"], PRIOR, 3)
        often = seen.filter((F.col("errors") == 0) | (n >= OFTEN)).orderBy(F.desc("n"), "word")
        for r in often.collect():
            prior = model.rare.get((r["term"], r["errors"]), PRIOR) if r["errors"] else p
            model.precision[r["word"]] = _rate(r["t"], r["n"], prior, 1)
            model.seen[r["word"]] = (r["errors"], r["term"])
        seen.unpersist()
    vocabulary.unpersist()

    def judge(batches):
        lexicon = model.lexicon
        for pdf in batches:
            kind = []
            for text in pdf["text"]:
                found = [m for m in find_matches(text, lexicon) if model.weigh(*m[:3]) > 0]
                kind.append("none" if not found else "mention" if all(m[-1] for m in found) else "abuse")
            yield pd.DataFrame({"kind": kind, "y": pdf["y"]})

    kinds = rows.mapInPandas(judge, "kind string, y int").groupBy("kind")
    counts = {r["kind"]: (r["t"], r["n"]) for r in kinds.agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    model.base = _rate(*counts.get("none", (0, 0)), p, 1)
    model.mention = _rate(*counts.get("mention", (0, 0)), 0.25, 10)
    return model


def score_column(model: Model, text: Column) -> Column:
    """The toxicity score (0 to 1) of a text column; null and empty texts score the base rate."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return F.pandas_udf(run, "double")(text.cast("string"))


def explain(model: Model, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match: doc_id, word, term, errors, start, end (characters), quoted, weight."""
    rows = df.select(col_of(id_col).alias("doc_id"), col_of(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = [
                (d, w, term, e, s, t, q, model.weigh(w, e, term) * (model.mention if q else 1))
                for d, text in zip(pdf["doc_id"], pdf["text"])
                for w, e, term, s, t, q in find_matches(text, model.lexicon)
            ]
            yield pd.DataFrame(out, columns=["doc_id", "word", "term", "errors", "start", "end", "quoted", "weight"])

    return rows.mapInPandas(
        run, f"doc_id {kind}, word string, term string, errors int, start int, end int, quoted boolean, weight double"
    )
