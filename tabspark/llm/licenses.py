"""Licence scans with a positional rare-token index.

Every licence template is a word sequence with a mandatory key phrase inside: notices, headers and
whole bodies.  The index maps words to postings (template, position): of each template the words
with the highest IDF over the corpus, some inside its key phrase and some around it.  A file's words
are looked up there and the postings are intersected by relative position: a place needs as many
postings as the phrase has indexed words, so words around it may be missing, and no place of the
whole phrase is lost.  There the whole key phrase is verified.  The share of the template's IDF that
stands at its own relative positions around the phrase is the score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cached_property
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col_of, words_col, words_of
from .license_texts import BODIES

# The contract's phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Further labels: (label, mandatory key phrase, template around it).
TEMPLATES = (
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "cc by nd", "licensed under cc by nd 4 0"),
    ("cc0", "cc0", "released under cc0 1 0 universal"),
    ("gpl-2.0", "general public license version 2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3.0", "general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("agpl", "affero general public license", "licensed under the gnu affero general public license version 3"),
    ("lgpl", "lesser general public license", "licensed under the gnu lesser general public license version 3"),
    ("mit", "mit license", "released under the mit license"),
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "bsd license", "released under the bsd license"),
    ("mpl", "mozilla public license", "subject to the terms of the mozilla public license version 2 0"),
    ("public-domain", "public domain", "dedicated to the public domain"),
    # Full names of the Creative Commons licences; their versions and suites follow the phrase.
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "creative commons attribution noncommercial", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "creative commons attribution non commercial", "this work is licensed under a creative commons attribution non commercial 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "creative commons attribution share alike", "this work is licensed under a creative commons attribution share alike 4 0 international license"),
    ("cc-by-nd", "creative commons attribution noderivatives", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nd", "creative commons attribution noderivs", "this work is licensed under a creative commons attribution noderivs 3 0 unported license"),
    ("cc0", "creative commons zero", "released under the creative commons zero v1 0 universal license"),
    # Standard headers of the GNU licences ("gnu" keeps lesser and affero apart from the plain licence).
    *(
        (label, f"{name} as published by the free software foundation {sep}version {v}",
         f"{what} is free software you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation {sep}version {v} of the license{later}")
        for label, name, v, what in (
            ("gpl-2.0", "gnu general public license", "2", "this program"), ("gpl-3.0", "gnu general public license", "3", "this program"),
            ("gpl-2.0", "the general public license", "2", "this program"), ("gpl-3.0", "the general public license", "3", "this program"),
            ("lgpl", "gnu lesser general public license", "2 1", "this library"), ("lgpl", "gnu lesser general public license", "3", "this library"),
            ("lgpl", "gnu library general public license", "2", "this library"), ("agpl", "gnu affero general public license", "3", "this program"),
        )
        for sep, later in (("either ", " or at your option any later version"), ("", ""))
    ),
    ("lgpl", "library general public license", "licensed under the gnu library general public license version 2"),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "isc license", "released under the isc license"),
    ("0bsd", "with or without fee is hereby granted the software is provided as is", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("apache-2.0", "apache org licenses license 2 0", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    *BODIES,
)
INDEXED = 4  # postings of a template: so many of its key phrase's rarest words, and of the words around it


@dataclass(frozen=True)
class Template:
    label: str
    phrase: tuple[str, ...]
    words: tuple[str, ...]
    at: int  # where the phrase stands in the words
    base: bool


def all_templates(extra=TEMPLATES) -> list[Template]:
    rows = [(label, phrase, phrase, True) for phrase, label in BASE.items()] + [(*t, False) for t in extra]
    out = []
    for label, phrase, text, base in rows:
        p, w = tuple(words_of(phrase)), tuple(words_of(text))
        at = next((i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p), None)
        if not p or at is None:
            raise ValueError(f"the key phrase of {label} does not stand in its template")
        out.append(Template(label, p, w, at, base))
    return out


@dataclass
class Index:
    """Templates and the IDF of their words; postings of each template's rarest words."""

    templates: list[Template]
    idf: dict[str, float]

    @cached_property
    def chosen(self) -> list[tuple[list[int], list[int]]]:
        """Of each template, where its indexed words stand: inside the key phrase, around it."""
        out = []
        for t in self.templates:
            ranked = sorted(range(len(t.words)), key=lambda i: (-self.idf[t.words[i]], i))
            inside = [i for i in ranked if t.at <= i < t.at + len(t.phrase)]
            around = [i for i in ranked if not t.at <= i < t.at + len(t.phrase)]
            out.append((inside[:INDEXED], around[:INDEXED]))
        return out

    @cached_property
    def postings(self) -> dict[str, list[tuple[int, int]]]:
        """(template, offset from the start of its key phrase) by word."""
        out: dict[str, list[tuple[int, int]]] = {}
        for k, (inside, around) in enumerate(self.chosen):
            for i in inside + around:
                out.setdefault(self.templates[k].words[i], []).append((k, i - self.templates[k].at))
        return out

    @cached_property
    def keys(self) -> dict[str, list[tuple[int, frozenset[str]]]]:
        """By the rarest word of a key phrase: the template and the phrase's indexed words."""
        out: dict[str, list[tuple[int, frozenset[str]]]] = {}
        for k, (inside, _) in enumerate(self.chosen):
            words = [self.templates[k].words[i] for i in inside]
            out.setdefault(words[0], []).append((k, frozenset(words)))
        return out

    def find(self, words: list[str]) -> list[tuple[int, int, float]]:
        """(template, start of the key phrase, score) of every verified place, by start."""
        seen = set(words)
        live = {k for w in self.keys.keys() & seen for k, need in self.keys[w] if need <= seen}
        if not live:
            return []
        hits = {w: [p for p in self.postings[w] if p[0] in live] for w in self.postings.keys() & seen}
        votes: Counter[tuple[int, int]] = Counter()
        for word, found in hits.items():
            at = -1
            for _ in range(words.count(word) if found else 0):
                at = words.index(word, at + 1)
                votes.update((k, at - offset) for k, offset in found)
        out = []
        for (k, start), n in votes.items():
            t = self.templates[k]
            if n >= len(self.chosen[k][0]) and start >= 0 and tuple(words[start : start + len(t.phrase)]) == t.phrase:
                out.append((k, start, self._score(t, words, start)))
        return sorted(out, key=lambda f: (f[1], f[0]))

    def _score(self, t: Template, words: list[str], start: int) -> float:
        first, n = start - t.at, len(words)
        total = sum(self.idf[w] for w in t.words)
        good = sum(self.idf[w] for i, w in enumerate(t.words) if 0 <= first + i < n and words[first + i] == w)
        return good / total


def build_index(df: DataFrame, text_col: str = "text", templates: list[Template] | None = None) -> Index:
    """IDF of the templates' words over every document of ``df``; an empty table gives equal IDFs."""
    templates = templates or all_templates()
    vocabulary = sorted({w for t in templates for w in t.words})
    words = words_col(col_of(text_col).cast("string"))
    present = df.select(F.array_distinct(F.filter(words, lambda w: w.isin(vocabulary))).alias("w"))
    found = present.select(F.explode_outer("w").alias("w")).groupBy("w").count().collect()  # at most the vocabulary
    counts = {r["w"]: r["count"] for r in found}
    n = df.count()
    return Index(templates, {w: log((n + 1) / (counts.get(w, 0) + 1)) + 1 for w in vocabulary})


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(df: DataFrame, index: Index | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the best template's share (0 without any).  Null and empty texts have no words;
    ids may be null or repeated; an empty table gives no rows; further columns are not read.
    """
    index = index or build_index(df, text_col)
    rows = df.select(col_of(id_col).alias("doc_id"), col_of(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def one(text):
        words = words_of(text)
        found = index.find(words)
        base = [(index.templates[k].label, s) for k, s, _ in found if index.templates[k].base]
        starts = [s for _, s in base]
        return (
            len(words),
            len(base),
            min(starts, default=None),
            max(starts, default=None),
            ",".join(sorted({label for label, _ in base})),
            ",".join(sorted({index.templates[k].label for k, _, _ in found})),
            round(max((s for *_, s in found), default=0.0), 6),
        )

    def run(batches):
        for b in batches:
            out = list(zip(*(one(t.as_py()) for t in b.column(1)))) or [()] * len(names)
            cols = [pa.array(c, t) for c, t in zip(out, types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def places(df: DataFrame, index: Index | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per verified place: doc_id, label, start, end (words), score."""
    index = index or build_index(df, text_col)
    rows = df.select(col_of(id_col).alias("doc_id"), col_of(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = [
                (i, index.templates[k].label, s, s + len(index.templates[k].phrase), score)
                for i, t in enumerate(b.column(1))
                for k, s, score in index.find(words_of(t.as_py()))
            ]
            row, label, start, end, score = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(label, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(score, pa.float64())],
                names=["doc_id", "label", "start", "end", "score"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, label string, start long, end long, score double")
