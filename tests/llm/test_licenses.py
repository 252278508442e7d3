import random

import pytest
from pyspark.sql import functions as F

from tabspark.llm import licenses as L
from tabspark.llm.common import words_of


def brute(words, index):
    out = []
    for k, t in enumerate(index.templates):
        for s in range(len(words)):
            if tuple(words[s : s + len(t.phrase)]) == t.phrase:
                first = s - t.at
                good = [index.idf[w] for i, w in enumerate(t.words) if 0 <= first + i < len(words) and words[first + i] == w]
                out.append((k, s, sum(good) / sum(index.idf[w] for w in t.words)))
    return sorted(out, key=lambda f: (f[1], f[0]))


def corpus():
    rng = random.Random(4)
    vocab = sorted({w for t in L.all_templates() for w in t.words}) + ["x", "y", "é"]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(40)))) for i in range(150)]
    for i in range(150):
        t = rng.choice(L.all_templates())
        w = [x if rng.random() < 0.9 else "z" for x in t.words]
        rows.append((200 + i, f"x y {' '.join(w).title()}. {rng.choice(['CC BY-NC 4.0', 'All rights  reserved', ''])}"))
    return rows + [(900, None), (901, ""), (None, "CC-BY"), (902, "cc by " * 3000), (902, "cc by " * 3000)]


def test_scan_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"w": F.lit(1), "labels": F.lit("q")})
    index = L.build_index(df)
    got = sorted((str(r.doc_id), *r[1:]) for r in L.scan(df, index).collect())
    want = []
    for d, text in rows:
        words = words_of(text)
        found = brute(words, index)
        base = [(index.templates[k].label, s) for k, s, _ in found if index.templates[k].base]
        at = [s for _, s in base]
        want.append((str(d), len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for x, _ in base})),
                     ",".join(sorted({index.templates[k].label for k, *_ in found})), round(max((s for *_, s in found), default=0.0), 6)))
    assert got == sorted(want)
    assert L.places(df, index).count() == sum(len(brute(words_of(t), index)) for _, t in rows)


def test_labels_and_templates(spark):
    index = L.build_index(spark.createDataFrame([], "text string"))
    label = lambda text: {index.templates[k].label: round(s, 2) for k, _, s in index.find(words_of(text))}
    assert label("Licensed under CC BY-NC 4.0.") == {"cc-by": 1.0, "cc-by-nc": 1.0}
    assert label("Released under the MIT License.") == {"mit": 1.0}
    assert set(label("GNU General Public License, version 3")) == {"gpl", "gpl-3.0"}
    assert label("the apache tribe has a license") == {}
    with pytest.raises(ValueError):
        L.all_templates([("x", "not inside", "some other words")])
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation ..."""
ISC = """Permission to use, copy, modify, and{} distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
GNU = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public
License as published by the Free Software Foundation; {}version {} of the License, or (at your option) any later version."""


def test_bodies_and_headers_have_labels(spark):
    index = L.build_index(spark.createDataFrame([], "text string"))
    label = lambda text: {index.templates[k].label for k, *_ in index.find(words_of(text))}
    assert label(MIT) == {"mit"} and label(ISC.format("/or")) == label(ISC.format("")) == {"isc"}
    for sep in ("either ", ""):
        assert label(GNU.format("", sep, "2")) == {"gpl", "gpl-2.0"} and label(GNU.format("", sep, "3")) == {"gpl", "gpl-3.0"}
        assert label(GNU.format("Lesser ", sep, "2.1")) == {"gpl", "lgpl"} and label(GNU.format("Affero ", sep, "3")) == {"gpl", "agpl"}
    assert label("a Creative Commons Attribution 4.0 International License") == {"cc-by"}
    assert label("Creative Commons Attribution-NonCommercial 4.0") == {"cc-by", "cc-by-nc"}
    # a piece of a body without its title and with a word missing keeps its label
    for t in index.templates:
        if len(t.words) > 150:
            cut = t.words[max(0, t.at - 40) : t.at + len(t.phrase) + 40]
            assert t.label in label(" ".join(cut[:-20] + cut[-19:])), t.label


def test_several_words_of_each_template_are_indexed(spark):
    index = L.build_index(spark.createDataFrame([], "text string"))
    for k, t in enumerate(index.templates):
        inside, around = index.chosen[k]
        assert len(inside) == min(L.INDEXED, len(t.phrase)) and len(around) == min(L.INDEXED, len(t.words) - len(t.phrase))
