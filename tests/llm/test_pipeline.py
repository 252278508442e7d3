import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from tabspark.llm import simhash
from tabspark.llm.q_toxicity import toxicity_model
from tabspark.llm.tokenize import default_path, tokens

from .test_decontaminate import brute as brute_leaks
from .test_pii import brute as brute_spans
from .test_simhash import brute_components, brute_fingerprint

ROOT = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    model = toxicity_model(spark, docs, ROOT)
    for name, stage in C.STAGES:
        out = stage(spark, docs, ROOT).cache()
        got = out.collect()
        if name == "toxicity":
            want = {d for d, r in rows.items() if model.score(r.text) < 0.3}
        elif name == "simhash":
            comps = brute_components([(d, brute_fingerprint(r.text)) for d, r in sorted(rows.items())])
            want = set(comps.values())
        elif name == "decontaminate":
            want = {b[0] for b in brute_leaks([(d, r.text) for d, r in rows.items()], items) if not b[-1]}
        elif name == "pii":
            want = set(rows)
            for r in got:
                assert brute_spans(r.text) == [] and r.n_chars == len(r.text)
                if not brute_spans(rows[r.doc_id].text) and r.text != rows[r.doc_id].text:
                    assert "<" in r.text  # a discovered span
        else:
            bpe = tokens(default_path())
            assert {r.doc_id for r in got} == set(rows)
            assert sum(r.length for r in got) == sum(len(bpe.ids(r.text)) + 1 for r in rows.values())
            break
        assert out.columns == columns and len(got) == len(want) and {r.doc_id for r in got} == want
        if name != "pii":
            assert all(r == rows[r.doc_id] for r in got)
        docs, rows = out, {r.doc_id: r for r in got}


def test_deduplicate_odd_rows(spark):
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "x"), (2, "A b c d e", "y"), (None, "a b c d e", "z"), (None, None, "n"), (None, "", "n"), (5, "other words stand here now", "x"), (5, "and wholly different ones too", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumn("root", F.lit("clash"))
    got = simhash.deduplicate(df)
    assert got.columns == df.columns
    kept = sorted((str(r.doc_id), r.text or "") for r in got.collect())
    assert kept == [("1", "a b c d e"), ("5", "and wholly different ones too"), ("5", "other words stand here now"), ("None", "")]
    assert simhash.deduplicate(df.filter("doc_id > 99")).count() == 0


def test_entry_lists_every_operator():
    import __spark_entry__ as E

    names = E.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert "pipeline" not in E.oracle_sql()
