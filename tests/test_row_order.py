import numpy as np
import pytest
from pyspark.sql import functions as F

from tabspark.functions import row_order as R
from tabspark.operators import diagnostics as D
from tabspark.operators import prepare as P
from tabspark.operators.preview import preview
from tabspark.schema import DatasetSchema


@pytest.fixture()
def files(spark, scratch, monkeypatch):
    """Three files of 70, 1 and 129 rows (and an empty one), in no order of any column."""
    rows, at = [(i * 37 % 200, None if i % 11 == 0 else float(i % 13), "ab"[i % 3 == 0]) for i in range(200)], 0
    for name, n in (("a", 70), ("b", 1), ("c", 0), ("d", 129)):
        spark.createDataFrame(rows[at : at + n], "k long, x double, g string").coalesce(1).write.parquet(f"{scratch}/t/{name}.parquet")
        at += n
    monkeypatch.setattr(R, "CHUNK", 16)
    return spark.read.parquet(*(f"{scratch}/t/{n}.parquet" for n in "dbca")), rows


def test_pages_cover_every_row_once(files):
    df, rows = files
    got = [tuple(r) for o in range(0, 260, 23) for r in preview(df, o, 23).collect()]
    assert got == rows
    assert preview(df, 195, 50).count() == 5 and preview(df, 200, 50).count() == 0


def test_pages_of_a_pipeline(files):
    df, rows = files
    ops = [P.Filter("col_x", "not_null"), P.Cast("col_x", "integer"), P.Rename("col_k", "key")]
    out = P.run(df, ops, DatasetSchema.of(df), select=["col_x", "col_k"])
    want = [(int(x), k) for k, x, _ in rows if x is not None]
    got = [tuple(r) for o in range(0, 200, 40) for r in preview(out, o, 40).collect()]
    assert got == want and out.columns == ["x", "key"]
    page = P.run(df, ops, DatasetSchema.of(df), limit=7, offset=61)
    assert [(r["x"], r["key"]) for r in page.collect()] == want[61:68]
    with pytest.raises(P.PipelineError, match="no file order"):
        P.run(df, [P.Deduplicate()], DatasetSchema.of(df), limit=3)


def test_a_page_reads_its_files_without_a_sort(files):
    df, _ = files
    plan = R.page(df, 100, 20)._jdf.queryExecution().executedPlan().toString()
    assert "d.parquet" in plan and "TakeOrderedAndProject" in plan and "Exchange" not in plan and "Sort " not in plan


def test_pages_without_addresses_never_overlap(spark):
    df = spark.createDataFrame([(i % 2, i, {"m": 1}) for i in range(50)], "a long, b long, m map<string,int>").repartition(7)
    got = [r.b for o in range(0, 50, 10) for r in preview(df, o, 10).collect()]
    assert sorted(got) == list(range(50)) and not R.has_address(df)


@pytest.mark.parametrize("count", [2, 3, 17, 60, 181, 182, 500])
def test_systematic_rows(files, count):
    df, rows = files
    full = [(k, x, g) for k, x, g in rows if x is not None]
    at = np.linspace(0, len(full) - 1, count, dtype=int) if len(full) > count else range(len(full))
    got = R.systematic_rows(df.dropna(), count).select("k", "x", "g").collect()
    assert sorted(map(tuple, got)) == sorted(full[i] for i in at)


def test_systematic_rows_by_group(files):
    df, rows = files
    want = []
    for g in "ab":
        mine = [(g, x) for _, x, h in rows if h == g and x is not None]
        want += [mine[i] for i in (np.linspace(0, len(mine) - 1, 80, dtype=int) if len(mine) > 80 else range(len(mine)))]
    values = df.select(F.col("g").alias("label"), "x").dropna()
    assert sorted(map(tuple, R.systematic_rows(values, 80, ["label"]).collect())) == sorted(want)
    pairs = [(float(k), x) for k, x, _ in rows if x is not None]
    got = D.scatter_evidence(df, "k", "x", limit=3).collect()
    assert sorted(map(tuple, got)) == sorted((pairs[0], pairs[90], pairs[-1]))


def test_shapiro_sees_the_systematic_sample(files):
    df, rows = files
    got = {r.name: r for r in D.shapiro(df, "x", "g", limit=40).collect()}
    mine = [x for _, x, h in rows if h == "b" and x is not None]
    w, p = D.shapiro_wilk(np.array([mine[i] for i in np.linspace(0, len(mine) - 1, 40, dtype=int)]))
    row = next(r for n, r in got.items() if n.endswith("b"))
    assert (row.statistic, row.p_value, row.sample_size) == (pytest.approx(w), pytest.approx(p), 40)
