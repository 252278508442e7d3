import numpy as np
import pytest
from pyspark.sql import functions as F

from tabspark.functions import ranks as R


def frames(spark):
    rng = np.random.default_rng(3)
    skewed = np.concatenate([np.zeros(4000), rng.pareto(0.4, 3000), -rng.pareto(0.4, 500)])
    return {
        "sorted": np.arange(9000.0),
        "ties": np.repeat([1.0, 2.0, 2.5], [3000, 5000, 10]),
        "skewed": skewed,
        "few": np.array([3.0, 1.0]),
        "one": np.array([7.0]),
    }


PROBS = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0]
NAMES = [f"p{i}" for i in range(6)]


def frame(spark):
    rows = [(g, float(v)) for g, vs in frames(spark).items() for v in vs] + [(None, 4.0), (None, 6.0), ("nulls", None)]
    return spark.createDataFrame(rows, "g string, x double").repartition(5)


def check(spark, got):
    found = {r["g"]: [r[n] for n in NAMES] for r in got.collect()}
    for g, vs in frames(spark).items():
        assert found[g] == pytest.approx(list(np.quantile(vs, PROBS)))
    assert found[None] == pytest.approx(list(np.quantile([4.0, 6.0], PROBS)))
    assert found["nulls"] == [None] * 6


def test_quantiles_of_awkward_groups(spark):
    df = frame(spark)
    check(spark, R.quantiles(df, "x", PROBS, NAMES, by=["g"]))
    check(spark, R.quantiles(df, "x", PROBS, NAMES, by=["g"], counts=df.groupBy("g", "x").agg(F.count("*").alias("n"))))


def test_a_missed_bracket_is_no_error(spark, monkeypatch):
    monkeypatch.setattr(R, "MARGIN", -0.2)  # every bracket of a large group is empty
    check(spark, R.quantiles(frame(spark), "x", PROBS, NAMES, by=["g"]))
    one = R.quantiles(frame(spark).where("g = 'sorted'"), "x", [0.5], ["m"]).collect()
    assert [r.m for r in one] == [4499.5]


def test_many_groups_are_not_collected(spark, monkeypatch):
    monkeypatch.setattr(R, "LOCAL_GROUPS", 3)
    check(spark, R.quantiles(frame(spark), "x", PROBS, NAMES, by=["g"]))


@pytest.mark.parametrize("range_rows", [7, 1000, 10**6])
def test_positions_do_not_depend_on_the_ranges(spark, range_rows):
    df = frame(spark)
    got = {(r.g, r.x): (r.n, r.before, r.total) for r in R.value_positions(df, "x", ["g"], range_rows=range_rows).collect()}
    for g, vs in frames(spark).items():
        values, counts = np.unique(vs, return_counts=True)
        before = np.cumsum(counts) - counts
        if range_rows > 7 or len(values) < 100:
            assert {k[1]: v for k, v in got.items() if k[0] == g} == {float(x): (int(n), int(b), len(vs)) for x, n, b in zip(values, counts, before)}
    assert got[(None, 6.0)] == (1, 1, 2)


def test_one_scan_of_the_rows(spark):
    from tabspark.operators import hypothesis as H

    rows = spark.createDataFrame([(float(i % 17), "ab"[i % 2]) for i in range(200)], "x double, g string")
    plan = H.mann_whitney(rows, "x", "g")._jdf.queryExecution().analyzed().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan  # only the written counts are read
