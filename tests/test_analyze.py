import numpy as np
import pytest
from pyspark.sql import functions as F

from tabspark.functions import dist
from tabspark.functions.ranks import quantiles
from tabspark.operators import diagnostics as D
from tabspark.operators import explore as X
from tabspark.operators import hypothesis as H
from tabspark.operators.analyze import analyze


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(5)
    rows = [("ab"[i % 2], "xyz"[i % 3], float(rng.normal(i % 2, 1)), float(rng.normal(0, 2))) for i in range(90)]
    return spark.createDataFrame(rows, "two string, three string, `v.1` double, w double")


PARTS = [
    ("welch_t", {"group": "two"}, 2, 3, {"box", "qq", "qq_fit"}),
    ("welch_anova", {"group": "three"}, 3, 4, {"box", "qq", "qq_fit"}),
    ("mann_whitney", {"group": "two"}, 2, 1, {"box"}),
    ("kruskal", {"group": "three"}, 3, 1, {"box"}),
    ("paired_t", {"y": "w"}, 2, 1, {"qq", "qq_fit"}),
    ("wilcoxon", {"y": "w"}, 2, 1, set()),
    ("one_sample_t", {"reference_value": 0.5}, 1, 1, {"qq", "qq_fit"}),
    ("pearson", {"y": "w"}, None, 1, {"scatter"}),
    ("spearman", {"y": "w"}, None, 1, {"scatter"}),
]


@pytest.mark.parametrize("test_id,args,summaries,checks,evidence", PARTS)
def test_every_part_of_an_analysis(df, test_id, args, summaries, checks, evidence):
    a = analyze(df, test_id, "v.1", **args)
    assert a.result.count() == 1 and set(a.evidence) == evidence
    assert (a.summaries is None) == (summaries is None) and (summaries is None or a.summaries.count() == summaries)
    rows = a.diagnostics.collect()
    assert len(rows) == checks and all(r.message for r in rows)
    if test_id in ("kruskal", "wilcoxon"):
        assert a.result.first().warnings


def test_chi_square_analysis(df):
    a = analyze(df, "chi_square", "two", y="three")
    assert a.evidence["residuals"].count() == 6 and a.diagnostics.count() == 1


def test_qq_of_x_itself_and_of_few_values(spark, df):
    _, fit = D.residual_qq(df, "v.1")
    mean = df.agg(F.avg("`v.1`")).first()[0]
    assert fit.first().intercept == pytest.approx(mean, abs=1e-9)
    two = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert D.residual_qq(two, "x")[0].count() == 0


def test_exact_mann_whitney_with_one_large_group(spark):
    big = spark.range(100_000).selectExpr("'b' g", "cast(id as double) + 0.5 x")
    small = spark.createDataFrame([("a", float(v)) for v in (10, 2000, 30_000, 70_000, 99_000)], "g string, x double")
    row = H.mann_whitney(big.union(small), "x", "g").first()
    assert row.method == "exact" and 0 < row.p_value <= 1
    with pytest.raises(ValueError, match="asymptotic"):
        dist.mann_whitney_exact_p(5.0, 5_000, 5_000, "two-sided")


def test_exact_mann_whitney_equals_enumeration():
    from itertools import combinations

    for n1, n2 in ((3, 4), (5, 2), (1, 6)):
        us = [sum(c) - n1 * (n1 + 1) // 2 for c in combinations(range(1, n1 + n2 + 1), n1)]
        for u in range(n1 * n2 + 1):
            upper = sum(v >= u for v in us) / len(us)
            lower = sum(v <= u for v in us) / len(us)
            assert dist.mann_whitney_exact_p(u, n1, n2, "greater") == pytest.approx(upper)
            assert dist.mann_whitney_exact_p(u, n1, n2, "less") == pytest.approx(lower)


def test_sample_is_uniform(spark):
    df = spark.range(60_000).selectExpr("cast(id % 100 as double) x", "1.0 y")
    got = X.sample_rows(df, 2000)
    row = got.agg(F.count("*"), F.count_distinct("x"), F.avg("x")).first()
    assert row[0] == 2000 and row[1] == 100 and abs(row[2] - 49.5) < 3
    keyed = spark.range(5000).withColumn("k", F.col("id") * 7)
    pick = lambda d: sorted(r.id for r in X.sample_rows(d, 50, key_cols=["k"]).collect())
    assert pick(keyed) == pick(keyed.repartition(7))


def test_too_many_groups_are_found_first(spark):
    df = spark.range(200).selectExpr("cast(id as string) g", "cast(id as double) x")
    for call in (H.mann_whitney, H.kruskal, D.levene):
        with pytest.raises(H.AnalyzeError, match="50 groups"):
            call(df, "x", "g")


def test_recommendations(spark, df):
    empty = df.limit(0)
    rows = H.recommend(empty, "one_sample", outcome="v.1").collect()
    assert [r.test_id for r in rows] == ["one_sample_t"] and rows[0].assumptions and rows[0].notes
    two = H.recommend(df.withColumnRenamed("v.1", "growth %"), "compare_groups", outcome="growth %", group="two").collect()
    assert two[0].rationale == "growth % is numeric and two has two observed groups." and "2." in two[0].notes[1]


def test_large_quantiles_use_the_bracket(spark):
    """More rows than the sketch's accuracy: only the bracket's values are kept, and the result stays exact."""
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=150_000), np.repeat(0.25, 60_000), rng.integers(0, 5, 40_000)])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    row = quantiles(df, "x", [0.001, 0.25, 0.5, 0.9], ["a", "b", "c", "d"]).first()
    assert tuple(row) == pytest.approx(tuple(np.quantile(values, [0.001, 0.25, 0.5, 0.9])), rel=1e-12)


def test_shapiro_check_values():
    """A published example: 11 weights (Shapiro and Wilk 1965), W = 0.79, p below 0.01."""
    w, p = D.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))
    assert w == pytest.approx(0.79, abs=0.005) and 0.005 < p < 0.01
