import math
from itertools import combinations

import numpy as np
import pytest

from tabspark.functions import dist
from tabspark.operators import diagnostics as D
from tabspark.operators import hypothesis as H

ROWS = [
    ("A", "G1", "N", 10, 2, 12, 10), ("A", "G1", "N", 12, 3, 14, 11), ("A", "G1", "S", 11, 4, 13, 11),
    ("B", "G2", "N", 20, 6, 22, 18), ("B", "G2", "S", 22, 7, 24, 20), ("B", "G2", "S", 21, 8, 23, 19),
    ("B", "G3", "N", 30, 10, 33, 29), ("B", "G3", "N", 31, 11, 34, 30), ("B", "G3", "S", 29, 12, 32, 28),
]
SCHEMA = "arm string, group string, category string, x bigint, y bigint, before bigint, after bigint"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def _one(frame):
    rows = frame.collect()
    assert len(rows) == 1
    return rows[0]


def test_welch_t_matches_formula(df):
    r = _one(H.welch_t(df, "x", "arm"))
    a = np.array([10, 12, 11.0])
    b = np.array([20, 22, 21, 30, 31, 29.0])
    va, vb = a.var(ddof=1) / 3, b.var(ddof=1) / 6
    t = (a.mean() - b.mean()) / math.sqrt(va + vb)
    dof = (va + vb) ** 2 / (va**2 / 2 + vb**2 / 5)
    assert r.sample_size == 9 and r.effect_name == "Hedges' g"
    assert r.statistic == pytest.approx(t) and r.df == pytest.approx(dof)
    assert r.p_value == pytest.approx(2 * dist.t_sf(abs(t), dof))
    assert r.ci_low < r.estimate < r.ci_high and r.significant


def test_paired_and_one_sample(df):
    p = _one(H.paired_t(df, "before", "after"))
    assert p.estimate == pytest.approx(31 / 9) and p.estimate > 0
    o = _one(H.one_sample_t(df, "x", 20))
    assert o.df == 8 and o.statistic_name == "t"
    less = _one(H.one_sample_t(df, "x", 20, alternative="less"))
    assert less.ci_low is None and less.ci_high is not None


def test_anova_and_kruskal(df):
    a = _one(H.welch_anova(df, "x", "group"))
    assert a.statistic_name == "F" and a.df is None and a.p_value < 0.05
    k = _one(H.kruskal(df, "x", "group"))
    assert k.statistic_name == "H" and k.statistic == pytest.approx(7.2)
    assert k.p_value == pytest.approx(math.exp(-3.6))
    assert D.group_summaries(df, "x", "group").count() == 3


def test_mann_whitney_exact(df):
    r = _one(H.mann_whitney(df, "x", "arm"))
    assert r.statistic == 0 and r.effect == pytest.approx(-1.0)
    # exact: 2 of the C(9,3) arrangements are at least as extreme
    assert r.p_value == pytest.approx(2 / math.comb(9, 3)) and r.method == "exact"


def _brute_mw_p(a, b):
    pooled = sorted(a + b)
    n1 = len(a)
    u_obs = sum(1.0 if x > y else 0.5 if x == y else 0.0 for x in a for y in b)
    us = []
    for idx in combinations(range(len(pooled)), n1):
        s = [pooled[i] for i in idx]
        rest = [pooled[i] for i in range(len(pooled)) if i not in idx]
        us.append(sum(1.0 if x > y else 0.5 if x == y else 0.0 for x in s for y in rest))
    us = np.array(us)
    mu = n1 * len(b) / 2
    return np.mean(np.abs(us - mu) >= abs(u_obs - mu) - 1e-9)


def test_mann_whitney_exact_vs_enumeration(spark):
    a, b = [1.2, 3.4, 0.5, 7.7], [2.2, 5.1, 6.3, 8.8, 9.1]
    frame = spark.createDataFrame([("a", v) for v in a] + [("b", v) for v in b], "g string, v double")
    r = _one(H.mann_whitney(frame, "v", "g"))
    assert r.p_value == pytest.approx(_brute_mw_p(a, b))


def test_wilcoxon(df):
    r = _one(H.wilcoxon(df, "before", "after"))
    assert r.statistic_name == "W" and r.statistic == 0 and r.effect == pytest.approx(1.0)
    assert r.estimate == 4.0 and r.sample_size == 9


def test_wilcoxon_exact_small(spark):
    d = [1.5, -0.5, 2.5, 3.5, -4.5, 5.5]
    frame = spark.createDataFrame([(v, 0.0) for v in d], "x double, y double")
    r = _one(H.wilcoxon(frame, "x", "y"))
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    rp = ranks[np.array(d) > 0].sum()
    rm = ranks[np.array(d) < 0].sum()
    # brute force over all sign patterns
    totals = []
    for mask in range(2 ** len(d)):
        totals.append(sum(r_ for i, r_ in enumerate(range(1, len(d) + 1)) if mask >> i & 1))
    totals = np.array(totals)
    t = min(rp, rm)
    p = min(1.0, 2 * np.mean(totals <= t))
    assert r.method == "exact" and r.statistic == t and r.p_value == pytest.approx(p)


def test_correlations(df):
    p = _one(H.pearson(df, "x", "y"))
    assert p.statistic == pytest.approx(np.corrcoef(df.toPandas().x, df.toPandas().y)[0, 1])
    assert p.df == 7 and p.ci_low < p.statistic < p.ci_high
    s = _one(H.spearman(df, "x", "y"))
    pdf = df.toPandas()
    rho = np.corrcoef(pdf.x.rank(), pdf.y.rank())[0, 1]
    assert s.statistic_name == "ρ" and s.statistic == pytest.approx(rho)


def test_chi_square(df):
    r = _one(H.chi_square(df, "arm", "category"))
    obs = np.array([[2, 1], [3, 3]], dtype=float)
    exp = np.outer(obs.sum(1), obs.sum(0)) / obs.sum()
    chi2 = ((obs - exp) ** 2 / exp).sum()
    assert r.statistic_name == "χ²" and r.statistic == pytest.approx(chi2) and r.df == 1
    assert r.effect_name == "Cramér's V" and r.effect == pytest.approx(math.sqrt(chi2 / 9))
    assert r.p_value == pytest.approx(dist.chi2_sf(chi2, 1))
    cells = H.chi_cells(df, "arm", "category").collect()
    assert len(cells) == 4
    assert H.expected_cells(df, "arm", "category").first().status == "warning"


def test_group_count_errors(df):
    with pytest.raises(Exception, match="exactly two"):
        H.welch_t(df, "x", "group").collect()
    with pytest.raises(Exception, match="at least three"):
        H.kruskal(df, "x", "arm").collect()
    with pytest.raises(H.AnalyzeError):
        H.welch_t(df, "arm", "group")


def test_recommend(df):
    two = {r.test_id: r.preferred for r in H.recommend(df, "compare_groups", "x", "arm").collect()}
    assert two == {"welch_t": True, "mann_whitney": False}
    many = {r.test_id for r in H.recommend(df, "compare_groups", "x", "group").collect()}
    assert many == {"welch_anova", "kruskal"}
    assert {r.test_id for r in H.recommend(df, "compare_paired", "before", secondary="after").collect()} == {
        "paired_t", "wilcoxon"}


def test_diagnostics(df):
    lev = D.levene(df, "x", "group").first()
    assert lev.name.startswith("Variance equality") and lev.status in ("info", "warning")
    sw = {r.name: r for r in D.shapiro(df, "x", "group").collect()}
    assert set(sw) == {"Normality · G1", "Normality · G2", "Normality · G3"}
    assert all(0 <= r.statistic <= 1 for r in sw.values())
    pts, fit = D.residual_qq(df, "x", "group")
    assert pts.count() == 9 and fit.first().sample_size == 9


def test_shapiro_wilk_values():
    # W for a perfectly evenly spaced sample is close to one; a skewed one is lower.
    w_even, p_even = D.shapiro_wilk(np.arange(1, 21, dtype=float))
    w_skew, p_skew = D.shapiro_wilk(np.array([1, 1, 1, 1, 2, 2, 3, 5, 9, 20, 50, 100.0]))
    assert w_even > 0.95 and p_even > 0.3
    assert w_skew < 0.7 and p_skew < 0.01


def test_systematic_sample_positions(spark):
    values = spark.createDataFrame([(float(v),) for v in np.random.default_rng(3).integers(0, 40, 200)], "v double")
    got = sorted(r.v for r in D.systematic_sorted_sample(values, "v", 17).collect())
    arr = np.sort(np.array([r.v for r in values.collect()]))
    expected = sorted(arr[np.linspace(0, arr.size - 1, 17, dtype=int)])
    assert got == expected
