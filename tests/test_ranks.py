import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabspark.functions import dist
from tabspark.functions.ranks import midrank, quantiles, value_positions


def _midranks(values):
    arr = np.asarray(values, dtype=float)
    order = np.argsort(arr, kind="mergesort")
    ranks = np.empty(arr.size)
    ranks[order] = np.arange(1, arr.size + 1)
    out = {}
    for v in np.unique(arr):
        out[float(v)] = ranks[arr == v].mean()
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=-20, max_value=20), min_size=1, max_size=120))
def test_midranks_match_brute_force(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    pos = value_positions(df, "x", range_rows=5)
    got = {r.x: r.r for r in pos.select("x", midrank(pos).alias("r")).collect()}
    assert got == pytest.approx(_midranks(values))


def test_grouped_positions_and_quantiles(spark):
    rng = np.random.default_rng(7)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in rng.integers(0, 30, 57)]
    df = spark.createDataFrame(rows, "g string, x double")
    q = {r.g: (r.q25, r.q50, r.q90) for r in quantiles(df, "x", [0.25, 0.5, 0.9], ["q25", "q50", "q90"], by=["g"]).collect()}
    for g in ("a", "b", None):
        arr = np.array([v for gg, v in rows if gg == g])
        assert q[g] == pytest.approx(tuple(np.quantile(arr, [0.25, 0.5, 0.9])))


def test_dist_check_values():
    assert dist.t_cdf(2, 8) == pytest.approx(0.9597418810213687, rel=1e-12)
    assert dist.f_cdf(3, 2, 5) == pytest.approx(0.8607025077555285, rel=1e-12)
    assert dist.chi2_cdf(2, 3) == pytest.approx(0.42759329552912023, rel=1e-12)
    assert dist.t_ppf(0.975, 8) == pytest.approx(2.306004135033371, rel=1e-9)
    assert dist.norm_ppf(0.975) == pytest.approx(1.959963984540054, rel=1e-12)
    assert dist.f_sf(4.0, 2, 30) == pytest.approx((1 + 2 * 4.0 / 30) ** -15, rel=1e-10)
    assert dist.chi2_sf(5.0, 2) == pytest.approx(np.exp(-2.5), rel=1e-12)
