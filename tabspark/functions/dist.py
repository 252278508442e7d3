"""Distribution functions (normal, Student t, F, chi-square) in pure Python.

Only aggregated statistics ever reach these functions -- a handful of
numbers per test -- so they run in a pandas UDF over a one-row frame.
The regularized incomplete beta uses Lentz's continued fraction, the
regularized incomplete gamma uses its series / continued fraction pair.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_EPS = 1e-15
_TINY = 1e-300
_STD = NormalDist()


# -- special functions -----------------------------------------------------
def _betacf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _betacf(a, b, x) / a
    return 1.0 - math.exp(log_front) * _betacf(b, a, 1.0 - x) / b


def gammainc_upper(a: float, x: float) -> float:
    """Regularized upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    if x < a + 1.0:
        term = 1.0 / a
        total = term
        ap = a
        for _ in range(100000):
            ap += 1.0
            term *= x / ap
            total += term
            if abs(term) < abs(total) * _EPS:
                break
        return max(0.0, 1.0 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, 100000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = d if abs(d) > _TINY else _TINY
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


# -- normal ----------------------------------------------------------------
def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def norm_ppf(p: float) -> float:
    if p <= 0.0:
        return -math.inf
    if p >= 1.0:
        return math.inf
    return _STD.inv_cdf(p)


# -- Student t -------------------------------------------------------------
def t_sf(t: float, df: float) -> float:
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return math.nan
    if math.isinf(df):
        return norm_sf(t)
    tail = 0.5 * betainc(df / 2.0, 0.5, df / (df + t * t))
    return tail if t > 0 else 1.0 - tail


def t_cdf(t: float, df: float) -> float:
    return t_sf(-t, df)


def t_ppf(p: float, df: float) -> float:
    if p <= 0.0:
        return -math.inf
    if p >= 1.0:
        return math.inf
    if p == 0.5:
        return 0.0
    if p < 0.5:
        return -t_ppf(1.0 - p, df)
    lo, hi = 0.0, max(1.0, norm_ppf(p) * 2.0)
    while t_cdf(hi, df) < p:
        hi *= 2.0
        if hi > 1e300:
            return math.inf
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if t_cdf(mid, df) < p:
            lo = mid
        else:
            hi = mid
        if hi - lo <= 1e-14 * max(1.0, abs(mid)):
            break
    return 0.5 * (lo + hi)


# -- F and chi-square ------------------------------------------------------
def f_sf(f: float, df1: float, df2: float) -> float:
    if math.isnan(f) or df1 <= 0 or df2 <= 0:
        return math.nan
    if f <= 0:
        return 1.0
    return betainc(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))


def f_cdf(f: float, df1: float, df2: float) -> float:
    return 1.0 - f_sf(f, df1, df2)


def chi2_sf(x: float, df: float) -> float:
    if math.isnan(x) or df <= 0:
        return math.nan
    if x <= 0:
        return 1.0
    return gammainc_upper(df / 2.0, x / 2.0)


def chi2_cdf(x: float, df: float) -> float:
    return 1.0 - chi2_sf(x, df)


# -- p-values by alternative ----------------------------------------------
def p_from_t(t: float, df: float, alternative: str) -> float:
    if t is None or df is None or math.isnan(t) or math.isnan(df):
        return math.nan
    if alternative == "less":
        return t_cdf(t, df)
    if alternative == "greater":
        return t_sf(t, df)
    return min(1.0, 2.0 * t_sf(abs(t), df))


# -- exact null distributions of rank statistics (sizes only) ---------------
MAX_EXACT_CELLS = 50_000_000


def _mann_whitney_counts(n1: int, n2: int) -> np.ndarray:
    """Share of arrangements with U = 0, 1, ..., n1 * n2 (no ties).

    The number of arrangements by U is the Gaussian binomial coefficient, built factor by factor:
    for i = 1..min(n1, n2) multiply by (1 - q^(big + i)) and divide by (1 - q^i).  Each step is one
    pass over an array; it is kept as shares, so large sizes do not overflow.
    """
    small, big = min(n1, n2), max(n1, n2)
    if small * (small * big + 1) > MAX_EXACT_CELLS:
        raise ValueError("the exact distribution is too large for these group sizes; ask for method='asymptotic'")
    share = np.zeros(small * big + 1)
    share[0] = 1.0
    for i in range(1, small + 1):
        # Every value of the i-th rank statistic: U grows by 0..big steps of i, windowed sums of shares.
        step = share.copy()
        step[big + i :] -= share[: len(share) - big - i]
        for r in range(i):
            step[r::i] = np.cumsum(step[r::i])
        share = np.maximum(step, 0.0) * (i / (big + i))
    return share / share.sum()


def mann_whitney_exact_sf(u: float, n1: int, n2: int) -> float:
    """P(U >= u) for U of sample 1 with no ties; the smaller tail is summed, so tiny values stay exact."""
    share = _mann_whitney_counts(n1, n2)
    k = int(math.ceil(u - 1e-9))
    if k <= 0:
        return 1.0
    if k > n1 * n2:
        return 0.0
    # U is symmetric around n1 * n2 / 2: the upper tail equals the lower one, where no cancellation occurs.
    tail = float(share[: n1 * n2 - k + 1].sum())
    return min(1.0, tail)


def mann_whitney_exact_p(u1: float, n1: int, n2: int, alternative: str) -> float:
    u2 = n1 * n2 - u1
    if alternative == "greater":
        return mann_whitney_exact_sf(u1, n1, n2)
    if alternative == "less":
        return mann_whitney_exact_sf(u2, n1, n2)
    return min(1.0, 2.0 * mann_whitney_exact_sf(max(u1, u2), n1, n2))


def signed_rank_exact_cdf(r: float, n: int) -> float:
    """P(R+ <= r) for the Wilcoxon signed-rank statistic without ties or zeros."""
    max_r = n * (n + 1) // 2
    counts = [1] + [0] * max_r  # whole numbers: exact at any size
    for k in range(1, n + 1):
        for s in range(max_r, k - 1, -1):
            counts[s] += counts[s - k]
    total = 2**n
    k = int(math.floor(r + 1e-9))
    if k < 0:
        return 0.0
    if k >= max_r:
        return 1.0
    return sum(counts[: k + 1]) / total


def wilcoxon_exact_p(r_plus: float, n: int, alternative: str) -> float:
    max_r = n * (n + 1) / 2.0
    if alternative == "greater":
        return signed_rank_exact_cdf(max_r - r_plus, n)  # by symmetry, without cancellation
    if alternative == "less":
        return signed_rank_exact_cdf(r_plus, n)
    r_minus = max_r - r_plus
    r = min(r_plus, r_minus)
    return min(1.0, 2.0 * signed_rank_exact_cdf(r, n))
