"""Distribution functions and their inverses, from their series and continued fractions (numpy and math only)."""

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_pdf(z: float) -> float:
    return math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return -math.inf if p <= 0 else math.inf if p >= 1 else NormalDist().inv_cdf(p)


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * scale)
    return 1.0 - _gamma_fraction(a, x) * scale


def gamma_q(a: float, x: float) -> float:
    if x <= 0:
        return 1.0
    return 1.0 - gamma_p(a, x) if x < a + 1 else _gamma_fraction(a, x) * math.exp(a * math.log(x) - x - math.lgamma(a))


def _gamma_fraction(a: float, x: float) -> float:
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def t_sf(t: float, df: float) -> float:
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def solve(fn: Callable[[float], float], low: float, high: float, tolerance: float = 1e-13) -> float:
    """The root of an increasing or decreasing function between two ends."""
    up = fn(high) > fn(low)
    for _ in range(400):
        mid = (low + high) / 2
        if (fn(mid) > 0) == up:
            high = mid
        else:
            low = mid
        if high - low <= tolerance * max(1.0, abs(mid)):
            break
    return (low + high) / 2


def t_quantile(p: float, df: float) -> float:
    if p == 0.5:
        return 0.0
    return solve(lambda t: 1 - t_sf(t, df) - p, -1e8, 1e8) if p < 0.5 else -t_quantile(1 - p, df)


def chi2_quantile(p: float, df: float) -> float:
    return solve(lambda x: 1 - chi2_sf(x, df) - p, 0.0, df + 40 * math.sqrt(2 * df) + 800)


def f_quantile(p: float, d1: float, d2: float) -> float:
    high = 1.0
    while 1 - f_sf(high, d1, d2) < p:
        high *= 2
    return solve(lambda x: 1 - f_sf(x, d1, d2) - p, 0.0, high)


def beta_quantile(p: float, a: float, b: float) -> float:
    return solve(lambda x: beta_inc(a, b, x) - p, 0.0, 1.0)


def binomial_pmf(k: int, n: int, p: float) -> float:
    if p <= 0 or p >= 1:
        return float(k == (0 if p <= 0 else n))
    return math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))


def poisson_sf(k: int, mean: float) -> float:
    """P(X >= k)."""
    return 1.0 if k <= 0 else gamma_p(k, mean)


def hypergeometric_pmf(k: int, total: int, successes: int, draws: int) -> float:
    c = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    return math.exp(c(successes, k) + c(total - successes, draws - k) - c(total, draws))


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """P(range of k normals over an independent s > q), by quadrature over the smallest value and over s."""
    if q <= 0:
        return 1.0
    z = np.linspace(-8, 8, 801)
    pdf = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    cdf = np.vectorize(normal_cdf)

    def at(w: float) -> float:
        return k * np.trapezoid(pdf * (cdf(z + w) - cdf(z)) ** (k - 1), z)

    if not math.isfinite(df) or df > 25_000:
        return 1 - at(q)
    s = np.linspace(1e-6, 1 + 10 / math.sqrt(df) + (3 if df < 10 else 0), 240)
    logpdf = (df / 2) * math.log(df / 2) - math.lgamma(df / 2) + math.log(2) + (df - 1) * np.log(s) - df * s * s / 2
    weight = np.exp(logpdf)
    return float(1 - np.trapezoid(weight * np.array([at(q * x) for x in s]), s) / np.trapezoid(weight, s))


def noncentral_t_cdf(t: float, df: float, delta: float) -> float:
    """By quadrature over the chi of the denominator."""
    s = np.linspace(1e-9, 1 + 12 / math.sqrt(df) + (4 if df < 10 else 0), 4001)
    logpdf = (df / 2) * math.log(df / 2) - math.lgamma(df / 2) + math.log(2) + (df - 1) * np.log(s) - df * s * s / 2
    return float(np.trapezoid(np.exp(logpdf) * np.vectorize(normal_cdf)(t * s - delta), s))


def noncentral_chi2_sf(x: float, df: float, delta: float) -> float:
    total, weight, j = 0.0, math.exp(-delta / 2), 0
    log_weight = -delta / 2
    while j < 10_000:
        weight = math.exp(log_weight)
        total += weight * chi2_sf(x, df + 2 * j)
        j += 1
        log_weight += math.log(delta / 2 / j) if delta > 0 else -math.inf
        if j > delta / 2 and weight < 1e-17:
            break
    return total


def noncentral_f_sf(x: float, d1: float, d2: float, delta: float) -> float:
    total, j, log_weight = 0.0, 0, -delta / 2
    while j < 10_000:
        weight = math.exp(log_weight)
        total += weight * (1 - beta_inc(d1 / 2 + j, d2 / 2, d1 * x / (d1 * x + d2)))
        j += 1
        log_weight += math.log(delta / 2 / j) if delta > 0 else -math.inf
        if j > delta / 2 and weight < 1e-17:
            break
    return total


def p_value(z: float, alternative: str, sf: Callable[[float], float]) -> float:
    """The p-value of a statistic that is symmetric under the hypothesis."""
    if alternative == "greater":
        return sf(z)
    if alternative == "less":
        return sf(-z)
    if alternative != "two_sided":
        raise ValueError(f"unknown alternative {alternative}")
    return min(1.0, 2 * sf(abs(z)))


def normal_quantile_column(p: Column) -> Column:
    """The normal quantile of a column, by a batch function."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(normal_quantile)

    return run(p)
