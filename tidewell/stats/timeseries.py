"""Time series.  A series is ordered, so its recursions run in one task; many series run side by side (``per_series``).

Moments of lagged products (autocorrelations, vector autoregressions, unit-root regressions) are window lags and
sums and scale with the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.guards import operand
from tidewell.stats import special as sp
from tidewell.stats.core import gram, moments


def per_series(df: DataFrame, value: str, order: list[str], fn: Callable[[np.ndarray], dict], schema: str, keys: list[str] = ()) -> DataFrame:
    """``fn`` over each ordered series: a dict of scalars or of equally long arrays becomes rows."""
    types = dict(df.dtypes)
    head = "".join(f"`{k}` {types[k]}, " for k in keys)
    cols = [c.strip().split()[0] for c in schema.split(",")]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        got = fn(p.sort_values(order, kind="stable")[value].to_numpy(float))
        n = max((len(v) for v in got.values() if isinstance(v, np.ndarray)), default=1)
        out = pd.DataFrame({c: got[c] if isinstance(got[c], np.ndarray) else [got[c]] * n for c in cols})
        for k in reversed(keys):
            out.insert(0, k, [p[k].iloc[0]] * n)
        return out

    rows = df.select(*keys, *[o for o in order if o not in keys], operand(value).alias(value))
    return (rows.groupBy(*keys) if keys else rows.groupBy()).applyInPandas(run, head + schema)


def acf(df: DataFrame, value: str, order: list[str], lags: int, partition: list[str] = ()) -> list[dict]:
    """Autocorrelations with the full-sample variance, by window lags; with a partition lags stay within it."""
    m = moments(df, [value])[value]
    w = Window.partitionBy(*partition).orderBy(*order)
    d = df.select((operand(value) - m["mean"]).alias("d"), *order, *partition)
    d = d.select("d", *[F.lag("d", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)])
    r = d.agg(F.sum(F.col("d") ** 2).alias("s"), *[F.sum(F.col("d") * F.col(f"l{k}")).alias(f"c{k}") for k in range(1, lags + 1)]).first()
    return [{"lag": 0, "acf": 1.0}] + [{"lag": k, "acf": r[f"c{k}"] / r["s"]} for k in range(1, lags + 1)]


def pacf_from(rho: list[float]) -> list[float]:
    """Durbin and Levinson's recursion; ``rho`` starts at lag 1."""
    phi, out = np.zeros(0), []
    for k, r in enumerate(rho, 1):
        a = (r - phi @ np.array(rho[: k - 1])[::-1]) / (1 - phi @ np.array(rho[: k - 1])) if k > 1 else r
        phi = np.concatenate([phi - a * phi[::-1], [a]])
        out.append(float(a))
    return out


def correlogram(df: DataFrame, value: str, order: list[str], lags: int = 20, partition: list[str] = ()) -> list[dict]:
    a = acf(df, value, order, lags, partition)
    n = moments(df, [value])[value]["n"]
    p = pacf_from([r["acf"] for r in a[1:]])
    return [{"lag": r["lag"], "acf": r["acf"], "pacf": v, "band": 1.959963984540054 / math.sqrt(n)} for r, v in zip(a[1:], p)]


def ljung_box(rho: list[float], n: float, fitted_parameters: int = 0) -> dict:
    stat = n * (n + 2) * sum(r * r / (n - k) for k, r in enumerate(rho, 1))
    df = len(rho) - fitted_parameters
    return {"statistic": stat, "df": df, "p_value": sp.chi2_sf(stat, df)}


def box_pierce(rho: list[float], n: float) -> dict:
    stat = n * sum(r * r for r in rho)
    return {"statistic": stat, "df": len(rho), "p_value": sp.chi2_sf(stat, len(rho))}


#: MacKinnon's response surfaces for the tau statistic of one series (fixed values, 1, 5 and 10 percent).
TAU_CRITICAL = {
    "none": ((-2.56574, -2.2358, -3.627), (-1.94100, -0.2686, -3.365), (-1.61682, 0.2656, -2.714)),
    "constant": ((-3.43035, -6.5393, -16.786), (-2.86154, -2.8903, -4.234), (-2.56677, -1.5384, -2.809)),
    "trend": ((-3.95877, -9.0531, -28.428), (-3.41049, -4.3904, -9.036), (-3.12705, -2.5856, -3.925)),
}


def adf(df: DataFrame, value: str, order: str, lags: int = 1, deterministic: str = "constant") -> dict:
    """The augmented regression from one Gram matrix over window lags."""
    w = Window.orderBy("__o")
    d = df.select(F.col(order).alias("__o"), operand(value).alias("y"))
    d = d.select("__o", "y", F.lag("y").over(w).alias("l"), F.row_number().over(w).alias("t")).withColumn("d", F.col("y") - F.col("l"))
    d = d.select("d", "l", F.col("t").cast("double").alias("t"), *[F.lag("d", k).over(w).alias(f"d{k}") for k in range(1, lags + 1)])
    d = d.where(" and ".join(f"{c} is not null" for c in d.columns))
    x = ["l", *[f"d{k}" for k in range(1, lags + 1)], *(["t"] if deterministic == "trend" else [])]
    from tidewell.stats.linear import fit

    m = fit(d, "d", x, constant=deterministic != "none")
    i = m.names.index("l")
    stat = float(m.beta[i] / math.sqrt(m.covariance[i, i]))
    crit = [a + b / m.n + c / m.n**2 for a, b, c in TAU_CRITICAL[deterministic]]
    return {"statistic": stat, "coefficient": float(m.beta[i]), "lags": lags, "n": m.n, "critical_1": crit[0], "critical_5": crit[1], "critical_10": crit[2]}


def _bartlett_variance(e: np.ndarray, bandwidth: int) -> float:
    n = len(e)
    return float((e @ e + 2 * sum((1 - k / (bandwidth + 1)) * (e[k:] @ e[:-k]) for k in range(1, bandwidth + 1))) / n)


def _detrend(y: np.ndarray, deterministic: str) -> np.ndarray:
    x = np.ones((len(y), 1)) if deterministic == "constant" else np.column_stack([np.ones(len(y)), np.arange(len(y))])
    return y - x @ np.linalg.lstsq(x, y, rcond=None)[0]


def kpss(y: np.ndarray, deterministic: str = "constant", bandwidth: int = 4) -> dict:
    e = _detrend(y, deterministic)
    s = np.cumsum(e)
    crit = {"constant": (0.347, 0.463, 0.574, 0.739), "trend": (0.119, 0.146, 0.176, 0.216)}[deterministic]
    stat = float(s @ s / len(y) ** 2 / _bartlett_variance(e, bandwidth))
    return {"statistic": stat, "critical_10": crit[0], "critical_5": crit[1], "critical_1": crit[3]}


def phillips_perron(y: np.ndarray, deterministic: str = "constant", bandwidth: int = 4) -> dict:
    n = len(y) - 1
    cols = [y[:-1]]
    if deterministic != "none":
        cols.append(np.ones(n))
    if deterministic == "trend":
        cols.append(np.arange(n, dtype=float))
    x = np.column_stack(cols)
    b, *_ = np.linalg.lstsq(x, y[1:], rcond=None)
    e = y[1:] - x @ b
    s2 = e @ e / (n - x.shape[1])
    se = math.sqrt(s2 * np.linalg.inv(x.T @ x)[0, 0])
    g0, lam = e @ e / n, _bartlett_variance(e, bandwidth)
    t = (b[0] - 1) / se
    return {"statistic": math.sqrt(g0 / lam) * t - 0.5 * (lam - g0) / math.sqrt(lam) * n * se / math.sqrt(s2), "n": n}


def minimise(fn: Callable[[np.ndarray], float], start: np.ndarray, iterations: int = 2000, tolerance: float = 1e-10) -> tuple[np.ndarray, float]:
    """Nelder and Mead's simplex."""
    k = len(start)
    pts = [np.asarray(start, float)] + [np.asarray(start, float) + np.eye(k)[i] * (0.1 * abs(start[i]) + 0.05) for i in range(k)]
    val = [fn(p) for p in pts]
    for _ in range(iterations):
        o = np.argsort(val, kind="stable")
        pts, val = [pts[i] for i in o], [val[i] for i in o]
        if abs(val[-1] - val[0]) <= tolerance * (abs(val[0]) + tolerance):
            break
        c = np.mean(pts[:-1], 0)
        r = c + (c - pts[-1])
        fr = fn(r)
        if fr < val[0]:
            e = c + 2 * (c - pts[-1])
            fe = fn(e)
            pts[-1], val[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < val[-2]:
            pts[-1], val[-1] = r, fr
        else:
            s = c + 0.5 * ((r if fr < val[-1] else pts[-1]) - c)
            fs = fn(s)
            if fs < min(fr, val[-1]):
                pts[-1], val[-1] = s, fs
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                val = [val[0]] + [fn(p) for p in pts[1:]]
    i = int(np.argmin(val))
    return pts[i], val[i]


def _poly(ar: np.ndarray, seasonal: np.ndarray, period: int) -> np.ndarray:
    """Coefficients of the product of both lag polynomials, without the leading 1, sign as in y_t = sum c_i y_(t-i)."""
    a = np.concatenate([[1.0], -np.asarray(ar)])
    s = np.zeros(len(seasonal) * period + 1)
    s[0] = 1.0
    for i, v in enumerate(seasonal, 1):
        s[i * period] = -v
    return -np.convolve(a, s)[1:]


def arima(y: np.ndarray, p: int = 1, d: int = 1, q: int = 0, seasonal: tuple[int, int, int] = (0, 0, 0), period: int = 12, constant: bool = True, horizon: int = 10, confidence: float = 0.95) -> dict:
    """(S)ARIMA by conditional least squares, with forecasts on the original scale."""
    ps, ds, qs = seasonal
    z, history = np.asarray(y, float), []
    for _ in range(ds):
        history.append((z, period))
        z = z[period:] - z[:-period]
    for _ in range(d):
        history.append((z, 1))
        z = z[1:] - z[:-1]
    n, k = len(z), p + q + ps + qs + int(constant)

    def split(b: np.ndarray) -> tuple:
        i = 0
        parts = []
        for m in (p, q, ps, qs):
            parts.append(b[i : i + m])
            i += m
        return (*parts, b[-1] if constant else 0.0)

    def errors(b: np.ndarray) -> np.ndarray:
        ar, ma, sar, sma, c = split(b)
        a, m = _poly(ar, sar, period), -_poly(-np.asarray(ma), -np.asarray(sma), period)
        x = z - c
        e = np.zeros(n)
        lag = len(a)
        for t in range(n):
            v = x[t] - (a[: min(lag, t)] @ x[t - 1 :: -1][: min(lag, t)] if t and lag else 0.0)
            j = min(len(m), t)
            e[t] = v - (m[:j] @ e[t - 1 :: -1][:j] if j else 0.0) if t >= lag else 0.0
        return e

    lag = p + ps * period
    start = np.zeros(k)
    if constant:
        start[-1] = z.mean()

    def loss(b: np.ndarray) -> float:
        e = errors(b)
        s = float(e @ e)
        return s if np.isfinite(s) else 1e300

    b, s = minimise(loss, start) if k else (start, loss(start))
    e, sigma2 = errors(b), s / max(n - lag - k, 1)
    ar, ma, sar, sma, c = split(b)
    a, m = _poly(ar, sar, period), -_poly(-np.asarray(ma), -np.asarray(sma), period)
    x, ee = list(z - c), list(e)
    for _ in range(horizon):
        x.append(sum(a[i] * x[-1 - i] for i in range(min(len(a), len(x)))) + sum(m[i] * ee[-1 - i] for i in range(min(len(m), len(ee)))))
        ee.append(0.0)
    f = np.array(x[n:]) + c
    psi = np.zeros(horizon)
    full = a
    for _, step in reversed(history):
        add = np.zeros(step)
        add[-1] = 1.0
        full = -np.convolve(np.concatenate([[1.0], -full]), np.concatenate([[1.0], -add]))[1:]
    for j in range(horizon):
        psi[j] = 1.0 if j == 0 else (m[j - 1] if j - 1 < len(m) else 0.0) + sum(full[i] * psi[j - 1 - i] for i in range(min(j, len(full))))
    for base, step in reversed(history):
        tail = list(base[-step:])
        out = []
        for v in f:
            nv = v + tail[-step]
            out.append(nv)
            tail.append(nv)
        f = np.array(out)
    se = np.sqrt(sigma2 * np.cumsum(psi**2))
    half = sp.normal_quantile(0.5 + confidence / 2)
    ll = -0.5 * (n - lag) * (math.log(2 * math.pi * s / max(n - lag, 1)) + 1)
    return {"parameters": b, "sigma2": sigma2, "forecast": f, "lower": f - half * se, "upper": f + half * se, "aic": 2 * (k + 1) - 2 * ll, "residuals": e}


def ets(y: np.ndarray, trend: bool = False, damped: bool = False, seasonal: str = "none", period: int = 12, horizon: int = 10) -> dict:
    """Exponential smoothing with additive errors; trend, damping and additive or multiplicative seasons; smoothing by least
    squares."""
    y = np.asarray(y, float)
    n = len(y)
    if seasonal != "none":
        first = y[:period].mean()
        season0 = y[:period] - first if seasonal == "additive" else y[:period] / first
        level0 = first
        trend0 = (y[period : 2 * period].mean() - first) / period if trend and n >= 2 * period else 0.0
    else:
        season0, level0, trend0 = np.zeros(0), y[0], (y[1] - y[0]) if trend else 0.0

    def walk(b: np.ndarray) -> tuple[np.ndarray, float, float, list]:
        s = 1 / (1 + np.exp(-b))
        alpha, i = s[0], 1
        bt = gm = 0.0
        phi = 1.0
        if trend:
            bt, i = s[i], i + 1
        if damped:
            phi, i = 0.8 + 0.2 * s[i], i + 1
        if seasonal != "none":
            gm = s[i]
        level, slope, sea = level0, trend0, list(season0)
        e = np.zeros(n)
        for t in range(n):
            base = level + phi * slope
            c = sea[t % period] if seasonal != "none" else (0.0 if seasonal != "multiplicative" else 1.0)
            f = base * c if seasonal == "multiplicative" else base + c
            e[t] = y[t] - f
            new = alpha * (y[t] / c if seasonal == "multiplicative" else y[t] - c) + (1 - alpha) * base
            if trend:
                slope = bt * (new - level) + (1 - bt) * phi * slope
            if seasonal != "none":
                sea[t % period] = gm * (y[t] / new if seasonal == "multiplicative" else y[t] - new) + (1 - gm) * c
            level = new
        return e, level, slope, sea

    k = 1 + int(trend) + int(damped) + int(seasonal != "none")
    b, _ = minimise(lambda v: float((walk(v)[0] ** 2).sum()), np.full(k, -1.0))
    e, level, slope, sea = walk(b)
    s = 1 / (1 + np.exp(-b))
    phi = 0.8 + 0.2 * s[1 + int(trend)] if damped else 1.0
    out, damp = [], 0.0
    for h in range(1, horizon + 1):
        damp += phi**h if trend else 0.0
        base = level + damp * slope
        c = sea[(n + h - 1) % period] if seasonal != "none" else 0.0
        out.append(base * c if seasonal == "multiplicative" else base + c)
    return {"smoothing": s, "forecast": np.array(out), "sse": float(e @ e), "level": level, "slope": slope}


def garch(y: np.ndarray, p: int = 1, q: int = 1, kind: str = "garch", horizon: int = 10) -> dict:
    """arch, garch, gjr or egarch with Gaussian errors and a constant mean."""
    y = np.asarray(y, float)
    v0 = float(y.var())

    def variances(b: np.ndarray, e: np.ndarray) -> np.ndarray:
        h = np.empty(len(e))
        if kind == "egarch":
            om, al, ga, be = b[1], b[2 : 2 + p], b[2 + p : 2 + 2 * p], np.tanh(b[2 + 2 * p :])
            lh = np.empty(len(e))
            for t in range(len(e)):
                v = om
                for i in range(p):
                    z = e[t - 1 - i] / math.exp(lh[t - 1 - i] / 2) if t > i else 0.0
                    v += al[i] * (abs(z) - math.sqrt(2 / math.pi)) + ga[i] * z if t > i else 0.0
                for j in range(q):
                    v += be[j] * (lh[t - 1 - j] if t > j else math.log(v0))
                lh[t] = min(max(v, -50), 50)
            return np.exp(lh)
        om, w = math.exp(b[1]), np.exp(b[2:]) / (1 + np.exp(b[2:]).sum())
        al, ga, be = w[:p], (w[p : 2 * p] if kind == "gjr" else np.zeros(p)), (w[-q:] if kind != "arch" else np.zeros(0))
        for t in range(len(e)):
            v = om
            for i in range(p):
                s = e[t - 1 - i] ** 2 if t > i else v0
                v += (al[i] + 2 * ga[i] * (t > i and e[t - 1 - i] < 0)) * s
            for j in range(len(be)):
                v += be[j] * (h[t - 1 - j] if t > j else v0)
            h[t] = v
        return h

    size = {"arch": 2 + p, "garch": 2 + p + q, "gjr": 2 + 2 * p + q, "egarch": 2 + 2 * p + q}[kind]

    def loss(b: np.ndarray) -> float:
        e = y - b[0]
        h = variances(b, e)
        s = 0.5 * float((np.log(h) + e * e / h).sum())
        return s if np.isfinite(s) else 1e300

    start = np.zeros(size)
    start[0], start[1] = y.mean(), math.log(v0 * 0.1) if kind != "egarch" else math.log(v0) * 0.1
    if kind != "egarch":
        start[2 : 2 + p] = -1.0
        if kind != "arch":
            start[-q:] = 1.5
    b, s = minimise(loss, start, 4000)
    e = y - b[0]
    h = variances(b, e)
    w = np.exp(b[2:]) / (1 + np.exp(b[2:]).sum()) if kind != "egarch" else b[2:]
    return {"mean": b[0], "omega": math.exp(b[1]) if kind != "egarch" else b[1], "weights": w, "loglik": -s - 0.5 * len(y) * math.log(2 * math.pi), "variance": h}


def grey(y: np.ndarray, horizon: int = 10) -> dict:
    """GM(1,1)."""
    y = np.asarray(y, float)
    x = np.cumsum(y)
    z = -(x[1:] + x[:-1]) / 2
    a, b = np.linalg.lstsq(np.column_stack([z, np.ones(len(z))]), y[1:], rcond=None)[0]
    k = np.arange(len(y) + horizon)
    acc = (y[0] - b / a) * np.exp(-a * k) + b / a
    f = np.concatenate([[y[0]], np.diff(acc)])
    return {"a": a, "b": b, "fitted": f[: len(y)], "forecast": f[len(y) :]}


def markov(df: DataFrame, state: str, order: list[str], partition: list[str] = (), pseudocount: float = 0.0) -> pd.DataFrame:
    """Transition probabilities, counted over neighbours of each partition."""
    w = Window.partitionBy(*partition).orderBy(*order)
    c = df.select(F.col(state).alias("a"), F.lead(state).over(w).alias("b")).where("b is not null").groupBy("a", "b").count().toPandas()  # a row per pair of states
    t = c.pivot(index="a", columns="b", values="count").fillna(0)
    states = sorted(set(t.index) | set(t.columns))
    t = t.reindex(index=states, columns=states).fillna(0) + pseudocount
    return t.div(t.sum(1), axis=0)


# -- vector models -------------------------------------------------------------------------------------------------


def _lagged(df: DataFrame, columns: list[str], order: str, lags: int) -> DataFrame:
    w = Window.orderBy(order)
    base = df.select(F.col(order).alias("__o"), *[operand(c).alias(c) for c in columns])
    w = Window.orderBy("__o")
    d = base.select(*columns, *[F.lag(c, k).over(w).alias(f"{c}_l{k}") for k in range(1, lags + 1) for c in columns])
    return d.where(F.col(f"{columns[0]}_l{lags}").isNotNull()) if lags else d


def var(df: DataFrame, columns: list[str], order: str, lags: int = 1) -> dict:
    """A vector autoregression with a constant, from one Gram matrix of the lagged columns."""
    m = len(columns)
    g, n = gram(_lagged(df, columns, order, lags), [*columns, *[f"{c}_l{k}" for k in range(1, lags + 1) for c in columns]])
    iy, ix = list(range(1, m + 1)), [0, *range(m + 1, len(g))]
    inv = np.linalg.inv(g[np.ix_(ix, ix)])
    b = inv @ g[np.ix_(ix, iy)]
    s = g[np.ix_(iy, iy)] - b.T @ g[np.ix_(ix, iy)]
    sigma = s / (n - len(ix))
    ml = s / n
    ll = -0.5 * n * (m * math.log(2 * math.pi) + np.linalg.slogdet(ml)[1] + m)
    k = b.size
    return {"columns": columns, "lags": lags, "n": n, "coefficients": b, "sigma": sigma, "sigma_ml": ml, "inv": inv, "loglik": ll, "aic": (2 * k - 2 * ll) / n, "bic": (k * math.log(n) - 2 * ll) / n, "hqic": (2 * k * math.log(math.log(n)) - 2 * ll) / n, "matrices": [b[1 + i * m : 1 + (i + 1) * m].T for i in range(lags)]}


def lag_order(df: DataFrame, columns: list[str], order: str, max_lags: int) -> list[dict]:
    """Criteria of all orders on the common sample, from one Gram matrix."""
    m = len(columns)
    g, n = gram(_lagged(df, columns, order, max_lags), [*columns, *[f"{c}_l{k}" for k in range(1, max_lags + 1) for c in columns]])
    out = []
    for p in range(max_lags + 1):
        iy, ix = list(range(1, m + 1)), [0, *range(m + 1, m + 1 + m * p)]
        s = g[np.ix_(iy, iy)] - g[np.ix_(iy, ix)] @ np.linalg.solve(g[np.ix_(ix, ix)], g[np.ix_(ix, iy)])
        ld = np.linalg.slogdet(s / n)[1]
        ll, k = -0.5 * n * (m * math.log(2 * math.pi) + ld + m), m * (m * p + 1)
        out.append({"lag": p, "loglik": ll, "fpe": math.exp(ld) * ((n + m * p + 1) / (n - m * p - 1)) ** m, "aic": (2 * k - 2 * ll) / n, "hqic": (2 * k * math.log(math.log(n)) - 2 * ll) / n, "sbic": (k * math.log(n) - 2 * ll) / n})
    return out


def granger(model: dict) -> list[dict]:
    """Wald tests that the lags of one column do not help another."""
    c, m, p = model["columns"], len(model["columns"]), model["lags"]
    out = []
    for j, effect in enumerate(c):
        cov = model["inv"] * model["sigma"][j, j]
        for i, cause in enumerate(c):
            if i != j:
                at = [1 + k * m + i for k in range(p)]
                b = model["coefficients"][at, j]
                stat = float(b @ np.linalg.solve(cov[np.ix_(at, at)], b))
                out.append({"effect": effect, "cause": cause, "statistic": stat, "df": p, "p_value": sp.chi2_sf(stat, p)})
    return out


def irf(model: dict, steps: int) -> np.ndarray:
    """Orthogonalised responses: [step, variable, shock]."""
    m = len(model["columns"])
    phi = [np.eye(m)]
    for s in range(1, steps + 1):
        phi.append(sum(model["matrices"][k] @ phi[s - 1 - k] for k in range(min(s, model["lags"]))))
    chol = np.linalg.cholesky(model["sigma"])
    return np.array([x @ chol for x in phi])


def fevd(model: dict, steps: int) -> np.ndarray:
    """Shares of the forecast error variance: [horizon, variable, shock]."""
    c = np.cumsum(irf(model, steps - 1) ** 2, 0)
    return c / c.sum(2, keepdims=True)


def johansen(df: DataFrame, columns: list[str], order: str, lags: int = 1) -> list[dict]:
    """Trace and maximum-eigenvalue statistics with an unrestricted constant; moments from one Gram matrix."""
    w = Window.orderBy("__o")
    base = df.select(F.col(order).alias("__o"), *[operand(c).alias(c) for c in columns])
    d = base.select("__o", *columns, *[(F.col(c) - F.lag(c).over(w)).alias(f"d_{c}") for c in columns], *[F.lag(c).over(w).alias(f"l_{c}") for c in columns])
    d = d.select(*[f"d_{c}" for c in columns], *[f"l_{c}" for c in columns], *[F.lag(f"d_{c}", k).over(w).alias(f"d{k}_{c}") for k in range(1, lags) for c in columns])
    d = d.where(" and ".join(f"`{c}` is not null" for c in d.columns))
    g, n = gram(d, d.columns)
    m = len(columns)
    i0, i1, iz = list(range(1, m + 1)), list(range(m + 1, 2 * m + 1)), [0, *range(2 * m + 1, len(g))]
    zz = np.linalg.inv(g[np.ix_(iz, iz)])
    s = lambda a, b: (g[np.ix_(a, b)] - g[np.ix_(a, iz)] @ zz @ g[np.ix_(iz, b)]) / n
    ev = np.sort(np.real(np.linalg.eigvals(np.linalg.solve(s(i1, i1), s(i1, i0) @ np.linalg.solve(s(i0, i0), s(i0, i1))))))[::-1]
    return [{"rank": r, "eigenvalue": float(ev[r]), "trace": float(-n * np.log(1 - ev[r:]).sum()), "maximum": float(-n * math.log(1 - ev[r]))} for r in range(m)]


def vec(df: DataFrame, columns: list[str], order: str, rank: int, lags: int = 1) -> dict:
    """Cointegrating vectors and adjustment by reduced-rank regression."""
    w = Window.orderBy("__o")
    base = df.select(F.col(order).alias("__o"), *[operand(c).alias(c) for c in columns])
    d = base.select("__o", *[(F.col(c) - F.lag(c).over(w)).alias(f"d_{c}") for c in columns], *[F.lag(c).over(w).alias(f"l_{c}") for c in columns])
    d = d.select(*[f"d_{c}" for c in columns], *[f"l_{c}" for c in columns], *[F.lag(f"d_{c}", k).over(w).alias(f"d{k}_{c}") for k in range(1, lags) for c in columns])
    d = d.where(" and ".join(f"`{c}` is not null" for c in d.columns))
    g, n = gram(d, d.columns)
    m = len(columns)
    i0, i1, iz = list(range(1, m + 1)), list(range(m + 1, 2 * m + 1)), [0, *range(2 * m + 1, len(g))]
    zz = np.linalg.inv(g[np.ix_(iz, iz)])
    s = lambda a, b: (g[np.ix_(a, b)] - g[np.ix_(a, iz)] @ zz @ g[np.ix_(iz, b)]) / n
    val, vecs = np.linalg.eig(np.linalg.solve(s(i1, i1), s(i1, i0) @ np.linalg.solve(s(i0, i0), s(i0, i1))))
    beta = np.real(vecs[:, np.argsort(-np.real(val))[:rank]])
    beta = beta @ np.linalg.inv(beta[:rank])
    alpha = s(i0, i1) @ beta @ np.linalg.inv(beta.T @ s(i1, i1) @ beta)
    return {"beta": beta, "alpha": alpha, "n": n}


def ecm(df: DataFrame, y: str, x: list[str], order: str) -> dict:
    """Long-run regression, then differences on the lagged residual."""
    from tidewell.stats.linear import fit

    long = fit(df, y, x)
    w = Window.orderBy("__o")
    d = df.select(F.col(order).alias("__o"), operand(y).alias("y"), *[operand(c).alias(f"x{i}") for i, c in enumerate(x)], (operand(y) - long.linear()).alias("e"))
    d = d.select((F.col("y") - F.lag("y").over(w)).alias("dy"), *[(F.col(f"x{i}") - F.lag(f"x{i}").over(w)).alias(f"dx{i}") for i in range(len(x))], F.lag("e").over(w).alias("ec")).where("ec is not null")
    short = fit(d, "dy", [*[f"dx{i}" for i in range(len(x))], "ec"])
    return {"long_run": long.beta, "short_run": short.beta, "adjustment": float(short.beta[-1])}


def panel_unit_root(df: DataFrame, value: str, entity: str, time: str, lags: int = 1) -> dict:
    """Fisher's combination of ADF tests of the entities, which run side by side; p-values by a normal approximation of the tau
    statistic's 5 and 1 percent points."""

    def one(y: np.ndarray) -> dict:
        d = np.diff(y)
        t = len(d) - lags
        x = np.column_stack([np.ones(t), y[lags:-1], *[d[lags - k : len(d) - k] for k in range(1, lags + 1)]])
        b, *_ = np.linalg.lstsq(x, d[lags:], rcond=None)
        e = d[lags:] - x @ b
        se = math.sqrt(e @ e / (t - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
        stat = b[1] / se
        scale = (-3.43035 - -2.86154) / (sp.normal_quantile(0.01) - sp.normal_quantile(0.05))
        return {"stat": stat, "p": min(1.0, max(1e-12, sp.normal_cdf((stat + 2.86154) / scale + sp.normal_quantile(0.05))))}

    r = per_series(df, value, [time], one, "stat double, p double", [entity]).agg(F.sum(-2 * F.log("p")).alias("s"), F.count(F.lit(1)).alias("k")).first()
    return {"statistic": r["s"], "df": 2 * r["k"], "p_value": sp.chi2_sf(r["s"], 2 * r["k"])}
