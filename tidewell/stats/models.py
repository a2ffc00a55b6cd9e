"""Models fitted by maximum likelihood or iterated weighting, all through the distributed passes of ``core``."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.guards import operand
from tidewell.stats import special as sp
from tidewell.stats.core import exact_median, fitted, maximise, moments, solve_ls

_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def _phi(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def _log_cdf(z: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(0.5 * _erfc(-z / math.sqrt(2)), 1e-300))


def _prepare(df: DataFrame, y: str | Column, x: list[str | Column], more: dict[str, Column | str] | None = None) -> tuple[DataFrame, list[str], list[str], np.ndarray, np.ndarray]:
    """y and standardised predictors under plain names; means and scales to turn coefficients back."""
    cols = [operand(c) for c in x]
    d = df.select(operand(y).alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(cols)], *[operand(c).alias(n) for n, c in (more or {}).items()])
    names = [f"x{i}" for i in range(len(cols))]
    m = moments(d, names) if names else {}
    mean = np.array([m[n]["mean"] for n in names])
    scale = np.array([math.sqrt(m[n]["var"]) or 1.0 for n in names])
    z = d.select("y", *[((F.col(n) - float(a)) / float(s)).alias(n) for n, a, s in zip(names, mean, scale)], *(more or {}))
    return z, ["y", *names, *(more or {})], names, mean, scale


def _eta(b: np.ndarray, a: dict[str, np.ndarray], names: list[str], constant: bool = True) -> np.ndarray:
    out = np.full(len(a["y"]), b[0]) if constant else np.zeros(len(a["y"]))
    for v, n in zip(b[int(constant):], names):
        out = out + v * a[n]
    return out


def _back(r: dict, k: int, mean: np.ndarray, scale: np.ndarray, constant: bool = True) -> dict:
    """Coefficients and covariance in original units; parameters after the first ``k`` are left as they are."""
    p = len(r["parameters"])
    t = np.eye(p)
    c = int(constant)
    for j in range(k - c):
        t[j + c, j + c] = 1 / scale[j]
        if constant:
            t[0, j + c] = -mean[j] / scale[j]
    beta, cov = t @ r["parameters"], t @ r["covariance"] @ t.T
    return r | {"parameters": beta, "covariance": cov, "se": np.sqrt(np.maximum(np.diag(cov), 0))}


def _table(r: dict, names: list[str]) -> dict:
    z = r["parameters"] / np.where(r["se"] > 0, r["se"], np.nan)
    k = len(names)
    return r | {"terms": names, "z": z, "p_value": np.array([2 * sp.normal_sf(abs(v)) if np.isfinite(v) else np.nan for v in z]), "aic": 2 * k - 2 * r["loglik"]}


def generic(df: DataFrame, y: str | Column, x: list, loglik: Callable, extra: list[tuple[str, float]] = (), start0: float = 0.0, more: dict | None = None, constant: bool = True, iterations: int = 100) -> dict:
    """Fit ``loglik(eta, extra parameters, arrays)`` with a linear predictor."""
    z, cols, names, mean, scale = _prepare(df, y, x, more)
    k = len(names) + int(constant)

    def ll(b: np.ndarray, a: dict[str, np.ndarray]) -> np.ndarray:
        return loglik(_eta(b[:k], a, names, constant), b[k:], a)

    start = np.zeros(k + len(extra))
    if constant:
        start[0] = start0
    start[k:] = [v for _, v in extra]
    r = _back(maximise(z, cols, ll, start, iterations), k, mean, scale, constant)
    terms = (["Intercept"] if constant else []) + [c if isinstance(c, str) else f"x{i}" for i, c in enumerate(x)] + [n for n, _ in extra]
    return _table(r, terms)


def _softplus(v: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, v)


def logit(df: DataFrame, y: str, x: list) -> dict:
    return generic(df, y, x, lambda e, _, a: a["y"] * e - _softplus(e))


def probit(df: DataFrame, y: str, x: list) -> dict:
    return generic(df, y, x, lambda e, _, a: np.where(a["y"] > 0.5, _log_cdf(e), _log_cdf(-e)))


def cloglog(df: DataFrame, y: str, x: list) -> dict:
    return generic(df, y, x, lambda e, _, a: np.where(a["y"] > 0.5, np.log(np.maximum(-np.expm1(-np.exp(np.minimum(e, 30))), 1e-300)), -np.exp(np.minimum(e, 30))))


def poisson(df: DataFrame, y: str, x: list) -> dict:
    m = moments(df, [y])[y]["mean"]
    return generic(df, y, x, lambda e, _, a: a["y"] * e - np.exp(np.minimum(e, 50)) - _lgamma(a["y"] + 1), start0=math.log(m))


def negative_binomial(df: DataFrame, y: str, x: list) -> dict:
    """NB2; ``log_alpha`` is the logarithm of the dispersion."""
    m = moments(df, [y])[y]["mean"]

    def ll(e: np.ndarray, p: np.ndarray, a: dict) -> np.ndarray:
        r, mu = math.exp(-p[0]), np.exp(np.minimum(e, 50))
        return _lgamma(a["y"] + r) - math.lgamma(r) - _lgamma(a["y"] + 1) + r * np.log(r / (r + mu)) + a["y"] * np.log(mu / (r + mu))

    return generic(df, y, x, ll, [("log_alpha", -1.0)], math.log(m))


def gamma(df: DataFrame, y: str, x: list) -> dict:
    """Log link; ``log_shape`` is the logarithm of the shape."""
    m = moments(df, [y])[y]["mean"]

    def ll(e: np.ndarray, p: np.ndarray, a: dict) -> np.ndarray:
        k = math.exp(p[0])
        return k * math.log(k) - k * e + (k - 1) * np.log(a["y"]) - k * a["y"] * np.exp(-e) - math.lgamma(k)

    return generic(df, y, x, ll, [("log_shape", 0.0)], math.log(m))


def inverse_gaussian(df: DataFrame, y: str, x: list) -> dict:
    m = moments(df, [y])[y]["mean"]

    def ll(e: np.ndarray, p: np.ndarray, a: dict) -> np.ndarray:
        lam, mu = math.exp(p[0]), np.exp(e)
        return 0.5 * (p[0] - math.log(2 * math.pi) - 3 * np.log(a["y"])) - lam * (a["y"] - mu) ** 2 / (2 * mu**2 * a["y"])

    return generic(df, y, x, ll, [("log_lambda", 0.0)], math.log(m))


def beta(df: DataFrame, y: str, x: list) -> dict:
    """Responses strictly between 0 and 1; logit mean, constant precision."""

    def ll(e: np.ndarray, p: np.ndarray, a: dict) -> np.ndarray:
        phi, mu = math.exp(p[0]), np.clip(1 / (1 + np.exp(-e)), 1e-12, 1 - 1e-12)
        return math.lgamma(phi) - _lgamma(mu * phi) - _lgamma((1 - mu) * phi) + (mu * phi - 1) * np.log(a["y"]) + ((1 - mu) * phi - 1) * np.log1p(-a["y"])

    return generic(df, y, x, ll, [("log_precision", 1.0)])


def fractional(df: DataFrame, y: str, x: list) -> dict:
    """Quasi-likelihood for shares, 0 and 1 included."""
    return logit(df, y, x)


def glm(df: DataFrame, y: str, x: list, family: str = "poisson", link: str | None = None) -> dict:
    """binomial (logit, probit, cloglog), poisson, gamma, inverse_gaussian (log) or gaussian (identity, log)."""
    if family == "binomial":
        return {"logit": logit, "probit": probit, "cloglog": cloglog}[link or "logit"](df, y, x)
    if family == "gaussian":
        f = (lambda e: e) if (link or "identity") == "identity" else np.exp
        return generic(df, y, x, lambda e, p, a: -0.5 * ((a["y"] - f(e)) * math.exp(-p[0])) ** 2 - p[0] - 0.5 * math.log(2 * math.pi), [("log_sigma", 0.0)])
    return {"poisson": poisson, "gamma": gamma, "inverse_gaussian": inverse_gaussian, "negative_binomial": negative_binomial}[family](df, y, x)


def tobit(df: DataFrame, y: str, x: list, lower: float | None = 0.0, upper: float | None = None) -> dict:
    m = moments(df, [y])[y]

    def ll(e: np.ndarray, p: np.ndarray, a: dict) -> np.ndarray:
        s = math.exp(p[0])
        out = -0.5 * ((a["y"] - e) / s) ** 2 - p[0] - 0.5 * math.log(2 * math.pi)
        if lower is not None:
            out = np.where(a["y"] <= lower, _log_cdf((lower - e) / s), out)
        if upper is not None:
            out = np.where(a["y"] >= upper, _log_cdf((e - upper) / s), out)
        return out

    return generic(df, y, x, ll, [("log_sigma", 0.5 * math.log(m["var"]))], m["mean"])


def zero_inflated(df: DataFrame, y: str, x: list, negative: bool = False) -> dict:
    """Constant inflation probability (``inflation`` is its logit) before a Poisson or NB2 count."""
    m = moments(df, [y])[y]["mean"]

    def ll(e: np.ndarray, p: np.ndarray, a: dict) -> np.ndarray:
        mu, q = np.exp(np.minimum(e, 50)), p[0]
        if negative:
            r = math.exp(-p[1])
            zero = r * np.log(r / (r + mu))
            count = _lgamma(a["y"] + r) - math.lgamma(r) - _lgamma(a["y"] + 1) + zero + a["y"] * np.log(mu / (r + mu))
        else:
            zero, count = -mu, a["y"] * e - mu - _lgamma(a["y"] + 1)
        return np.where(a["y"] == 0, np.logaddexp(q, zero), count) - np.logaddexp(0, q)

    return generic(df, y, x, ll, [("inflation", -1.0), *([("log_alpha", -1.0)] if negative else [])], math.log(m))


def ordinal_logit(df: DataFrame, y: str, x: list, levels: int) -> dict:
    """Codes 0 .. levels-1; cut points as a first one and logarithms of the steps."""

    def ll(e: np.ndarray, p: np.ndarray, a: dict) -> np.ndarray:
        cuts = np.concatenate([[-np.inf], np.cumsum(np.concatenate([[p[0]], np.exp(p[1:])])), [np.inf]])
        k = a["y"].astype(int)
        s = lambda v: 1 / (1 + np.exp(-np.clip(v, -500, 500)))
        return np.log(np.maximum(s(cuts[k + 1] - e) - s(cuts[k] - e), 1e-300))

    return generic(df, y, x, ll, [("cut1", -1.0), *[(f"log_step{i}", 0.0) for i in range(2, levels)]], constant=False)


def multinomial_logit(df: DataFrame, y: str, x: list, levels: int) -> dict:
    """Codes 0 .. levels-1; code 0 is the reference."""
    z, cols, names, mean, scale = _prepare(df, y, x)
    k = len(names) + 1

    def ll(b: np.ndarray, a: dict) -> np.ndarray:
        eta = np.vstack([np.zeros(len(a["y"])), *[_eta(b[i * k : (i + 1) * k], a, names) for i in range(levels - 1)]])
        top = eta.max(0)
        return eta[a["y"].astype(int), np.arange(len(a["y"]))] - top - np.log(np.exp(eta - top).sum(0))

    r = maximise(z, cols, ll, np.zeros(k * (levels - 1)))
    t = np.zeros((k * (levels - 1),) * 2)
    for g in range(levels - 1):
        o = g * k
        t[o, o] = 1
        for j in range(k - 1):
            t[o + j + 1, o + j + 1], t[o, o + j + 1] = 1 / scale[j], -mean[j] / scale[j]
    cov = t @ r["covariance"] @ t.T
    return _table(r | {"parameters": t @ r["parameters"], "covariance": cov, "se": np.sqrt(np.diag(cov))}, [f"{g + 1}.{n}" for g in range(levels - 1) for n in ["Intercept", *map(str, x)]])


def firth_logit(df: DataFrame, y: str, x: list, iterations: int = 100) -> dict:
    """Jeffreys-penalised logit: each step is a pass for the information and one for the adjusted score."""
    k = len(x) + 1
    design = [F.lit(1.0), *[operand(c) for c in x]]
    beta = np.zeros(k)
    for step in range(iterations):
        p = 1 / (1 + F.exp(-fitted(x, beta)))
        w = p * (1 - p)
        r = df.agg(*[F.sum(design[i] * design[j] * w).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        info = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                info[i, j] = info[j, i] = r[f"h{i}_{j}"]
        inv = np.linalg.inv(info)
        h = F.lit(0.0)
        for i in range(k):
            for j in range(k):
                h = h + F.lit(float(inv[i, j])) * design[i] * design[j]
        score = operand(y) - p + h * w * (0.5 - p)
        s = df.agg(*[F.sum(d * score).alias(f"s{i}") for i, d in enumerate(design)]).first()
        move = inv @ np.array([s[f"s{i}"] for i in range(k)])
        move *= min(1.0, 5.0 / max(1e-12, np.max(np.abs(move))))
        beta = beta + move
        if np.max(np.abs(move)) < 1e-9:
            break
    return {"terms": ["Intercept", *map(str, x)], "parameters": beta, "covariance": inv, "se": np.sqrt(np.diag(inv)), "iterations": step + 1}


def conditional_logit(df: DataFrame, y: str, x: list, group: str) -> dict:
    """Conditional on the number of cases in each stratum, by the recursion over its rows; strata are bounded groups."""
    import pandas as pd

    m = moments(df, [c for c in x])
    scale = np.array([math.sqrt(m[c]["var"]) or 1.0 for c in x])
    mean = np.array([m[c]["mean"] for c in x])
    k = len(x)
    both = df.groupBy(group).agg(F.min(operand(y)).alias("a"), F.max(operand(y)).alias("b")).where("a < b").select(group)
    data = df.join(both, group).select(group, operand(y).alias("y"), *[((operand(c) - float(mu)) / float(s)).alias(f"x{i}") for i, (c, mu, s) in enumerate(zip(x, mean, scale))]).cache()

    def evaluate(points: list[np.ndarray]) -> np.ndarray:
        def run(p: pd.DataFrame) -> pd.DataFrame:
            yy, xx = p["y"].to_numpy(), p[[f"x{i}" for i in range(k)]].to_numpy()
            cases = int(yy.sum())
            out = []
            for b in points:
                e = xx @ b
                f = np.full(cases + 1, -np.inf)
                f[0] = 0.0
                for v in e:
                    f[1:] = np.logaddexp(f[1:], f[:-1] + v)
                out.append(float(yy @ e - f[cases]))
            return pd.DataFrame([out], columns=[f"s{i}" for i in range(len(points))])

        names = [f"s{i}" for i in range(len(points))]
        r = data.groupBy(group).applyInPandas(run, ", ".join(f"{n} double" for n in names)).agg(*[F.sum(n).alias(n) for n in names]).first()
        return np.array([r[n] for n in names])

    b, h = np.zeros(k), 1e-4
    for step in range(50):
        eye = np.eye(k) * h
        pts = [b, *[b + e for e in eye], *[b - e for e in eye], *[b + eye[i] + eye[j] for i in range(k) for j in range(i)], *[b - eye[i] - eye[j] for i in range(k) for j in range(i)]]
        v = evaluate(pts)
        g = (v[1 : 1 + k] - v[1 + k : 1 + 2 * k]) / (2 * h)
        hess = np.diag((v[1 : 1 + k] - 2 * v[0] + v[1 + k : 1 + 2 * k]) / h**2)
        at, half = 1 + 2 * k, k * (k - 1) // 2
        for i in range(k):
            for j in range(i):
                hess[i, j] = hess[j, i] = (v[at] + v[at + half] - v[1 + i] - v[1 + j] - v[1 + k + i] - v[1 + k + j] + 2 * v[0]) / (2 * h * h)
                at += 1
        move = np.linalg.solve(hess, -g)
        b = b + move
        if np.max(np.abs(move)) < 1e-7:
            break
    data.unpersist()
    cov = np.linalg.inv(-hess) / np.outer(scale, scale)
    return {"terms": list(x), "parameters": b / scale, "covariance": cov, "se": np.sqrt(np.diag(cov)), "loglik": v[0], "iterations": step + 1}


def frontier(df: DataFrame, y: str, x: list, cost: bool = False) -> dict:
    """Normal and half-normal errors; ``log_sigma_v`` and ``log_sigma_u``."""
    r = solve_ls(df, y, x)
    s0 = math.sqrt(r["rss"] / r["n"])
    sign = -1.0 if cost else 1.0

    def ll(e: np.ndarray, p: np.ndarray, a: dict) -> np.ndarray:
        sv, su = math.exp(p[0]), math.exp(p[1])
        s, lam, u = math.sqrt(sv * sv + su * su), su / sv, a["y"] - e
        return math.log(2) - math.log(s) + np.log(np.maximum(_phi(u / s), 1e-300)) + _log_cdf(-sign * u * lam / s)

    return generic(df, y, x, ll, [("log_sigma_v", math.log(s0)), ("log_sigma_u", math.log(s0))], moments(df, [y])[y]["mean"])


#: Rows near the fit that quantile regression takes to the driver at once.
BAND_ROWS = 200_000


def _least_check_loss(x: np.ndarray, y: np.ndarray, q: float) -> tuple[np.ndarray, float]:
    """Coefficients of the least check loss of rows in memory, and the gap to the dual bound relative to the loss.

    Primal-dual interior point steps with predictor and corrector; then the corner at the rows whose dual values are not
    at a bound, if its loss is not larger."""

    def loss(b: np.ndarray) -> float:
        e = y - x @ b
        return float(np.sum(np.where(e >= 0, q * e, (q - 1) * e)))

    def step(v: np.ndarray, dv: np.ndarray) -> float:
        down = dv < 0
        return float(np.min(-v[down] / dv[down])) if down.any() else 1e20

    n, k = x.shape
    a, s = np.full(n, 1 - q), np.full(n, q)
    right = a @ x
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    r = y - x @ beta
    r = np.where(r == 0, 1e-3, r)
    w, z = np.maximum(r, 0), np.maximum(-r, 0)
    w, z = w + 1e-3 * np.abs(r), z + 1e-3 * np.abs(r)
    for _ in range(200):
        if loss(beta) - (a @ y - (1 - q) * y.sum()) <= 1e-13 * (1 + np.abs(y).sum()):
            break
        d = 1 / (z / a + w / s)
        normal = (x.T * d) @ x
        rd = y - x @ beta + z - w
        rp = right - a @ x
        if not np.all(np.isfinite(normal)):
            break

        def direction(mu: float, az: np.ndarray | float, sw: np.ndarray | float) -> tuple[np.ndarray, ...]:
            h = rd - z + w + (mu - az) / a - (mu - sw) / s
            db = np.linalg.lstsq(normal, x.T @ (d * h) - rp, rcond=None)[0]
            da = d * (h - x @ db)
            return db, da, (mu - az - z * da) / a - z, (mu - sw + w * da) / s - w

        db, da, dz, dw = direction(0.0, 0.0, 0.0)
        fp, fd = min(1.0, step(a, da), step(s, -da)), min(1.0, step(z, dz), step(w, dw))
        mu = a @ z + s @ w
        mu = mu * (((a + fp * da) @ (z + fd * dz) + (s - fp * da) @ (w + fd * dw)) / mu) ** 3 / (2 * n)
        db, da, dz, dw = direction(mu, da * dz, -da * dw)
        fp, fd = min(1.0, 0.9995 * step(a, da), 0.9995 * step(s, -da)), min(1.0, 0.9995 * step(z, dz), 0.9995 * step(w, dw))
        a, s = a + fp * da, s - fp * da
        beta, z, w = beta + fd * db, z + fd * dz, w + fd * dw
    corner: list[int] = []
    for i in np.argsort(-np.minimum(a, s))[: 50 * k]:
        if np.linalg.matrix_rank(x[[*corner, i]]) > len(corner):
            corner.append(int(i))
        if len(corner) == k:
            at = np.linalg.solve(x[corner], y[corner])
            beta = at if loss(at) <= loss(beta) else beta
            break
    least = loss(beta)
    return beta, (least - (a @ y - (1 - q) * y.sum())) / (least + 1e-300) if least > 0 else 0.0


def quantile(df: DataFrame, y: str, x: list, q: float = 0.5, iterations: int = 200, tolerance: float = 1e-7) -> dict:
    """The coefficients of the least check loss, exactly, over all rows.

    The rows near a first fit (of a sample, if there are many) are solved on the driver, with the sums of the rows above
    and of those below for one row each.  If these rows keep their sides at the solution, it is that of all rows: a sum's
    loss is never more than the losses of its rows.  Else the rows that changed sides are added to the near ones, and so
    on.  Three passes a step; it is an error if ``iterations`` steps or the solver's gap to the dual bound
    (relative, ``tolerance``) do not settle it.
    """
    cols = [operand(c) for c in x]
    names = [f"x{i}" for i in range(len(cols) + 1)]
    data = df.select(F.lit(1.0).alias("x0"), *[c.cast("double").alias(n) for c, n in zip(cols, names[1:])], operand(y).cast("double").alias("y")).cache()
    try:
        m = moments(data, [*names[1:], "y"])
        n = data.count()
        shift = np.array([0.0, *[m[c]["mean"] for c in names[1:]], m["y"]["mean"]])
        scale = np.array([1.0, *[math.sqrt(m[c]["var"]) or 1.0 for c in [*names[1:], "y"]]])

        def solve(rows: np.ndarray) -> tuple[np.ndarray, float]:
            """Rows are sums of k original rows with k at their first place; coefficients in original units."""
            z = (rows - rows[:, :1] * shift) / scale
            b, gap = _least_check_loss(z[:, :-1], z[:, -1], q)
            slope = b[1:] / scale[1:-1] * scale[-1]
            return np.array([b[0] * scale[-1] + shift[-1] - slope @ shift[1:-1], *slope]), gap

        def near(rows: DataFrame) -> np.ndarray:
            """Equal rows as one, times their number: the check loss grows in proportion."""
            got = rows.groupBy(*names, "y").agg(F.count(F.lit(1)).alias("n")).toPandas()
            return got[[*names, "y"]].to_numpy(float) * got[["n"]].to_numpy(float)

        share = min(1.0, BAND_ROWS / n)
        beta, gap = solve(near(data.sample(share, 1) if share < 1 else data))
        if share < 1:
            e = F.col("y") - fitted(names[1:], beta)
            width = data.agg(F.percentile_approx(F.abs(e), share, 10_000)).first()[0]
            inside = F.abs(e) <= width
            for step in range(iterations):
                sides = data.where(~inside).groupBy((e > 0).alias("above")).agg(*[F.sum(c).alias(c) for c in [*names, "y"]]).toPandas()
                beta, gap = solve(np.vstack([near(data.where(inside)), sides[[*names, "y"]].to_numpy(float)]))
                now = F.col("y") - fitted(names[1:], beta)
                crossed = (e > 0) & (now < 0) | (e < 0) & (now > 0)
                if not data.where(~inside & crossed).count():
                    break
                inside = inside | crossed
            else:
                raise ArithmeticError(f"quantile regression did not settle in {iterations} steps")
        else:
            step = 0
        if not gap <= tolerance:
            raise ArithmeticError(f"quantile regression stopped at a relative gap of {gap:g}")
        e = F.col("y") - fitted(names[1:], beta)
        loss = data.agg(F.sum(F.when(e >= 0, e * q).otherwise(-e * (1 - q)))).first()[0]
    finally:
        data.unpersist()
    return {"terms": ["Intercept", *map(str, x)], "parameters": beta, "check_loss": loss, "iterations": step + 1}


def robust(df: DataFrame, y: str, x: list, loss: str = "huber", tuning: float | None = None, iterations: int = 200, tolerance: float = 1e-7) -> dict:
    """Huber or Tukey weights; the scale is the median absolute residual over 0.67448975, renewed each step.

    The median is looked for around the one of the step before.
    """
    c = tuning or {"huber": 1.345, "tukey": 4.685}[loss]
    first = solve_ls(df, y, x)
    beta, middle, near = first["beta"], 0.0, 3 * math.sqrt(first["rss"] / first["n"])
    for step in range(iterations):
        e = operand(y) - fitted(x, beta)
        before, middle = middle, exact_median(df, F.abs(e), max(middle - near, 0.0), middle + near)
        near = 2 * abs(middle - before)
        s = middle / 0.67448975
        u = F.abs(e) / (c * s)
        w = F.when(u <= 1, 1.0).otherwise(1 / u) if loss == "huber" else F.when(u < 1, (1 - u * u) * (1 - u * u)).otherwise(0.0)
        new = solve_ls(df.select("*", w.alias("__w")), y, x, "__w")["beta"]
        done = np.max(np.abs(new - beta)) < tolerance * (1 + np.max(np.abs(beta)))
        beta = new
        if done:
            break
    return {"terms": ["Intercept", *map(str, x)], "parameters": beta, "scale": s, "iterations": step + 1}


def nonlinear(df: DataFrame, y: str, x: str, model: str = "exponential", start: list[float] | None = None) -> dict:
    """exponential, logistic, michaelis_menten or gompertz, as a Gaussian likelihood."""
    forms = {
        "exponential": lambda b, v: b[0] * np.exp(np.clip(b[1] * v, -50, 50)), "logistic": lambda b, v: b[0] / (1 + np.exp(np.clip(-b[1] * (v - b[2]), -500, 500))),
        "michaelis_menten": lambda b, v: b[0] * v / (b[1] + v), "gompertz": lambda b, v: b[0] * np.exp(-np.exp(np.clip(-b[1] * (v - b[2]), -500, 50))),
    }
    f = forms[model]
    m = moments(df, [y, x])
    r = df.agg(F.max(operand(y)).alias("t")).first()["t"]
    auto = {"exponential": [m[y]["mean"], 0.0], "logistic": [r, 1 / math.sqrt(m[x]["var"]), m[x]["mean"]], "michaelis_menten": [r, m[x]["mean"]], "gompertz": [r, 1 / math.sqrt(m[x]["var"]), m[x]["mean"]]}[model]
    b0 = np.array([*(start or auto), 0.5 * math.log(m[y]["var"])], float)
    d = df.select(operand(y).alias("y"), operand(x).alias("x"))
    out = maximise(d, ["y", "x"], lambda b, a: -0.5 * ((a["y"] - f(b, a["x"])) * np.exp(-b[-1])) ** 2 - b[-1], b0)
    return _table(out, [*[f"b{i + 1}" for i in range(len(b0) - 1)], "log_sigma"])


def formula(df: DataFrame, y: str, expression: str, columns: list[str], start: list[float]) -> dict:
    """Nonlinear least squares of an expression in ``b1, b2, ...`` and the columns; see ``formula.parse``."""
    from tidewell.stats.formula import parse

    tree = parse(expression)
    k = len(start)
    m = moments(df, [y])[y]
    d = df.select(operand(y).alias("__y"), *[operand(c).alias(c) for c in columns])

    def ll(b: np.ndarray, a: dict) -> np.ndarray:
        env = {f"b{i + 1}": b[i] for i in range(k)} | {c: a[c] for c in columns}
        return -0.5 * ((a["__y"] - tree(env)) * np.exp(-b[k])) ** 2 - b[k]

    return _table(maximise(d, ["__y", *columns], ll, np.array([*start, 0.5 * math.log(m["var"])])), [*[f"b{i + 1}" for i in range(k)], "log_sigma"])


# -- after a binary fit --------------------------------------------------------------------------------------------


def probability(x: list, model: dict, link: str = "logit") -> Column:
    e = fitted(x, model["parameters"][: len(x) + 1])
    if link == "logit":
        return 1 / (1 + F.exp(-e))
    if link == "cloglog":
        return 1 - F.exp(-F.exp(e))
    return normal_cdf_column(e)


def normal_cdf_column(z: Column) -> Column:
    """The normal distribution function as an expression (series of erf by Abramowitz and Stegun 7.1.26 has too few
    digits; this is the continued form of West, good to 14 digits)."""
    a = F.abs(z)
    e = F.exp(-a * a / 2)
    num, den = F.lit(3.52624965998911e-02), F.lit(8.83883476483184e-02)
    for c in (0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376):
        num = num * a + c
    for c in (1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752):
        den = den * a + c
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, e * num / den).otherwise(e / (2.506628274631 * (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65)))))))
    return F.when(z > 0, 1 - tail).otherwise(tail)


def margins(df: DataFrame, x: list[str], model: dict, link: str = "logit") -> dict[str, float]:
    """Average marginal effects: one pass."""
    e = fitted(x, model["parameters"][: len(x) + 1])
    d = F.exp(-e) / (1 + F.exp(-e)) ** 2 if link == "logit" else F.exp(-e * e / 2) / math.sqrt(2 * math.pi)
    mean = df.agg(F.avg(d)).first()[0]
    return {c: float(mean * b) for c, b in zip(x, model["parameters"][1:])}


def classification(df: DataFrame, y: str, x: list[str], model: dict, link: str = "logit", cut: float = 0.5) -> dict:
    p = probability(x, model, link)
    r = df.agg(*[F.count_if((operand(y) == t) & ((p >= cut) == bool(s))).alias(f"n{t}{s}") for t in (0, 1) for s in (0, 1)]).first()
    tn, fp, fn, tp = r["n00"], r["n01"], r["n10"], r["n11"]
    return {"accuracy": (tn + tp) / (tn + fp + fn + tp), "sensitivity": tp / (tp + fn), "specificity": tn / (tn + fp), "tp": tp, "fp": fp, "fn": fn, "tn": tn}


def hosmer_lemeshow(df: DataFrame, y: str, x: list[str], model: dict, groups: int = 10) -> dict:
    p = probability(x, model)
    cuts = df.agg(F.percentile(p, [i / groups for i in range(1, groups)])).first()[0]
    slot = F.lit(0)
    for c in sorted(set(cuts)):
        slot = slot + (p > c).cast("int")
    g = df.groupBy(slot.alias("s")).agg(F.sum(operand(y)).alias("o"), F.sum(p).alias("e"), F.count(F.lit(1)).alias("n")).toPandas()
    stat = float(((g["o"] - g["e"]) ** 2 / (g["e"] * (1 - g["e"] / g["n"]))).sum())
    return {"statistic": stat, "df": len(g) - 2, "p_value": sp.chi2_sf(stat, len(g) - 2)}


# -- treatment effects ---------------------------------------------------------------------------------------------


def ipw(df: DataFrame, y: str, treatment: str, x: list[str], overlap: float = 1e-6) -> dict:
    """Normalised weights from a logit propensity."""
    p = F.greatest(F.least(probability(x, logit(df, treatment, x)), F.lit(1 - overlap)), F.lit(overlap))
    d, v = operand(treatment), operand(y)
    r = df.agg(*[F.sum(e).alias(n) for n, e in (("a", d * v / p), ("b", d / p), ("c", (1 - d) * v / (1 - p)), ("e", (1 - d) / (1 - p)), ("t", d * v), ("u", d), ("f", (1 - d) * v * p / (1 - p)), ("g", (1 - d) * p / (1 - p)))]).first()
    return {"ate": r["a"] / r["b"] - r["c"] / r["e"], "att": r["t"] / r["u"] - r["f"] / r["g"], "treated": r["a"] / r["b"], "control": r["c"] / r["e"]}


def regression_adjustment(df: DataFrame, y: str, treatment: str, x: list[str]) -> dict:
    b1, b0 = (solve_ls(df.where(operand(treatment) == t), y, x)["beta"] for t in (1, 0))
    m1, m0 = fitted(x, b1), fitted(x, b0)
    d = operand(treatment)
    r = df.agg(F.avg(m1 - m0).alias("ate"), (F.sum(d * (m1 - m0)) / F.sum(d)).alias("att")).first()
    return {"ate": r["ate"], "att": r["att"]}


def aipw(df: DataFrame, y: str, treatment: str, x: list[str]) -> dict:
    p = probability(x, logit(df, treatment, x))
    b1, b0 = (solve_ls(df.where(operand(treatment) == t), y, x)["beta"] for t in (1, 0))
    m1, m0, d, v = fitted(x, b1), fitted(x, b0), operand(treatment), operand(y)
    i = m1 - m0 + d * (v - m1) / p - (1 - d) * (v - m0) / (1 - p)
    r = df.agg(F.avg(i).alias("m"), F.stddev_samp(i).alias("s"), F.count(F.lit(1)).alias("n")).first()
    se = r["s"] / math.sqrt(r["n"])
    return {"ate": r["m"], "standard_error": se, "p_value": 2 * sp.normal_sf(abs(r["m"] / se))}


def matching(df: DataFrame, y: str, treatment: str, x: list[str], caliper: float | None = None, blocks: int = 64) -> dict:
    """One nearest neighbour by propensity, with replacement, ties averaged.

    The rows are sorted by propensity across partitions; a row's nearest neighbour of the other kind is the last one
    before or the first one after it, found by a pass over each range block with the edges of its neighbours.
    """
    p = probability(x, logit(df, treatment, x))
    rows = df.select(p.alias("p"), operand(treatment).cast("int").alias("d"), operand(y).alias("v"))
    sums = rows.groupBy("p", "d").agg(F.avg("v").alias("m"), F.sum("v").alias("s"), F.count(F.lit(1)).alias("k"))
    cut = [float(c) for c in sums.agg(F.percentile_approx("p", [i / blocks for i in range(1, blocks)])).first()[0] or []]
    slot = F.lit(0)
    for c in sorted(set(cut)):
        slot = slot + (F.col("p") > c).cast("int")
    s = sums.withColumn("b", slot)
    w = Window.partitionBy("b").orderBy("p", "d")
    side = lambda t, frame, pick: pick(F.when(F.col("d") == t, F.struct("p", "m")), ignorenulls=True).over(frame)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    edge = s.groupBy("b").agg(*[e for t in (0, 1) for e in (F.max(F.when(F.col("d") == t, F.struct("p", "m"))).alias(f"hi{t}"), F.min(F.when(F.col("d") == t, F.struct("p", "m"))).alias(f"lo{t}"))])
    wb = Window.orderBy("b")  # a row per block
    edge = edge.select("b", *[F.last(f"hi{t}", ignorenulls=True).over(wb.rowsBetween(Window.unboundedPreceding, -1)).alias(f"before{t}") for t in (0, 1)], *[F.first(f"lo{t}", ignorenulls=True).over(wb.rowsBetween(1, Window.unboundedFollowing)).alias(f"after{t}") for t in (0, 1)])
    j = s.select("*", *[side(t, back, F.last).alias(f"l{t}") for t in (0, 1)], *[side(t, ahead, F.first).alias(f"r{t}") for t in (0, 1)]).join(F.broadcast(edge), "b")
    other = 1 - F.col("d")
    left = F.when(other == 1, F.coalesce("l1", "before1")).otherwise(F.coalesce("l0", "before0"))
    right = F.when(other == 1, F.coalesce("r1", "after1")).otherwise(F.coalesce("r0", "after0"))
    j = j.select("p", "d", "s", "k", left.alias("a"), right.alias("z"))
    da, dz = F.coalesce(F.col("p") - F.col("a.p"), F.lit(float("inf"))), F.coalesce(F.col("z.p") - F.col("p"), F.lit(float("inf")))
    near = F.when(da < dz, F.col("a.m")).when(dz < da, F.col("z.m")).otherwise((F.col("a.m") + F.col("z.m")) / 2)
    m = j.select("d", "s", "k", near.alias("c"), F.least(da, dz).alias("dist"))
    if caliper is not None:
        m = m.where(F.col("dist") <= caliper)
    effect = F.when(F.col("d") == 1, F.col("s") - F.col("k") * F.col("c")).otherwise(F.col("k") * F.col("c") - F.col("s"))
    r = m.agg(F.sum(effect).alias("a"), F.sum("k").alias("n"), F.sum(F.when(F.col("d") == 1, effect)).alias("t"), F.sum(F.when(F.col("d") == 1, F.col("k"))).alias("nt"), F.max("dist").alias("far")).first()
    return {"ate": r["a"] / r["n"], "att": r["t"] / r["nt"], "maximum_distance": r["far"]}


def rdd(df: DataFrame, y: str, running: str, cutoff: float = 0.0, bandwidth: float = 1.0, kernel: str = "triangular") -> dict:
    """The jump of local linear fits on both sides."""
    z = operand(running) - cutoff
    w = F.greatest(1 - F.abs(z) / bandwidth, F.lit(0.0)) if kernel == "triangular" else F.lit(1.0)
    d = df.select(operand(y).alias("y"), z.alias("z"), w.alias("w")).where(F.abs("z") < bandwidth)
    right, left = solve_ls(d.where("z >= 0"), "y", ["z"], "w"), solve_ls(d.where("z < 0"), "y", ["z"], "w")
    return {"jump": right["beta"][0] - left["beta"][0], "right": right["beta"][0], "left": left["beta"][0], "n": right["n"] + left["n"]}


def synthetic_control(y: np.ndarray, donors: np.ndarray, pre: int, iterations: int = 20_000) -> dict:
    """Convex donor weights by projected gradients on the first ``pre`` periods (a small matrix of periods by donors)."""
    a, b = donors[:pre], y[:pre]
    step = 1 / max(np.linalg.norm(a.T @ a, 2), 1e-12)
    w = np.full(a.shape[1], 1 / a.shape[1])
    for _ in range(iterations):
        v = w - step * (a.T @ (a @ w - b))
        u = np.sort(v)[::-1]
        rho = np.nonzero(u + (1 - np.cumsum(u)) / np.arange(1, len(u) + 1) > 0)[0][-1]
        new = np.maximum(v + (1 - u[: rho + 1].sum()) / (rho + 1), 0)
        if np.max(np.abs(new - w)) < 1e-12:
            break
        w = new
    return {"weights": w, "pre_rmse": float(np.sqrt(np.mean((a @ w - b) ** 2))), "effects": y[pre:] - donors[pre:] @ w}


def heckman(df: DataFrame, y: str, selected: str, x: list[str], z: list[str]) -> dict:
    """Probit selection, then least squares with the inverse Mills ratio."""
    sel = probit(df, selected, z)
    e = fitted(z, sel["parameters"][: len(z) + 1])
    mills = (F.exp(-e * e / 2) / math.sqrt(2 * math.pi)) / normal_cdf_column(e)
    r = solve_ls(df.where(operand(selected) == 1).withColumn("__mills", mills), y, [*x, "__mills"])
    return {"terms": ["Intercept", *x, "mills"], "parameters": r["beta"], "selection": sel["parameters"]}


def sur(df: DataFrame, equations: list[tuple[str, list[str]]]) -> dict:
    """Feasible GLS over several equations, from one Gram matrix."""
    from tidewell.stats.core import gram

    names = list(dict.fromkeys([c for y, x in equations for c in (y, *x)]))
    g, n = gram(df, names)
    at = {c: i + 1 for i, c in enumerate(names)}
    sets = [([0, *[at[c] for c in x]], at[y]) for y, x in equations]
    ols = [np.linalg.solve(g[np.ix_(i, i)], g[i, y]) for i, y in sets]
    m = len(sets)
    s = np.array([[g[sets[a][1], sets[b][1]] - ols[a] @ g[sets[a][0], sets[b][1]] - g[sets[a][1], sets[b][0]] @ ols[b] + ols[a] @ g[np.ix_(sets[a][0], sets[b][0])] @ ols[b] for b in range(m)] for a in range(m)]) / n
    w = np.linalg.inv(s)
    big = np.block([[w[a, b] * g[np.ix_(sets[a][0], sets[b][0])] for b in range(m)] for a in range(m)])
    rhs = np.concatenate([sum(w[a, b] * g[sets[a][0], sets[b][1]] for b in range(m)) for a in range(m)])
    cov = np.linalg.inv(big)
    return {"parameters": cov @ rhs, "se": np.sqrt(np.diag(cov)), "sigma": s}


# -- clustered data ------------------------------------------------------------------------------------------------


def random_intercept(df: DataFrame, y: str, x: list[str], group: str, iterations: int = 200) -> dict:
    """Maximum likelihood of a Gaussian random intercept.

    A group's contribution depends on its size, sums and cross products only, so the rows are read once (sums per
    group) and each step is a pass over groups.
    """
    cols = [F.lit(1.0), *[operand(c) for c in x], operand(y)]
    k = len(cols)
    g = df.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)], *[F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).cache()
    tri = [(i, j) for i in range(k) for j in range(i, k)]

    def sums(ratio: float) -> tuple[np.ndarray, float, float]:
        """X'V^-1X with V = I + ratio 11', log determinant, rows."""
        c = F.lit(ratio) / (1 + F.col("n") * ratio)
        r = g.agg(F.sum(F.log(1 + F.col("n") * ratio)).alias("d"), F.sum("n").alias("n"), *[F.sum(F.col(f"g{i}_{j}") - c * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in tri]).first()
        m = np.zeros((k, k))
        for i, j in tri:
            m[i, j] = m[j, i] = r[f"m{i}_{j}"]
        return m, r["d"], r["n"]

    def profile(log_ratio: float) -> tuple[float, np.ndarray, float, np.ndarray]:
        m, d, n = sums(math.exp(log_ratio))
        a = m[:-1, :-1]
        b = np.linalg.solve(a, m[:-1, -1])
        s2 = (m[-1, -1] - b @ m[:-1, -1]) / n
        return -0.5 * (n * (math.log(2 * math.pi * s2) + 1) + d), b, s2, np.linalg.inv(a) * s2

    lo, hi, gold = -12.0, 8.0, (math.sqrt(5) - 1) / 2
    c1, c2 = hi - gold * (hi - lo), lo + gold * (hi - lo)
    f1, f2 = profile(c1)[0], profile(c2)[0]
    for _ in range(iterations):
        if hi - lo < 1e-7:
            break
        if f1 > f2:
            hi, c2, f2 = c2, c1, f1
            c1 = hi - gold * (hi - lo)
            f1 = profile(c1)[0]
        else:
            lo, c1, f1 = c1, c2, f2
            c2 = lo + gold * (hi - lo)
            f2 = profile(c2)[0]
    at = (lo + hi) / 2
    ll, b, s2, cov = profile(at)
    g.unpersist()
    return {"terms": ["Intercept", *x], "parameters": b, "se": np.sqrt(np.diag(cov)), "sigma2": s2, "tau2": math.exp(at) * s2, "icc": math.exp(at) / (1 + math.exp(at)), "loglik": ll}


def gee(df: DataFrame, y: str, x: list[str], group: str, family: str = "gaussian", correlation: str = "exchangeable", iterations: int = 50) -> dict:
    """Independence or exchangeable working correlation with the cluster sandwich; every step sums over groups first."""
    link = {"gaussian": lambda e: (e, F.lit(1.0)), "binomial": lambda e: (1 / (1 + F.exp(-e)), None), "poisson": lambda e: (F.exp(e), None)}[family]
    k = len(x) + 1
    design = [F.lit(1.0), *[operand(c) for c in x]]
    beta, alpha = np.zeros(k), 0.0
    if family == "gaussian":
        beta = solve_ls(df, y, x)["beta"]
    for step in range(iterations):
        mu, var = link(fitted(x, beta))
        v = var if var is not None else (mu * (1 - mu) if family == "binomial" else mu)
        root = F.sqrt(v)
        r = (operand(y) - mu) / root
        d = [c * (F.lit(1.0) if family == "gaussian" else v) / root for c in design]  # scaled derivatives
        g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sum(r).alias("r"), F.sum(r * r).alias("rr"), *[F.sum(c).alias(f"d{i}") for i, c in enumerate(d)], *[F.sum(c * r).alias(f"e{i}") for i, c in enumerate(d)], *[F.sum(d[i] * d[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)])
        if correlation == "exchangeable":
            a = g.agg(F.sum(F.col("r") ** 2 - F.col("rr")).alias("p"), F.sum(F.col("n") * (F.col("n") - 1)).alias("q"), F.sum("rr").alias("s"), F.sum("n").alias("n")).first()
            phi = a["s"] / (a["n"] - k)
            alpha = a["p"] / a["q"] / phi if a["q"] else 0.0
        c = F.lit(alpha) / (1 + (F.col("n") - 1) * alpha)
        score = [(F.col(f"e{i}") - c * F.col(f"d{i}") * F.col("r")) / (1 - alpha) for i in range(k)]
        info = {(i, j): (F.col(f"g{i}_{j}") - c * F.col(f"d{i}") * F.col(f"d{j}")) / (1 - alpha) for i in range(k) for j in range(i, k)}
        t = g.agg(*[F.sum(s).alias(f"s{i}") for i, s in enumerate(score)], *[F.sum(e).alias(f"i{i}_{j}") for (i, j), e in info.items()], *[F.sum(score[i] * score[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        a, m = np.zeros((k, k)), np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                a[i, j] = a[j, i] = t[f"i{i}_{j}"]
                m[i, j] = m[j, i] = t[f"m{i}_{j}"]
        inv = np.linalg.inv(a)
        move = inv @ np.array([t[f"s{i}"] for i in range(k)])
        beta = beta + move
        if np.max(np.abs(move)) < 1e-9:
            break
    cov = inv @ m @ inv
    return {"terms": ["Intercept", *x], "parameters": beta, "se": np.sqrt(np.diag(cov)), "alpha": alpha, "iterations": step + 1}


def glmm(df: DataFrame, y: str, x: list[str], group: str, family: str = "binomial", nodes: int = 15) -> dict:
    """A Gaussian random intercept integrated by Gauss-Hermite quadrature; binomial, poisson or negative_binomial.

    Groups are bounded: a group's rows meet in one task.
    """
    import pandas as pd

    z, cols, names, mean, scale = _prepare(df.withColumn("__g", F.xxhash64(F.col(group))), y, x, {"g": F.lit(0.0)})
    del z
    m = moments(df, x)
    d = df.select(F.col(group).alias("g"), operand(y).alias("y"), *[((operand(c) - m[c]["mean"]) / (math.sqrt(m[c]["var"]) or 1.0)).alias(f"x{i}") for i, c in enumerate(x)]).cache()
    t, w = np.polynomial.hermite.hermgauss(nodes)
    k = len(x) + 1
    extra = 1 + int(family == "negative_binomial")

    def value(points: list[np.ndarray]) -> np.ndarray:
        def run(p: pd.DataFrame) -> pd.DataFrame:
            yy, xx = p["y"].to_numpy(), np.column_stack([np.ones(len(p)), *[p[f"x{i}"].to_numpy() for i in range(len(x))]])
            out = []
            for b in points:
                e = (xx @ b[:k])[:, None] + math.sqrt(2) * math.exp(b[k]) * t[None, :]
                if family == "binomial":
                    l = yy[:, None] * e - np.logaddexp(0, e)
                elif family == "poisson":
                    l = yy[:, None] * e - np.exp(np.minimum(e, 50)) - _lgamma(yy + 1)[:, None]
                else:
                    r, mu = math.exp(-b[k + 1]), np.exp(np.minimum(e, 50))
                    l = (_lgamma(yy + r) - math.lgamma(r) - _lgamma(yy + 1))[:, None] + r * np.log(r / (r + mu)) + yy[:, None] * np.log(mu / (r + mu))
                s = l.sum(0) + np.log(w) - 0.5 * math.log(math.pi)
                out.append(float(np.logaddexp.reduce(s)))
            return pd.DataFrame([out], columns=[f"s{i}" for i in range(len(points))])

        c = [f"s{i}" for i in range(len(points))]
        r = d.groupBy("g").applyInPandas(run, ", ".join(f"{n} double" for n in c)).agg(*[F.sum(n).alias(n) for n in c]).first()
        return np.array([r[n] for n in c])

    b = np.zeros(k + extra)
    b[k] = -0.7
    if family != "binomial":
        b[0] = math.log(max(moments(df, [y])[y]["mean"], 1e-6))
    q, h = len(b), 1e-4
    for step in range(40):
        e = np.eye(q) * h
        pairs = [(i, j) for i in range(q) for j in range(i)]
        v = value([b, *[b + a for a in e], *[b - a for a in e], *[b + e[i] + e[j] for i, j in pairs], *[b - e[i] - e[j] for i, j in pairs]])
        g = (v[1 : 1 + q] - v[1 + q : 1 + 2 * q]) / (2 * h)
        hess = np.diag((v[1 : 1 + q] - 2 * v[0] + v[1 + q : 1 + 2 * q]) / h**2)
        for n, (i, j) in enumerate(pairs):
            hess[i, j] = hess[j, i] = (v[1 + 2 * q + n] + v[1 + 2 * q + len(pairs) + n] - v[1 + i] - v[1 + j] - v[1 + q + i] - v[1 + q + j] + 2 * v[0]) / (2 * h * h)
        top = np.linalg.eigvalsh(hess)[-1]
        move = np.linalg.solve(hess - max(0.0, top + 1e-2) * np.eye(q), -g)
        move *= min(1.0, 2.0 / np.max(np.abs(move)))
        sizes = [1.0, 0.5, 0.25, 0.1]
        f = value([b + s * move for s in sizes])
        best = int(np.argmax(f))
        if f[best] <= v[0] + 1e-9 * abs(v[0]):
            break
        b = b + sizes[best] * move
    d.unpersist()
    sc = np.array([math.sqrt(m[c]["var"]) or 1.0 for c in x])
    beta = b[1:k] / sc
    return {"terms": ["Intercept", *x], "parameters": np.concatenate([[b[0] - sum(bb * m[c]["mean"] for bb, c in zip(beta, x))], beta]), "sigma_u": math.exp(b[k]), "loglik": v[0], "iterations": step + 1}
