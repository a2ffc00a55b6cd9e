"""Inequality, quality, psychometrics, power, designs, multivariate, paths, surveys and space."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.guards import operand
from tidewell.stats import special as sp
from tidewell.stats.core import cross, moments
from tidewell.stats.linear import fit

# -- inequality ----------------------------------------------------------------------------------------------------


def gini(df: DataFrame, x: str, weight: str | None = None) -> dict:
    """From the cumulative shares over distinct values, which are counted first."""
    w = operand(weight) if weight else F.lit(1.0)
    c = df.groupBy(operand(x).alias("x")).agg(F.sum(w).alias("k"))
    over = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    r = c.select("x", "k", F.coalesce(F.sum("k").over(over), F.lit(0.0)).alias("b")).agg(F.sum(F.col("x") * F.col("k") * (F.col("b") + F.col("k") / 2)).alias("s"), F.sum(F.col("x") * F.col("k")).alias("t"), F.sum("k").alias("n")).first()
    return {"gini": 2 * r["s"] / (r["n"] * r["t"]) - 1, "mean": r["t"] / r["n"], "observations": r["n"]}


def theil(df: DataFrame, x: str, group: str | None = None) -> dict:
    """Theil T with its parts between and within groups."""
    v = operand(x)
    s = F.sum(F.when(v > 0, v * F.log(v)).otherwise(0.0))
    if group is None:
        r = df.agg(s.alias("a"), F.sum(v).alias("t"), F.count(F.lit(1)).alias("n")).first()
        return {"theil_t": r["a"] / r["t"] - math.log(r["t"] / r["n"]), "observations": r["n"]}
    g = df.groupBy(group).agg(s.alias("a"), F.sum(v).alias("t"), F.count(F.lit(1)).alias("n")).where("t > 0")
    r = g.agg(F.sum("a").alias("a"), F.sum("t").alias("t"), F.sum("n").alias("n"), F.sum(F.col("t") * F.log(F.col("t") / F.col("n"))).alias("b")).first()
    total = r["a"] / r["t"] - math.log(r["t"] / r["n"])
    between = r["b"] / r["t"] - math.log(r["t"] / r["n"])
    return {"theil_t": total, "between": between, "within": total - between, "observations": r["n"]}


def dagum_gini(df: DataFrame, x: str, group: str) -> dict:
    """Within, between and transvariation parts; a pass over distinct (value, group) with running sums per group."""
    levels = sorted(r[0] for r in df.select(group).distinct().collect())
    k = len(levels)
    c = df.groupBy(operand(x).alias("x")).agg(*[F.count_if(F.col(group) == lv).cast("double").alias(f"n{i}") for i, lv in enumerate(levels)])
    w = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    c = c.select("x", *[F.col(f"n{i}") for i in range(k)], *[F.coalesce(F.sum(f"n{i}").over(w), F.lit(0.0)).alias(f"c{i}") for i in range(k)], *[F.coalesce(F.sum(F.col(f"n{i}") * F.col("x")).over(w), F.lit(0.0)).alias(f"s{i}") for i in range(k)])
    # sum over pairs (value of i above value of j) of the difference
    r = c.agg(*[F.sum(F.col(f"n{i}") * (F.col("x") * F.col(f"c{j}") - F.col(f"s{j}"))).alias(f"d{i}_{j}") for i in range(k) for j in range(k)], *[F.sum(f"n{i}").alias(f"N{i}") for i in range(k)], *[F.sum(F.col(f"n{i}") * F.col("x")).alias(f"S{i}") for i in range(k)]).first()
    n, s = np.array([r[f"N{i}"] for i in range(k)]), np.array([r[f"S{i}"] for i in range(k)])
    mu, total_n, total_s = s / n, n.sum(), s.sum()
    d = np.array([[r[f"d{i}_{j}"] for j in range(k)] for i in range(k)])
    scale = total_n**2 * 2 * total_s / total_n
    within = sum(2 * d[i, i] for i in range(k)) / scale
    net = trans = 0.0
    for i in range(k):
        for j in range(i):
            hi, lo = (i, j) if mu[i] >= mu[j] else (j, i)
            net += 2 * (d[hi, lo] - d[lo, hi]) / scale
            trans += 2 * 2 * d[lo, hi] / scale
    return {"gini": within + net + trans, "within": within, "between": net, "transvariation": trans}


# -- quality -------------------------------------------------------------------------------------------------------


def control_chart(df: DataFrame, x: str, order: list[str], kind: str = "individuals", partition: list[str] = ()) -> DataFrame:
    """I or MR chart: limits from the mean moving range; rows with a flag."""
    w = Window.partitionBy(*partition).orderBy(*order)
    d = df.select(*order, *partition, operand(x).alias("x"), F.abs(operand(x) - F.lag(operand(x)).over(w)).alias("mr"))
    r = d.agg(F.avg("x").alias("m"), F.avg("mr").alias("r")).first()
    if kind == "individuals":
        c, lo, hi = r["m"], r["m"] - 3 * r["r"] / 1.128, r["m"] + 3 * r["r"] / 1.128
        v = F.col("x")
    else:
        c, lo, hi = r["r"], 0.0, 3.267 * r["r"]
        v = F.col("mr")
    return d.select(*order, *partition, v.alias("value"), F.lit(c).alias("center"), F.lit(lo).alias("lower"), F.lit(hi).alias("upper"), ((v < lo) | (v > hi)).alias("out"))


def process_capability(df: DataFrame, x: str, lower: float, upper: float, order: list[str], partition: list[str] = ()) -> dict:
    w = Window.partitionBy(*partition).orderBy(*order)
    r = df.select(operand(x).alias("x"), F.abs(operand(x) - F.lag(operand(x)).over(w)).alias("mr")).agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"), F.avg("mr").alias("r")).first()
    m, s, sw = r["m"], r["s"], r["r"] / 1.128
    return {"cp": (upper - lower) / (6 * sw), "cpk": min(upper - m, m - lower) / (3 * sw), "pp": (upper - lower) / (6 * s), "ppk": min(upper - m, m - lower) / (3 * s), "mean": m, "sigma_within": sw, "sigma_overall": s}


def gage_rr(df: DataFrame, x: str, part: str, operator: str, interaction: bool = True) -> dict:
    """Crossed study with equal repetitions; variance components from sums of squares."""
    v = operand(x)
    cell = df.groupBy(part, operator).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    t = cell.agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"), F.sum(F.col("s") ** 2 / F.col("n")).alias("c"), F.max("n").alias("r"), F.min("n").alias("r0")).first()
    if t["r"] != t["r0"]:
        raise ValueError("cells differ in their repetitions")
    p = cell.groupBy(part).agg(F.sum("s").alias("s"), F.sum("n").alias("n")).agg(F.sum(F.col("s") ** 2 / F.col("n")).alias("a"), F.count(F.lit(1)).alias("k")).first()
    o = cell.groupBy(operator).agg(F.sum("s").alias("s"), F.sum("n").alias("n")).agg(F.sum(F.col("s") ** 2 / F.col("n")).alias("a"), F.count(F.lit(1)).alias("k")).first()
    cm = t["s"] ** 2 / t["n"]
    r, np_, no = t["r"], p["k"], o["k"]
    ms_p, ms_o = (p["a"] - cm) / (np_ - 1), (o["a"] - cm) / (no - 1)
    ss_i, ss_e = t["c"] - p["a"] - o["a"] + cm, t["q"] - t["c"]
    if interaction:
        ms_i, ms_e = ss_i / ((np_ - 1) * (no - 1)), ss_e / (np_ * no * (r - 1))
        vi = max(0.0, (ms_i - ms_e) / r)
    else:
        ms_e = (ss_i + ss_e) / (t["n"] - np_ - no + 1)
        ms_i, vi = ms_e, 0.0
    vo, vp = max(0.0, (ms_o - ms_i) / (np_ * r)), max(0.0, (ms_p - ms_i) / (no * r))
    rr = ms_e + vo + vi
    return {"repeatability": ms_e, "reproducibility": vo + vi, "gage_rr": rr, "part": vp, "total": rr + vp, "share": rr / (rr + vp), "distinct_categories": int(1.41 * math.sqrt(vp / rr)) if rr else 0}


# -- psychometrics -------------------------------------------------------------------------------------------------


def reliability(df: DataFrame, items: list[str]) -> dict:
    """Cronbach's alpha, raw and standardised, and alpha without each item, from one covariance matrix."""
    _, s, n = cross(df, items)
    c, k = s / (n - 1), len(items)
    alpha = lambda m: len(m) / (len(m) - 1) * (1 - np.trace(m) / m.sum())
    d = np.sqrt(np.diag(c))
    r = c / np.outer(d, d)
    mean_r = (r.sum() - k) / (k * (k - 1))
    drop = {i: float(alpha(np.delete(np.delete(c, j, 0), j, 1))) for j, i in enumerate(items)} if k > 2 else {}
    total = c.sum(1)
    rest = {i: float((total[j] - c[j, j]) / (d[j] * math.sqrt(c.sum() - 2 * total[j] + c[j, j]))) for j, i in enumerate(items)}
    return {"alpha": float(alpha(c)), "standardized_alpha": k * mean_r / (1 + (k - 1) * mean_r), "alpha_without": drop, "item_rest_correlation": rest, "n": n}


def validity(df: DataFrame, items: list[str]) -> dict:
    """KMO, MSA of the items and Bartlett's sphericity."""
    _, s, n = cross(df, items)
    d = np.sqrt(np.diag(s))
    r = s / np.outer(d, d)
    inv = np.linalg.inv(r)
    q = -inv / np.sqrt(np.outer(np.diag(inv), np.diag(inv)))
    off = ~np.eye(len(items), dtype=bool)
    r2, q2 = (r**2) * off, (q**2) * off
    p = len(items)
    stat = -(n - 1 - (2 * p + 5) / 6) * np.linalg.slogdet(r)[1]
    return {"kmo": float(r2.sum() / (r2.sum() + q2.sum())), "msa": (r2.sum(1) / (r2.sum(1) + q2.sum(1))), "bartlett": float(stat), "df": p * (p - 1) // 2, "p_value": sp.chi2_sf(stat, p * (p - 1) / 2)}


def item_analysis(df: DataFrame, items: list[str], tail: float = 0.27) -> list[dict]:
    """Difference of the item means between the high and the low group of the total score."""
    total = sum((operand(c) for c in items[1:]), operand(items[0]))
    lo, hi = df.agg(F.percentile(total, [tail, 1 - tail])).first()[0]
    r = df.agg(*[e for i, c in enumerate(items) for e in (F.avg(F.when(total >= hi, operand(c))).alias(f"h{i}"), F.avg(F.when(total <= lo, operand(c))).alias(f"l{i}"), F.var_samp(F.when(total >= hi, operand(c))).alias(f"u{i}"), F.var_samp(F.when(total <= lo, operand(c))).alias(f"v{i}"))], F.count_if(total >= hi).alias("nh"), F.count_if(total <= lo).alias("nl")).first()
    return [{"item": c, "high": r[f"h{i}"], "low": r[f"l{i}"], "difference": r[f"h{i}"] - r[f"l{i}"], "t": (r[f"h{i}"] - r[f"l{i}"]) / math.sqrt(r[f"u{i}"] / r["nh"] + r[f"v{i}"] / r["nl"])} for i, c in enumerate(items)]


def content_validity(df: DataFrame, items: list[str]) -> dict:
    """Rows are experts, ratings 1..4."""
    r = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg((F.col(c) >= 3).cast("double")).alias(f"i{i}") for i, c in enumerate(items)]).first()
    v = np.array([r[f"i{i}"] for i in range(len(items))])
    return {"item_cvi": v, "scale_cvi_average": float(v.mean()), "scale_cvi_universal": float((v == 1).mean()), "experts": r["n"]}


# -- power ---------------------------------------------------------------------------------------------------------


def power_of(test: str, n: float, alpha: float = 0.05, alternative: str = "two_sided", **e: float) -> float:
    """Power of a planned test of ``n`` (per group where there are two)."""
    two = alternative == "two_sided"
    a = alpha / 2 if two else alpha
    sign = -1.0 if alternative == "less" else 1.0

    def normal(shift: float, scale: float = 1.0) -> float:
        z = sp.normal_quantile(1 - a)
        up = sp.normal_sf((z - sign * shift) / scale)
        return up + (sp.normal_cdf((-z - sign * shift) / scale) if two else 0.0)

    def student(df: float, delta: float) -> float:
        t = sp.t_quantile(1 - a, df)
        return 1 - sp.noncentral_t_cdf(t, df, sign * delta) + (sp.noncentral_t_cdf(-t, df, sign * delta) if two else 0.0)

    if test == "normal_mean":
        return normal(e["effect_size"] * math.sqrt(n))
    if test == "paired":
        return student(n - 1, e["effect_size"] * math.sqrt(n))
    if test == "mean_difference":
        return student(2 * n - 2, e["effect_size"] * math.sqrt(n / 2))
    if test == "proportion":
        p0, p = e["null_proportion"], e["proportion"]
        return normal((p - p0) / math.sqrt(p0 * (1 - p0) / n), math.sqrt(p * (1 - p) / (p0 * (1 - p0))))
    if test == "proportion_difference":
        p1, p2 = e["proportion1"], e["proportion2"]
        m = (p1 + p2) / 2
        return normal((p1 - p2) / math.sqrt(2 * m * (1 - m) / n), math.sqrt((p1 * (1 - p1) + p2 * (1 - p2)) / (2 * m * (1 - m))))
    if test == "variance":
        r, df = e["variance_ratio"], n - 1
        up = sp.chi2_sf(sp.chi2_quantile(1 - a, df) / r, df)
        down = 1 - sp.chi2_sf(sp.chi2_quantile(a, df) / r, df)
        return up + down if two else up if alternative == "greater" else down
    if test == "correlation":
        return normal(math.atanh(e["correlation"]) * math.sqrt(n - 3))
    if test == "anova":
        k = e["groups"]
        return sp.noncentral_f_sf(sp.f_quantile(1 - alpha, k - 1, k * (n - 1)), k - 1, k * (n - 1), e["effect_size"] ** 2 * k * n)
    if test == "regression":
        p, f2 = e["predictors"], e["effect_size"]
        return sp.noncentral_f_sf(sp.f_quantile(1 - alpha, p, n - p - 1), p, n - p - 1, f2 * n)
    if test == "chi_square":
        return sp.noncentral_chi2_sf(sp.chi2_quantile(1 - alpha, e["df"]), e["df"], n * e["effect_size"] ** 2)
    if test == "logrank":
        q = e.get("allocation", 0.5)
        return normal(math.log(e["hazard_ratio"]) * math.sqrt(n * e["event_fraction"] * q * (1 - q)))
    if test == "noninferiority":
        return sp.normal_sf(sp.normal_quantile(1 - alpha) - (e["difference"] + e["margin"]) / math.sqrt(2 * e["sd"] ** 2 / n))
    if test == "equivalence":
        z, s = sp.normal_quantile(1 - alpha), math.sqrt(2 * e["sd"] ** 2 / n)
        return max(0.0, sp.normal_cdf((e["margin"] - e["difference"]) / s - z) - sp.normal_cdf(-(e["margin"] + e["difference"]) / s + z))
    if test == "poisson":
        events = n * e["rate"] * e.get("exposure", 1.0)
        return normal(math.log(e["rate_ratio"]) / math.sqrt(1 / events + 1 / (events * e["rate_ratio"])))
    if test == "logistic":
        odds = [e["probability"] / (1 - e["probability"]) * r for r in (1.0, e["odds_ratio"])]
        return normal(math.log(e["odds_ratio"]) * math.sqrt(n / sum((1 + o) ** 2 / o for o in odds)))  # 1 / (p (1 - p)) of both groups
    if test == "cox":
        return normal(math.log(e["hazard_ratio"]) * math.sqrt(n * e["event_fraction"] * e["predictor_variance"]))
    if test == "cluster_mean":
        return student(2 * (n - 1), e["effect_size"] * math.sqrt(n * e["cluster_size"] / (1 + (e["cluster_size"] - 1) * e["icc"]) / 2))
    raise ValueError(f"unknown test {test}")


POWER_TESTS = ("normal_mean", "paired", "mean_difference", "proportion", "proportion_difference", "variance", "correlation", "anova", "regression", "chi_square", "logrank", "noninferiority", "equivalence", "poisson", "logistic", "cox", "cluster_mean")


def sample_size(test: str, target: float = 0.8, **e: float) -> int:
    """The smallest whole n that reaches the power."""
    low, high = 4, 8
    while power_of(test, high, **e) < target:
        low, high = high, high * 2
        if high > 1 << 40:
            raise ValueError("no sample reaches this power")
    while high - low > 1:
        mid = (low + high) // 2
        if power_of(test, mid, **e) < target:
            low = mid
        else:
            high = mid
    return low if power_of(test, low, **e) >= target else high


# -- designs -------------------------------------------------------------------------------------------------------


def full_factorial(levels: int, factors: int) -> np.ndarray:
    return np.array([[(r // levels**f) % levels for f in range(factors)] for r in range(levels**factors)])


def orthogonal_design(levels: int, factors: int) -> np.ndarray:
    """A linear design over a prime field with as few runs as its columns allow."""
    if levels < 2 or any(levels % d == 0 for d in range(2, int(levels**0.5) + 1)):
        raise ValueError("the number of levels is prime")
    m = 1
    while (levels**m - 1) // (levels - 1) < factors:
        m += 1
    vectors = [v for v in itertools.product(range(levels), repeat=m) if any(v) and next(x for x in v if x) == 1][:factors]
    runs = full_factorial(levels, m)
    return np.array([[int(np.dot(r, v)) % levels for v in vectors] for r in runs])


def centered_discrepancy(x: np.ndarray) -> float:
    """Centered L2 discrepancy of points in the unit cube, squared as it is usually given."""
    n, s = x.shape
    d = np.abs(x - 0.5)
    a = (13 / 12) ** s - 2 / n * np.prod(1 + 0.5 * d - 0.5 * d * d, 1).sum()
    b = sum(np.prod(1 + 0.5 * d[i] + 0.5 * d - 0.5 * np.abs(x[i] - x), 1).sum() for i in range(n))
    return float(max(a + b / n**2, 0))


def uniform_design(runs: int, factors: int, candidates: int = 200, seed: int = 0) -> tuple[np.ndarray, float]:
    g = np.random.default_rng(seed)
    best = min((np.column_stack([g.permutation(runs) for _ in range(factors)]) for _ in range(candidates)), key=lambda d: centered_discrepancy((d + 0.5) / runs))
    return best + 1, centered_discrepancy((best + 0.5) / runs)


def range_analysis(df: DataFrame, y: str, factors: list[str], maximize: bool = True) -> list[dict]:
    out = []
    for f in factors:
        g = df.groupBy(f).agg(F.avg(operand(y)).alias("m")).orderBy(f).collect()
        m = [r["m"] for r in g]
        best = g[int(np.argmax(m) if maximize else np.argmin(m))][f]
        out.append({"factor": f, "range": max(m) - min(m), "best_level": str(best)})
    return sorted(out, key=lambda r: -r["range"])


def response_surface(df: DataFrame, y: str, factors: list[str]) -> dict:
    """Full quadratic in coded units, with its stationary point."""
    r = df.agg(*[f(operand(c)).alias(f"{n}{i}") for i, c in enumerate(factors) for n, f in (("a", F.min), ("z", F.max))]).first()
    mid = [(r[f"a{i}"] + r[f"z{i}"]) / 2 for i in range(len(factors))]
    half = [(r[f"z{i}"] - r[f"a{i}"]) / 2 for i in range(len(factors))]
    z = [(operand(c) - m) / h for c, m, h in zip(factors, mid, half)]
    k = len(factors)
    pairs = [(i, j) for i in range(k) for j in range(i + 1, k)]
    m = fit(df, y, [*z, *[v * v for v in z], *[z[i] * z[j] for i, j in pairs]])
    b = np.diag(m.beta[1 + k : 1 + 2 * k]).astype(float)
    for n, (i, j) in enumerate(pairs):
        b[i, j] = b[j, i] = m.beta[1 + 2 * k + n] / 2
    at = np.linalg.solve(-2 * b, m.beta[1 : 1 + k])
    return {"coefficients": m.beta, "stationary": np.array(mid) + at * np.array(half), "eigenvalues": np.linalg.eigvalsh(b), "r_squared": 1 - m.rss / m.tss}


def dose_response(df: DataFrame, dose: str, y: str) -> dict:
    """Four-parameter log-logistic as a Gaussian likelihood."""
    from tidewell.stats.core import maximise

    r = df.agg(F.min(operand(y)).alias("a"), F.max(operand(y)).alias("z"), F.percentile(operand(dose), 0.5).alias("m"), F.var_samp(operand(y)).alias("v")).first()
    d = df.select(operand(dose).alias("d"), operand(y).alias("y"))

    def f(b: np.ndarray, x: np.ndarray) -> np.ndarray:
        return b[0] + (b[1] - b[0]) / (1 + np.where(x > 0, np.exp(np.clip(np.exp(b[3]) * (np.log(np.maximum(x, 1e-300)) - b[2]), -500, 500)), 0.0))

    m = maximise(d, ["d", "y"], lambda b, a: -0.5 * ((a["y"] - f(b, a["d"])) * np.exp(-b[4])) ** 2 - b[4], np.array([r["a"], r["z"], math.log(max(r["m"], 1e-9)), 0.0, 0.5 * math.log(r["v"] / 4)]))
    b = m["parameters"]
    return {"asymptote_infinite": b[0], "asymptote_zero": b[1], "ed50": math.exp(b[2]), "hill": math.exp(b[3]), "sigma": math.exp(b[4])}


# -- multivariate --------------------------------------------------------------------------------------------------


def pca(df: DataFrame, columns: list[str], standardize: bool = True) -> dict:
    mean, s, n = cross(df, columns)
    c = s / (n - 1)
    d = np.sqrt(np.diag(c)) if standardize else np.ones(len(columns))
    val, vec = np.linalg.eigh(c / np.outer(d, d))
    val, vec = val[::-1], vec[:, ::-1]
    vec = vec * np.sign(vec[np.argmax(np.abs(vec), 0), range(len(val))])
    return {"eigenvalues": val, "shares": val / val.sum(), "vectors": vec, "means": mean, "scales": d}


def pca_scores(df: DataFrame, columns: list[str], model: dict, axes: int = 2) -> DataFrame:
    z = [(operand(c) - float(m)) / float(s) for c, m, s in zip(columns, model["means"], model["scales"])]
    return df.select("*", *[sum((float(model["vectors"][j, a]) * z[j] for j in range(len(z))), F.lit(0.0)).alias(f"axis{a + 1}") for a in range(axes)])


def factor_analysis(df: DataFrame, columns: list[str], factors: int, rotation: str = "varimax", iterations: int = 500) -> dict:
    """Iterated principal axes from the correlation matrix."""
    _, s, _ = cross(df, columns)
    d = np.sqrt(np.diag(s))
    r = s / np.outer(d, d)
    h = 1 - 1 / np.diag(np.linalg.inv(r))
    for _ in range(iterations):
        m = r.copy()
        np.fill_diagonal(m, h)
        val, vec = np.linalg.eigh(m)
        load = vec[:, ::-1][:, :factors] * np.sqrt(np.maximum(val[::-1][:factors], 0))
        new = (load**2).sum(1)
        if np.max(np.abs(new - h)) < 1e-9:
            break
        h = np.minimum(new, 1.0)
    if rotation == "varimax" and factors > 1:
        norm = np.sqrt((load**2).sum(1, keepdims=True))
        x, t = load / norm, np.eye(factors)
        for _ in range(1000):
            y = x @ t
            u, sv, vt = np.linalg.svd(x.T @ (y**3 - y * (y**2).mean(0)))
            new_t = u @ vt
            if np.max(np.abs(new_t - t)) < 1e-10:
                break
            t = new_t
        load = load @ t
    return {"loadings": load, "communalities": h, "uniqueness": 1 - h}


def canonical(df: DataFrame, x: list[str], y: list[str]) -> dict:
    _, s, n = cross(df, [*x, *y])
    d = np.sqrt(np.diag(s))
    r = s / np.outer(d, d)
    p = len(x)
    lx, ly = np.linalg.cholesky(r[:p, :p]), np.linalg.cholesky(r[p:, p:])
    u, rho, vt = np.linalg.svd(np.linalg.solve(lx, r[:p, p:]) @ np.linalg.inv(ly).T)
    k = len(rho)
    w = float(np.prod(1 - rho**2))
    stat = -(n - 1 - (p + len(y) + 1) / 2) * math.log(w)
    return {"correlations": rho, "x": np.linalg.solve(lx.T, u[:, :k]), "y": np.linalg.solve(ly.T, vt.T[:, :k]), "wilks": w, "statistic": stat, "df": p * len(y), "p_value": sp.chi2_sf(stat, p * len(y))}


def discriminant(df: DataFrame, columns: list[str], group: str, quadratic: bool = False, priors: str = "empirical") -> DataFrame:
    """Adds the predicted class; class moments come from one aggregation."""
    k = len(columns)
    v = [operand(c) for c in columns]
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(v)], *[F.covar_pop(v[i], v[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).orderBy(group).collect()
    n = sum(r["n"] for r in g)
    covs = []
    for r in g:
        c = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                c[i, j] = c[j, i] = r[f"c{i}_{j}"] * r["n"]
        covs.append(c)
    pooled = sum(covs) / (n - len(g))
    best = None
    for r, c in zip(g, covs):
        s = c / (r["n"] - 1) if quadratic else pooled
        inv = np.linalg.inv(s)
        z = [x - r[f"m{i}"] for i, x in enumerate(v)]
        d2 = sum((float(inv[i, j]) * z[i] * z[j] for i in range(k) for j in range(k)), F.lit(0.0))
        prior = r["n"] / n if priors == "empirical" else 1 / len(g)
        score = -0.5 * d2 + (math.log(prior) - (0.5 * np.linalg.slogdet(s)[1] if quadratic else 0.0))
        entry = F.struct(score.alias("s"), F.lit(r[group]).alias("g"))
        best = entry if best is None else F.greatest(best, entry)
    return df.withColumn("predicted", best["g"])


def correspondence(table: np.ndarray) -> dict:
    p = np.asarray(table, float) / np.sum(table)
    a, b = p.sum(1), p.sum(0)
    u, s, vt = np.linalg.svd((p - np.outer(a, b)) / np.sqrt(np.outer(a, b)), full_matrices=False)
    return {"inertia": s**2, "rows": u * s / np.sqrt(a)[:, None], "columns": vt.T * s / np.sqrt(b)[:, None], "chi_square": float((s**2).sum() * np.sum(table))}


def mds(distances: np.ndarray, axes: int = 2) -> dict:
    d2 = np.asarray(distances, float) ** 2
    j = np.eye(len(d2)) - 1 / len(d2)
    val, vec = np.linalg.eigh(-0.5 * j @ d2 @ j)
    val, vec = val[::-1], vec[:, ::-1]
    return {"coordinates": vec[:, :axes] * np.sqrt(np.maximum(val[:axes], 0)), "eigenvalues": val}


def redundancy(df: DataFrame, responses: list[str], constraints: list[str]) -> dict:
    _, s, n = cross(df, [*responses, *constraints])
    p = len(responses)
    d = np.sqrt(np.diag(s))
    r = s / np.outer(d, d)
    fitted_ = r[:p, p:] @ np.linalg.solve(r[p:, p:], r[p:, :p])
    val = np.linalg.eigvalsh(fitted_)[::-1]
    return {"eigenvalues": val, "constrained_share": float(np.trace(fitted_) / p)}


# -- paths ---------------------------------------------------------------------------------------------------------


def path_model(df: DataFrame, equations: str) -> list[dict]:
    """``y ~ a + b; z ~ y + a``: each equation by least squares."""
    out = []
    for eq in [e for e in equations.replace("\n", ";").split(";") if e.strip()]:
        y, x = (t.strip() for t in eq.split("~"))
        m = fit(df, y, [t.strip() for t in x.split("+")])
        out += [{"response": y, **r} for r in m.rows()]
    return out


def mediation(df: DataFrame, y: str, x: str, m: str, covariates: list[str] = ()) -> dict:
    """a, b, direct and indirect effects with the delta-method standard error."""
    fa, fb = fit(df, m, [x, *covariates]), fit(df, y, [x, m, *covariates])
    a, b, c = fa.beta[1], fb.beta[2], fb.beta[1]
    se = math.sqrt(b * b * fa.covariance[1, 1] + a * a * fb.covariance[2, 2])
    return {"a": a, "b": b, "direct": c, "indirect": a * b, "total": c + a * b, "standard_error": se, "z": a * b / se, "p_value": 2 * sp.normal_sf(abs(a * b / se))}


def moderation(df: DataFrame, y: str, x: str, w: str, covariates: list[str] = (), z: str | None = None) -> dict:
    """Centred interaction; simple slopes at the mean and one deviation around it; with ``z`` three-way."""
    mo = moments(df, [x, w, *([z] if z else [])])
    xc, wc = operand(x) - mo[x]["mean"], operand(w) - mo[w]["mean"]
    cols = [xc, wc, xc * wc]
    if z:
        zc = operand(z) - mo[z]["mean"]
        cols += [zc, xc * zc, wc * zc, xc * wc * zc]
    f = fit(df, y, [*cols, *covariates])
    sd = math.sqrt(mo[w]["var"])
    slopes = []
    for k in (-1, 0, 1):
        at = k * sd
        var = f.covariance[1, 1] + at * at * f.covariance[3, 3] + 2 * at * f.covariance[1, 3]
        slopes.append({"w": k, "slope": f.beta[1] + at * f.beta[3], "standard_error": math.sqrt(var)})
    return {"interaction": f.beta[-1 - len(covariates)] if z else f.beta[3], "slopes": slopes, "r_squared": 1 - f.rss / f.tss, "coefficients": f.beta}


def moderated_mediation(df: DataFrame, y: str, x: str, m: str, w: str) -> dict:
    """First-stage moderation: indirect effects at the mean of W and one deviation around it."""
    mo = moments(df, [x, w])
    xc, wc = operand(x) - mo[x]["mean"], operand(w) - mo[w]["mean"]
    fa, fb = fit(df, m, [xc, wc, xc * wc]), fit(df, y, [xc, m, wc])
    sd = math.sqrt(mo[w]["var"])
    return {"index": fa.beta[3] * fb.beta[2], **{f"indirect_{n}": (fa.beta[1] + k * sd * fa.beta[3]) * fb.beta[2] for n, k in (("low", -1), ("mean", 0), ("high", 1))}}


# -- surveys -------------------------------------------------------------------------------------------------------


def survey_mean(df: DataFrame, y: str, weight: str, strata: str | None = None, cluster: str | None = None) -> dict:
    """The weighted mean with its linearised variance over primary sampling units."""
    w, v = operand(weight), operand(y)
    t = df.agg(F.sum(w).alias("w"), F.sum(w * v).alias("s"), F.count(F.lit(1)).alias("n")).first()
    mean = t["s"] / t["w"]
    keys = [F.col(strata).alias("h") if strata else F.lit(0).alias("h")]
    score = w * (v - mean) / t["w"]
    psu = df.groupBy(*keys, F.col(cluster).alias("c")).agg(F.sum(score).alias("z")) if cluster else df.select(*keys, score.alias("z"))
    g = psu.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.sum("z").alias("z"), F.sum(F.col("z") ** 2).alias("q"))
    if g.where("k < 2").limit(1).count():
        raise ValueError("a stratum has a single sampling unit")
    r = g.agg(F.sum(F.col("k") / (F.col("k") - 1) * (F.col("q") - F.col("z") ** 2 / F.col("k"))).alias("v"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("h")).first()
    return {"mean": mean, "standard_error": math.sqrt(r["v"]), "df": r["k"] - r["h"], "n": t["n"]}


def survey_proportion(df: DataFrame, indicator: str, weight: str, strata: str | None = None, cluster: str | None = None) -> dict:
    return survey_mean(df.withColumn("__i", F.col(indicator).cast("double")), "__i", weight, strata, cluster)


def survey_regression(df: DataFrame, y: str, x: list[str], weight: str, strata: str | None = None, cluster: str | None = None) -> dict:
    m = fit(df, y, x, weight)
    e = operand(weight) * (operand(y) - m.linear())
    design = [F.lit(1.0), *[operand(c) for c in x]]
    k = len(design)
    keys = [F.col(strata).alias("h") if strata else F.lit(0).alias("h")]
    cols = [(d * e).alias(f"s{i}") for i, d in enumerate(design)]
    psu = df.groupBy(*keys, F.col(cluster).alias("c")).agg(*[F.sum(d * e).alias(f"s{i}") for i, d in enumerate(design)]) if cluster else df.select(*keys, *cols)
    g = psu.groupBy("h").agg(F.count(F.lit(1)).alias("k"), *[F.sum(f"s{i}").alias(f"t{i}") for i in range(k)], *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"q{i}_{j}") for i in range(k) for j in range(i, k)])
    f = F.col("k") / (F.col("k") - 1)
    r = g.agg(*[F.sum(f * (F.col(f"q{i}_{j}") - F.col(f"t{i}") * F.col(f"t{j}") / F.col("k"))).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    meat = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            meat[i, j] = meat[j, i] = r[f"m{i}_{j}"]
    cov = m.extra["inv"] @ meat @ m.extra["inv"]
    return {"terms": m.names, "parameters": m.beta, "se": np.sqrt(np.diag(cov))}


# -- space ---------------------------------------------------------------------------------------------------------


def neighbour_pairs(df: DataFrame, key: str, x: str, y: str, distance: float) -> DataFrame:
    """(a, b, d) of points within the distance, by grid cells: each point meets the points of its nine cells only."""
    cell = lambda c: F.floor(F.col(c) / distance)
    a = df.select(F.col(key).alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay"), cell(x).alias("i"), cell(y).alias("j"))
    b = df.select(F.col(key).alias("b"), F.col(x).alias("bx"), F.col(y).alias("by"), cell(x).alias("ci"), cell(y).alias("cj"))
    near = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (-1, 0, 1) for q in (-1, 0, 1)])
    b = b.select("b", "bx", "by", "ci", "cj", F.explode(near).alias("o")).select("b", "bx", "by", (F.col("ci") + F.col("o.p")).alias("i"), (F.col("cj") + F.col("o.q")).alias("j"))
    d = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)
    return a.join(b, ["i", "j"]).where(F.col("a") != F.col("b")).select("a", "b", d.alias("d")).where(F.col("d") <= distance)


def row_standardised(pairs: DataFrame) -> DataFrame:
    n = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    return pairs.join(n, "a").select("a", "b", (1 / F.col("k")).alias("w"))


def morans_i(df: DataFrame, key: str, value: str, weights: DataFrame) -> dict:
    """Global Moran's I with its moments under normality; ``weights``: (a, b, w)."""
    m = moments(df, [value])[value]
    z = df.select(F.col(key).alias("a"), (operand(value) - m["mean"]).alias("za"))
    j = weights.join(z, "a").join(z.select(F.col("a").alias("b"), F.col("za").alias("zb")), "b")
    r = j.agg(F.sum("w").alias("s0"), F.sum(F.col("w") * F.col("za") * F.col("zb")).alias("n"), F.sum(F.col("w") * (F.col("za") - F.col("zb")) ** 2).alias("c")).first()
    both = weights.select("a", "b", "w").unionAll(weights.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    s1 = both.groupBy("a", "b").agg(F.sum("w").alias("w")).agg(F.sum(F.col("w") ** 2)).first()[0] / 2
    s2 = both.groupBy("a").agg(F.sum("w").alias("w")).agg(F.sum(F.col("w") ** 2)).first()[0]
    n, s0, ss = m["n"], r["s0"], m["var_pop"] * m["n"]
    i, e = n / s0 * r["n"] / ss, -1 / (n - 1)
    v = (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - e * e
    z_ = (i - e) / math.sqrt(v)
    return {"i": i, "expected": e, "variance": v, "z": z_, "p_value": 2 * sp.normal_sf(abs(z_)), "geary_c": (n - 1) / (2 * s0) * r["c"] / ss}


def local_moran(df: DataFrame, key: str, value: str, weights: DataFrame) -> DataFrame:
    m = moments(df, [value])[value]
    z = df.select(F.col(key).alias("a"), (operand(value) - m["mean"]).alias("za"))
    lag = weights.join(z.select(F.col("a").alias("b"), F.col("za").alias("zb")), "b").groupBy("a").agg(F.sum(F.col("w") * F.col("zb")).alias("lag"))
    q = F.when((F.col("za") >= 0) & (F.col("lag") >= 0), "HH").when((F.col("za") < 0) & (F.col("lag") < 0), "LL").when(F.col("za") >= 0, "HL").otherwise("LH")
    return z.join(lag, "a").select(F.col("a").alias(key), (F.col("za") * F.col("lag") / m["var_pop"]).alias("local_i"), q.alias("quadrant"))


def getis_ord(df: DataFrame, key: str, value: str, weights: DataFrame) -> DataFrame:
    m = moments(df, [value])[value]
    n, s = m["n"], math.sqrt(m["var_pop"])
    z = df.select(F.col(key).alias("b"), operand(value).alias("x"))
    g = weights.join(z, "b").groupBy("a").agg(F.sum(F.col("w") * F.col("x")).alias("wx"), F.sum("w").alias("w"), F.sum(F.col("w") ** 2).alias("w2"))
    return g.select(F.col("a").alias(key), ((F.col("wx") - m["mean"] * F.col("w")) / (s * F.sqrt((n * F.col("w2") - F.col("w") ** 2) / (n - 1)))).alias("g"))


def spatial_lag(df: DataFrame, key: str, columns: list[str], weights: DataFrame) -> DataFrame:
    """Adds the weighted sums of the neighbours (``lag_<column>``)."""
    z = df.select(F.col(key).alias("b"), *[operand(c).alias(c) for c in columns])
    lag = weights.join(z, "b").groupBy(F.col("a").alias(key)).agg(*[F.sum(F.col("w") * F.col(c)).alias(f"lag_{c}") for c in columns])
    return df.join(lag, key, "left").fillna(0.0, [f"lag_{c}" for c in columns])


def spatial_2sls(df: DataFrame, key: str, y: str, x: list[str], weights: DataFrame) -> dict:
    """The spatial lag model, the lagged response instrumented by lagged predictors."""
    from tidewell.stats.linear import iv

    d = spatial_lag(df, key, [y, *x], weights)
    return iv(d, y, [f"lag_{y}"], x, [*x, *[f"lag_{c}" for c in x]])


def slx(df: DataFrame, key: str, y: str, x: list[str], weights: DataFrame):  # noqa: ANN201
    return fit(spatial_lag(df, key, x, weights), y, [*x, *[f"lag_{c}" for c in x]])


def lm_tests(df: DataFrame, key: str, y: str, x: list[str], weights: DataFrame) -> dict:
    """Lagrange multiplier tests of a spatial error and a spatial lag."""
    m = fit(df, y, x)
    n, s2 = m.n, m.rss / m.n
    d = df.select(F.col(key), operand(y).alias("__y"), (operand(y) - m.linear()).alias("__e"), m.linear().alias("__f"), *[operand(c).alias(c) for c in x])
    lagged = spatial_lag(d, key, ["__y", "__e", "__f"], weights)
    r = lagged.agg(F.sum(F.col("__e") * F.col("lag___e")).alias("ee"), F.sum(F.col("__e") * F.col("lag___y")).alias("ey")).first()
    both = weights.select("a", "b", "w").unionAll(weights.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    t = both.groupBy("a", "b").agg(F.sum("w").alias("w")).agg(F.sum(F.col("w") ** 2)).first()[0] / 2
    proj = fit(lagged, "lag___f", x)
    err = (r["ee"] / s2) ** 2 / t
    lag = (r["ey"] / s2) ** 2 / (proj.rss / s2 + t)
    return {"lm_error": err, "lm_error_p": sp.chi2_sf(err, 1), "lm_lag": lag, "lm_lag_p": sp.chi2_sf(lag, 1)}
