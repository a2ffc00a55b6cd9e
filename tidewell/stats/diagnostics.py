"""Diagnostics and post-estimation beyond those of the linear module."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.guards import operand
from tidewell.stats import special as sp
from tidewell.stats.core import cross, fitted
from tidewell.stats.linear import LinearFit, fit, residuals, white
from tidewell.stats.models import generic, normal_cdf_column, probability


def normality(df: DataFrame, x: str) -> dict:
    """Jarque-Bera and the omnibus test of D'Agostino and Pearson, from four moments."""
    r = df.select(operand(x).alias("e")).agg(F.count("e").alias("n"), F.skewness("e").alias("s"), F.kurtosis("e").alias("k")).first()
    n, s, k = r["n"], r["s"], r["k"] + 3
    if n < 8:
        raise ValueError("normality needs at least eight observations")
    jb = n / 6 * (s * s + (k - 3) ** 2 / 4)
    y = s * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (b2 - 1)) - 1
    z1 = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(0.5 * math.log(w2))
    mean, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    v = (k - mean) / math.sqrt(var)
    g = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / g * (2 / g + math.sqrt(1 + 4 / g**2))
    den = 1 + v * math.sqrt(2 / (a - 4))
    z2 = (1 - 2 / (9 * a) - math.copysign((abs((1 - 2 / a) / den)) ** (1 / 3), den)) / math.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return {"jarque_bera": jb, "jarque_bera_p": sp.chi2_sf(jb, 2), "omnibus": k2, "omnibus_p": sp.chi2_sf(k2, 2), "skewness": s, "kurtosis": k, "n": n}


def harman(df: DataFrame, variables: list[str]) -> dict:
    """The share of the first unrotated component of the correlation matrix."""
    _, s, n = cross(df, variables)
    d = np.sqrt(np.diag(s))
    val, vec = np.linalg.eigh(s / np.outer(d, d))
    val, vec = val[::-1], vec[:, ::-1]
    return {"first_component_ratio": float(val[0] / val.sum()), "eigenvalues": val, "loadings": math.sqrt(val[0]) * vec[:, 0], "eigenvalues_above_one": int((val > 1).sum()), "n": n}


def reclassification(df: DataFrame, outcome: str, reference: str, new: str, thresholds: list[float] = ()) -> dict:
    """NRI (continuous, or by risk categories; a cut point belongs to the higher one) and IDI, in one pass."""
    y, a, b = F.col(outcome).cast("int"), operand(reference), operand(new)

    def category(p):  # noqa: ANN001, ANN202
        out = F.lit(0)
        for t in thresholds:
            out = out + (p >= t).cast("int")
        return out

    u, v = (category(a), category(b)) if thresholds else (a, b)
    r = df.groupBy(y.alias("y")).agg(F.count(F.lit(1)).alias("n"), F.count_if(v > u).alias("up"), F.count_if(v < u).alias("down"), F.avg(a).alias("a"), F.avg(b).alias("b")).collect()
    g = {x["y"]: x for x in r}
    e, c = g[1], g[0]
    events, others = (e["up"] - e["down"]) / e["n"], (c["down"] - c["up"]) / c["n"]
    return {"nri_events": events, "nri_nonevents": others, "nri": events + others, "idi": (e["b"] - c["b"]) - (e["a"] - c["a"])}


def information_matrix(df: DataFrame, model: LinearFit) -> dict:
    """Heteroskedasticity, skewness and kurtosis components and their sum."""
    h = white(df, model)
    e = residuals(df, model)
    s2 = model.rss / model.n
    d = df.select(*[operand(c).alias(f"x{i}") for i, c in enumerate(model.x)], (e**3 - 3 * s2 * e).alias("c"), (e**4 - 6 * s2 * e**2 + 3 * s2**2).alias("k"))
    m = fit(d, "c", [f"x{i}" for i in range(len(model.x))])
    r = d.agg(F.sum(F.col("c") ** 2).alias("cc"), F.sum("k").alias("k")).first()
    skew = (r["cc"] - m.rss) / (6 * s2**3)
    kurt = r["k"] ** 2 / (24 * s2**4 * model.n)
    p = len(model.x) + 1
    total, df_ = h["statistic"] + skew + kurt, h["df"] + p + 1
    return {"heteroskedasticity": h["statistic"], "skewness": skew, "kurtosis": kurt, "statistic": total, "df": df_, "p_value": sp.chi2_sf(total, df_)}


def nested_comparison(small: LinearFit, large: LinearFit) -> dict:
    """F, likelihood ratio and score tests of two nested least-squares fits."""
    q = len(large.beta) - len(small.beta)
    f = ((small.rss - large.rss) / q) / (large.rss / large.df)
    lm = large.n * (1 - large.rss / small.rss)
    lr = large.n * math.log(small.rss / large.rss)
    return {"f": f, "f_p": sp.f_sf(f, q, large.df), "score": lm, "score_p": sp.chi2_sf(lm, q), "likelihood_ratio": lr, "likelihood_ratio_p": sp.chi2_sf(lr, q), "restrictions": q}


def treatment_heterogeneity(df: DataFrame, y: str, treatment: str, group: str, x: list[str] = ()) -> dict:
    """F test that the treatment effect is the same in all groups (a row per group comes to the driver)."""
    levels = sorted(r[0] for r in df.select(group).distinct().collect())
    d = operand(treatment)
    groups = [(F.col(group) == lv).cast("double") for lv in levels[1:]]
    small = fit(df, y, [*x, d, *groups])
    large = fit(df, y, [*x, d, *groups, *[d * g for g in groups]])
    r = nested_comparison(small, large)
    base = large.beta[1 + len(x)]
    return {"statistic": r["f"], "df1": r["restrictions"], "df2": large.df, "p_value": r["f_p"], "effects": {str(levels[0]): float(base), **{str(lv): float(base + v) for lv, v in zip(levels[1:], large.beta[-len(groups) :])}}}


def adjusted_prediction(df: DataFrame, x: list[str], model: dict | LinearFit, link: str = "identity", at: dict[str, float] | None = None, evaluation: str = "average", confidence: float = 0.95) -> dict:
    """The mean prediction with some predictors set, and its delta-method interval; one pass for value and gradient."""
    beta, cov = (model.beta, model.covariance) if isinstance(model, LinearFit) else (model["parameters"][: len(x) + 1], model["covariance"][: len(x) + 1, : len(x) + 1])
    at = at or {}
    if set(at) - set(x):
        raise ValueError(f"unknown predictors {set(at) - set(x)}")
    means = df.agg(*[F.avg(operand(c)).alias(c) for c in x]).first() if evaluation == "at_means" else None
    cols = [F.lit(float(at[c])) if c in at else F.lit(float(means[c])) if means else operand(c) for c in x]
    eta = fitted(cols, beta)
    if link == "identity":
        value, slope = eta, F.lit(1.0)
    elif link == "logit":
        value = 1 / (1 + F.exp(-eta))
        slope = value * (1 - value)
    else:
        value, slope = normal_cdf_column(eta), F.exp(-eta * eta / 2) / math.sqrt(2 * math.pi)
    r = df.agg(F.avg(value).alias("v"), *[F.avg(slope * c).alias(f"g{i}") for i, c in enumerate([F.lit(1.0), *cols])]).first()
    g = np.array([r[f"g{i}"] for i in range(len(x) + 1)])
    se = math.sqrt(max(g @ cov @ g, 0.0))
    half = sp.normal_quantile(0.5 + confidence / 2) * se
    return {"prediction": r["v"], "standard_error": se, "lower": r["v"] - half, "upper": r["v"] + half}


def odds_ratios(model: dict, confidence: float = 0.95) -> list[dict]:
    z = sp.normal_quantile(0.5 + confidence / 2)
    return [{"term": t, "odds_ratio": math.exp(b), "standard_error": math.exp(b) * s, "lower": math.exp(b - z * s), "upper": math.exp(b + z * s)} for t, b, s in zip(model["terms"], model["parameters"], model["se"])]


def subgroup_cox(df: DataFrame, time: str, event: str, treatment: str, group: str, ties: str = "efron") -> dict:
    """A Cox fit of the treatment in each group and a Wald test that all effects are equal."""
    from tidewell.stats.survival import cox

    levels = sorted(r[0] for r in df.select(group).distinct().collect())
    fits = [cox(df.where(F.col(group) == lv), time, event, [treatment], ties) for lv in levels]
    b, v = np.array([f["coefficients"][0] for f in fits]), np.array([f["se"][0] ** 2 for f in fits])
    c = np.column_stack([-np.ones(len(b) - 1), np.eye(len(b) - 1)])
    w = float((c @ b) @ np.linalg.solve(c @ np.diag(v) @ c.T, c @ b))
    return {"hazard_ratios": dict(zip(map(str, levels), np.exp(b))), "statistic": w, "df": len(b) - 1, "p_value": sp.chi2_sf(w, len(b) - 1)}


def survey_glm(df: DataFrame, y: str, x: list[str], weight: str, family: str = "binomial", cluster: str | None = None) -> dict:
    """Weighted logit or Poisson with the linearised sandwich over sampling units."""
    if family == "binomial":
        m = generic(df, y, x, lambda e, _, a: a["w"] * (a["y"] * e - np.logaddexp(0, e)), more={"w": weight})
        mu = probability(x, m)
    else:
        m = generic(df, y, x, lambda e, _, a: a["w"] * (a["y"] * e - np.exp(np.minimum(e, 50))), more={"w": weight})
        mu = F.exp(fitted(x, m["parameters"][: len(x) + 1]))
    design = [F.lit(1.0), *[operand(c) for c in x]]
    e = operand(weight) * (operand(y) - mu)
    k = len(design)
    unit = [F.col(cluster).alias("c")] if cluster else [F.monotonically_increasing_id().alias("c")]
    s = df.select(*unit, *[(d * e).alias(f"s{i}") for i, d in enumerate(design)]).groupBy("c").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])
    r = s.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    meat = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            meat[i, j] = meat[j, i] = r[f"m{i}_{j}"]
    cov = m["covariance"] @ meat @ m["covariance"] * r["n"] / (r["n"] - 1)
    return {"terms": m["terms"], "parameters": m["parameters"], "se": np.sqrt(np.diag(cov))}
