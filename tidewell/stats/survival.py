"""Survival analysis.  Times are counted first, so that windows and products run over distinct times."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.guards import operand
from tidewell.stats import special as sp
from tidewell.stats.core import maximise, moments
from tidewell.stats.models import _log_cdf


def life_table(df: DataFrame, time: str, event: str, groups: list[str] = ()) -> DataFrame:
    """(groups, time, events, censored, at_risk): events come before censoring at the same time."""
    c = df.groupBy(*groups, operand(time).alias("time")).agg(F.sum(F.col(event).cast("bigint")).alias("events"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*groups).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    return c.select(*groups, "time", "events", (F.col("n") - F.col("events")).alias("censored"), F.sum("n").over(w).alias("at_risk"))


def kaplan_meier(df: DataFrame, time: str, event: str, groups: list[str] = ()) -> DataFrame:
    """Adds survival and its Greenwood standard error at each event time."""
    t = life_table(df, time, event, groups).where("events > 0")
    w = Window.partitionBy(*groups).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    d, n = F.col("events"), F.col("at_risk")
    s = F.when(F.max((d == n).cast("int")).over(w) == 1, 0.0).otherwise(F.exp(F.sum(F.when(d < n, F.log(1 - d / n))).over(w)))
    g = F.sqrt(F.sum(F.when(d < n, d / (n * (n - d)))).over(w))
    return t.select(*groups, "time", "events", "at_risk", s.alias("survival"), (s * g).alias("standard_error"))


def nelson_aalen(df: DataFrame, time: str, event: str, groups: list[str] = ()) -> DataFrame:
    t = life_table(df, time, event, groups).where("events > 0")
    w = Window.partitionBy(*groups).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    d, n = F.col("events"), F.col("at_risk")
    return t.select(*groups, "time", "events", "at_risk", F.sum(d / n).over(w).alias("cumulative_hazard"), F.sqrt(F.sum(d / (n * n)).over(w)).alias("standard_error"))


def logrank(df: DataFrame, time: str, event: str, group: str) -> dict:
    """Observed minus expected over the distinct event times."""
    levels = sorted(r[0] for r in df.select(group).distinct().collect())
    k = len(levels)
    c = df.groupBy(operand(time).alias("t")).agg(*[F.count_if(F.col(group) == lv).alias(f"n{i}") for i, lv in enumerate(levels)], *[F.sum(F.when(F.col(group) == lv, F.col(event).cast("bigint")).otherwise(0)).alias(f"d{i}") for i, lv in enumerate(levels)])
    w = Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)  # over distinct times
    r = c.select("t", *[F.sum(f"n{i}").over(w).alias(f"r{i}") for i in range(k)], *[F.col(f"d{i}") for i in range(k)])
    n, d = sum((F.col(f"r{i}") for i in range(1, k)), F.col("r0")), sum((F.col(f"d{i}") for i in range(1, k)), F.col("d0"))
    r = r.select("*", n.alias("n"), d.alias("d")).where("d > 0")
    f = F.when(F.col("n") > 1, F.col("d") * (F.col("n") - F.col("d")) / (F.col("n") - 1)).otherwise(0.0)
    s = r.agg(*[F.sum(F.col(f"d{i}") - F.col("d") * F.col(f"r{i}") / F.col("n")).alias(f"u{i}") for i in range(k)], *[F.sum(f * (F.col(f"r{i}") / F.col("n")) * (F.lit(float(i == j)) - F.col(f"r{j}") / F.col("n"))).alias(f"v{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    u = np.array([s[f"u{i}"] for i in range(k)])
    v = np.array([[s[f"v{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    stat = float(u[:-1] @ np.linalg.solve(v[:-1, :-1], u[:-1]))
    return {"statistic": stat, "df": k - 1, "p_value": sp.chi2_sf(stat, k - 1)}


def competing_risks(df: DataFrame, time: str, status: str) -> DataFrame:
    """Cumulative incidence of each cause (status above 0) by Aalen and Johansen."""
    causes = sorted(r[0] for r in df.where(F.col(status) > 0).select(status).distinct().collect())
    c = df.groupBy(operand(time).alias("time")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(status) == k).alias(f"d{i}") for i, k in enumerate(causes)])
    w = Window.orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    d = sum((F.col(f"d{i}") for i in range(1, len(causes))), F.col("d0"))
    t = c.select("*", F.sum("n").over(w).alias("r"), d.alias("d"))
    up = Window.orderBy("time").rowsBetween(Window.unboundedPreceding, -1)
    before = F.when(F.max((F.col("d") == F.col("r")).cast("int")).over(up) == 1, 0.0).otherwise(F.exp(F.coalesce(F.sum(F.when(F.col("d") < F.col("r"), F.log(1 - F.col("d") / F.col("r")))).over(up), F.lit(0.0))))
    t = t.withColumn("s", before)
    run = Window.orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    return t.select("time", *[F.sum(F.col("s") * F.col(f"d{i}") / F.col("r")).over(run).alias(f"incidence_{k}") for i, k in enumerate(causes)])


def cox(df: DataFrame, time: str, event: str, x: list[str], ties: str = "efron", start: str | None = None, iterations: int = 50, tolerance: float = 1e-9) -> dict:
    """Partial likelihood by Newton steps.

    A step sums exp(xb) and its moments by distinct time, takes running sums over the times (entries are subtracted
    for intervals with a ``start``), and adds up score and information over event times.
    """
    k = len(x)
    m = moments(df, x)
    mean, scale = np.array([m[c]["mean"] for c in x]), np.array([math.sqrt(m[c]["var"]) or 1.0 for c in x])
    d = df.select(operand(time).alias("t"), F.col(event).cast("int").alias("e"), *([operand(start).alias("a")] if start else []), *[((operand(c) - float(mu)) / float(s)).alias(f"x{i}") for i, (c, mu, s) in enumerate(zip(x, mean, scale))]).cache()
    tri = [(i, j) for i in range(k) for j in range(i, k)]
    beta, before = np.zeros(k), -math.inf
    for step in range(iterations):
        eta = F.lit(0.0)
        for i in range(k):
            eta = eta + F.lit(float(beta[i])) * F.col(f"x{i}")
        r = F.exp(eta)
        terms = {"s": r, **{f"m{i}": r * F.col(f"x{i}") for i in range(k)}, **{f"q{i}_{j}": r * F.col(f"x{i}") * F.col(f"x{j}") for i, j in tri}}
        ev = F.col("e") == 1
        by = d.groupBy(F.col("t").alias("t")).agg(*[F.sum(v).alias("r_" + n) for n, v in terms.items()], *[F.coalesce(F.sum(F.when(ev, v)), F.lit(0.0)).alias("d_" + n) for n, v in terms.items()], F.sum(F.when(ev, 1).otherwise(0)).alias("nd"), F.coalesce(F.sum(F.when(ev, eta)), F.lit(0.0)).alias("le"), *[F.coalesce(F.sum(F.when(ev, F.col(f"x{i}"))), F.lit(0.0)).alias(f"z{i}") for i in range(k)])
        if start:
            late = d.groupBy(F.col("a").alias("t")).agg(*[(-F.sum(v)).alias("r_" + n) for n, v in terms.items()])
            zero = [F.lit(0.0).alias("d_" + n) for n in terms]
            by = by.unionByName(late.select("t", *["r_" + n for n in terms], *zero, F.lit(0).alias("nd"), F.lit(0.0).alias("le"), *[F.lit(0.0).alias(f"z{i}") for i in range(k)]))
            by = by.groupBy("t").agg(*[F.sum(c).alias(c) for c in by.columns if c != "t"])
            # an interval that starts at t is not at risk at t: entries count from the times before
            w0 = Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
        else:
            w0 = Window.orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
        at = by.select("t", "nd", "le", *[f"z{i}" for i in range(k)], *["d_" + n for n in terms], *[F.sum("r_" + n).over(w0).alias("r_" + n) for n in terms]).where("nd > 0")
        if ties == "efron":
            at = at.withColumn("l", F.explode(F.sequence(F.lit(0), F.col("nd") - 1)))
            f = F.col("l") / F.col("nd")
            share = 1 / F.col("nd")
        else:
            f, share = F.lit(0.0), F.lit(1.0)
        v = {n: F.col("r_" + n) - f * F.col("d_" + n) for n in terms}
        per = F.lit(1.0) if ties == "efron" else F.col("nd").cast("double")
        g = at.agg(F.sum(F.col("le") * share - per * F.log(v["s"])).alias("ll"), *[F.sum(F.col(f"z{i}") * share - per * v[f"m{i}"] / v["s"]).alias(f"u{i}") for i in range(k)], *[F.sum(per * (v[f"q{i}_{j}"] / v["s"] - v[f"m{i}"] * v[f"m{j}"] / (v["s"] * v["s"]))).alias(f"i{i}_{j}") for i, j in tri]).first()
        u = np.array([g[f"u{i}"] for i in range(k)])
        info = np.zeros((k, k))
        for i, j in tri:
            info[i, j] = info[j, i] = g[f"i{i}_{j}"]
        move = np.linalg.solve(info, u)
        if step and g["ll"] < before - 1e-9 * abs(before):
            beta = beta - last / 2  # noqa: F821
            last = last / 2  # noqa: F821
            continue
        before, last = g["ll"], move
        if np.max(np.abs(move)) < tolerance:
            break
        beta = beta + move
    d.unpersist()
    cov = np.linalg.inv(info) / np.outer(scale, scale)
    b = beta / scale
    se = np.sqrt(np.diag(cov))
    return {"terms": x, "coefficients": b, "hazard_ratios": np.exp(b), "se": se, "p_value": np.array([2 * sp.normal_sf(abs(v)) for v in b / se]), "loglik": before, "covariance": cov, "iterations": step + 1}


def parametric(df: DataFrame, time: str, event: str, x: list[str] = (), distribution: str = "weibull") -> dict:
    """Accelerated failure times: exponential, weibull, lognormal or loglogistic; coefficients on log time."""
    names = [f"x{i}" for i in range(len(x))]
    m = moments(df, list(x)) if x else {}
    d = df.select(operand(time).alias("t"), F.col(event).cast("double").alias("e"), *[((operand(c) - m[c]["mean"]) / (math.sqrt(m[c]["var"]) or 1.0)).alias(n) for n, c in zip(names, x)])
    k = len(x) + 1

    def ll(b: np.ndarray, a: dict) -> np.ndarray:
        eta = b[0] + sum((v * a[n] for v, n in zip(b[1:k], names)), 0.0)
        s = 1.0 if distribution == "exponential" else math.exp(b[k])
        z = (np.log(a["t"]) - eta) / s
        if distribution in ("exponential", "weibull"):
            dens, surv = z - np.exp(np.minimum(z, 50)), -np.exp(np.minimum(z, 50))
        elif distribution == "lognormal":
            dens, surv = -0.5 * z * z - 0.5 * math.log(2 * math.pi), _log_cdf(-z)
        else:
            dens, surv = z - 2 * np.logaddexp(0, z), -np.logaddexp(0, z)
        return a["e"] * (dens - math.log(s) - np.log(a["t"])) + (1 - a["e"]) * surv

    start = np.zeros(k + int(distribution != "exponential"))
    start[0] = df.agg(F.avg(F.log(operand(time)))).first()[0]
    r = maximise(d, ["t", "e", *names], ll, start)
    sc = np.array([math.sqrt(m[c]["var"]) or 1.0 for c in x])
    b = r["parameters"].copy()
    b[1:k] = b[1:k] / sc
    b[0] -= sum(v * m[c]["mean"] for v, c in zip(b[1:k], x))
    return {"terms": ["Intercept", *x, *(["log_scale"] if distribution != "exponential" else [])], "parameters": b, "loglik": r["loglik"], "se": r["se"], "aic": 2 * len(b) - 2 * r["loglik"]}


def calibration(df: DataFrame, time: str, event: str, risk: str, horizon: float, bins: int = 10) -> DataFrame:
    """Mean predicted risk and 1 - Kaplan-Meier at the horizon, by bins of the prediction."""
    cuts = df.agg(F.percentile(operand(risk), [i / bins for i in range(1, bins)])).first()[0]
    slot = F.lit(0)
    for c in sorted(set(cuts)):
        slot = slot + (operand(risk) > c).cast("int")
    d = df.withColumn("bin", slot)
    km = kaplan_meier(d, time, event, ["bin"]).where(F.col("time") <= horizon).groupBy("bin").agg(F.min("survival").alias("s"))
    return d.groupBy("bin").agg(F.avg(operand(risk)).alias("predicted"), F.count(F.lit(1)).alias("n")).join(km, "bin", "left").select("bin", "n", "predicted", (1 - F.coalesce("s", F.lit(1.0))).alias("observed"))


def decision_curve(df: DataFrame, time: str, event: str, risk: str, horizon: float, thresholds: list[float]) -> DataFrame:
    """Net benefit at each threshold; one Kaplan-Meier per threshold over counted times."""
    t = df.select(operand(time).alias("time"), F.col(event).alias("event"), operand(risk).alias("risk"), F.explode(F.array(*[F.lit(float(p)) for p in thresholds])).alias("threshold"))
    n = df.count()
    chosen = t.where(F.col("risk") >= F.col("threshold"))
    km = kaplan_meier(chosen, "time", "event", ["threshold"]).where(F.col("time") <= horizon).groupBy("threshold").agg(F.min("survival").alias("s"))
    counted = chosen.groupBy("threshold").agg(F.count(F.lit(1)).alias("k")).join(km, "threshold", "left")
    inc, share = 1 - F.coalesce("s", F.lit(1.0)), F.col("k") / n
    return counted.select("threshold", (inc * share - (1 - inc) * share * F.col("threshold") / (1 - F.col("threshold"))).alias("net_benefit"))


def nomogram(model: dict, ranges: dict[str, tuple[float, float]], ticks: int = 5) -> list[dict]:
    """Points of each predictor over its range, 100 for the widest contribution."""
    spans = {c: abs(b) * (ranges[c][1] - ranges[c][0]) for c, b in zip(model["terms"], model["coefficients"])}
    widest = max(spans.values())
    out = []
    for c, b in zip(model["terms"], model["coefficients"]):
        lo, hi = ranges[c]
        low = min(b * lo, b * hi)
        out += [{"term": c, "value": lo + (hi - lo) * i / (ticks - 1), "points": 100 * (b * (lo + (hi - lo) * i / (ticks - 1)) - low) / widest} for i in range(ticks)]
    return out
