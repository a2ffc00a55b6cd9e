"""Classical tests: a pass or two of counts, moments or rank sums, and a distribution function on the driver."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.guards import operand
from tidewell.stats import special as sp
from tidewell.stats.core import group_moments, moments, rank_counts


def _t(stat: float, df: float, alternative: str) -> float:
    return sp.p_value(stat, alternative, lambda z: sp.t_sf(z, df))


def _z(stat: float, alternative: str) -> float:
    return sp.p_value(stat, alternative, sp.normal_sf)


def t_from_summary(design: str, n1: float, m1: float, s1: float, n2: float = 0, m2: float = 0, s2: float = 0, null: float = 0.0, equal_variance: bool = False, alternative: str = "two_sided", confidence: float = 0.95) -> dict:
    """A t test from sizes, means and standard deviations (``one_sample``, ``paired`` or ``independent``)."""
    if design != "independent":
        se, df, est = s1 / math.sqrt(n1), n1 - 1, m1
    elif equal_variance:
        df = n1 + n2 - 2
        se = math.sqrt(((n1 - 1) * s1**2 + (n2 - 1) * s2**2) / df * (1 / n1 + 1 / n2))
        est = m1 - m2
    else:
        a, b = s1**2 / n1, s2**2 / n2
        se, est = math.sqrt(a + b), m1 - m2
        df = (a + b) ** 2 / (a**2 / (n1 - 1) + b**2 / (n2 - 1))
    if se == 0:
        raise ValueError("no variation")
    stat, half = (est - null) / se, sp.t_quantile(0.5 + confidence / 2, df) * se
    return {"statistic": stat, "df": float(df), "p_value": _t(stat, df, alternative), "estimate": est, "standard_error": se, "lower": est - half, "upper": est + half}


def t_one_sample(df: DataFrame, x: str, null_mean: float = 0.0, alternative: str = "two_sided") -> dict:
    m = moments(df, [x])[x]
    return t_from_summary("one_sample", m["n"], m["mean"], math.sqrt(m["var"]), null=null_mean, alternative=alternative)


def t_paired(df: DataFrame, before: str, after: str, alternative: str = "two_sided") -> dict:
    return t_one_sample(df.select((operand(before) - operand(after)).alias("d")), "d", 0.0, alternative)


def t_independent(df: DataFrame, x: str, group: str, first: object, second: object, equal_variance: bool = False, alternative: str = "two_sided") -> dict:
    """Direction is the first group minus the second."""
    g = group_moments(df.where(F.col(group).isin(first, second)), group, x).set_index(group)
    a, b = g.loc[first], g.loc[second]
    return t_from_summary("independent", a["n"], a["mean"], math.sqrt(a["var"]), b["n"], b["mean"], math.sqrt(b["var"]), equal_variance=equal_variance, alternative=alternative)


def z_mean(df: DataFrame, x: str, null_mean: float, population_sd: float, alternative: str = "two_sided") -> dict:
    m = moments(df, [x])[x]
    stat = (m["mean"] - null_mean) / (population_sd / math.sqrt(m["n"]))
    return {"statistic": stat, "p_value": _z(stat, alternative), "estimate": m["mean"]}


def _successes(df: DataFrame, x: str) -> tuple[int, int]:
    c = F.col(x).cast("int")
    r = df.agg(F.sum(F.when(c.isin(0, 1), c).otherwise(F.raise_error(F.lit("a trial is neither 0 nor 1")).cast("int"))).alias("k"), F.count(F.lit(1)).alias("n")).first()
    return r["k"], r["n"]


def z_proportion(df: DataFrame, x: str, null_probability: float, alternative: str = "two_sided") -> dict:
    k, n = _successes(df, x)
    stat = (k / n - null_probability) / math.sqrt(null_probability * (1 - null_probability) / n)
    return {"statistic": stat, "p_value": _z(stat, alternative), "estimate": k / n}


def binomial(df: DataFrame, x: str, null_probability: float, alternative: str = "two_sided") -> dict:
    """Exact; two-sided sums all counts that are no likelier than the observed one."""
    k, n = _successes(df, x)
    p0 = null_probability
    if alternative == "greater":
        p = 1.0 if k == 0 else sp.beta_inc(k, n - k + 1, p0)
    elif alternative == "less":
        p = 1.0 if k == n else 1 - sp.beta_inc(k + 1, n - k, p0)
    else:
        here = sp.binomial_pmf(k, n, p0) * (1 + 1e-7)
        low = k <= n * p0
        # the counts on the other side that are no likelier form a tail, found by bisection as the pmf falls there
        a, b = (math.ceil(n * p0), n + 1) if low else (-1, math.floor(n * p0))
        while b - a > 1:
            mid = (a + b) // 2
            if (sp.binomial_pmf(mid, n, p0) <= here) == low:
                b = mid
            else:
                a = mid
        if low:
            own = 1.0 if k == n else 1 - sp.beta_inc(k + 1, n - k, p0)
            start = a if a > n * p0 and sp.binomial_pmf(a, n, p0) <= here else b
            p = own + (0.0 if start > n else sp.beta_inc(start, n - start + 1, p0))
        else:
            own = 1.0 if k == 0 else sp.beta_inc(k, n - k + 1, p0)
            end = a
            p = own + (0.0 if end < 0 else 1 - sp.beta_inc(end + 1, n - end, p0))
    return {"successes": k, "trials": n, "estimate": k / n, "p_value": min(1.0, p)}


def proportions_two(k1: float, n1: float, k2: float, n2: float, null_difference: float = 0.0, alternative: str = "two_sided") -> dict:
    p1, p2 = k1 / n1, k2 / n2
    if null_difference == 0:
        p = (k1 + k2) / (n1 + n2)
        se = math.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))
    else:
        se = math.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)
    stat = (p1 - p2 - null_difference) / se
    return {"statistic": stat, "p_value": _z(stat, alternative), "estimate": p1 - p2}


def proportion_two(df: DataFrame, x: str, group: str, first: object, second: object, null_difference: float = 0.0, alternative: str = "two_sided") -> dict:
    got = {r["g"]: (r["k"], r["n"]) for r in df.groupBy(F.col(group).alias("g")).agg(F.sum(F.col(x).cast("int")).alias("k"), F.count(F.lit(1)).alias("n")).collect()}
    return proportions_two(*got[first], *got[second], null_difference, alternative)


def proportion_multiple(pairs: list[float]) -> dict:
    """[successes1, trials1, successes2, trials2, ...]; homogeneity of all proportions."""
    k, n = np.array(pairs[::2], float), np.array(pairs[1::2], float)
    p = k.sum() / n.sum()
    stat = float((((k - n * p) ** 2) / (n * p * (1 - p))).sum())
    return {"statistic": stat, "df": len(k) - 1, "p_value": sp.chi2_sf(stat, len(k) - 1)}


def poisson_rate(df: DataFrame, x: str, null_rate: float, alternative: str = "two_sided") -> dict:
    """Exact; two-sided sums all counts that are no likelier than the observed one."""
    r = df.agg(F.sum(operand(x)).alias("k"), F.count(F.lit(1)).alias("n")).first()
    k, mean = int(r["k"]), null_rate * r["n"]
    up, down = sp.poisson_sf(k, mean), 1 - sp.poisson_sf(k + 1, mean)
    log_pmf = lambda j: j * math.log(mean) - mean - math.lgamma(j + 1)
    here = log_pmf(k) + 1e-7
    if k <= mean:  # the first count above the mean that is no likelier, by bisection on the falling side
        a, b = math.floor(mean), math.ceil(mean) + 1
        while log_pmf(b) > here:
            b *= 2
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (a, mid) if log_pmf(mid) <= here else (mid, b)
        both = down + sp.poisson_sf(b, mean)
    else:
        a, b = -1, math.floor(mean)
        while b - a > 1:
            mid = (a + b) // 2
            a, b = (mid, b) if log_pmf(mid) <= here else (a, mid)
        both = up + (1 - sp.poisson_sf(a + 1, mean) if a >= 0 else 0.0)
    return {"events": k, "estimate": k / r["n"], "p_value": {"greater": up, "less": down}.get(alternative, min(1.0, both))}


def equivalence(df: DataFrame, x: str, lower: float, upper: float) -> dict:
    """Two one-sided tests of the mean against the bounds."""
    if not lower < upper:
        raise ValueError("the bounds are not in order")
    a, b = t_one_sample(df, x, lower, "greater"), t_one_sample(df, x, upper, "less")
    return {"t_lower": a["statistic"], "t_upper": b["statistic"], "df": a["df"], "p_value": max(a["p_value"], b["p_value"])}


def contingency(df: DataFrame, row: str, column: str) -> pd.DataFrame:
    cells = df.where(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count(F.lit(1)).alias("n")).toPandas()  # a row per cell
    return cells.pivot(index=row, columns=column, values="n").fillna(0).sort_index().sort_index(axis=1)


def chi2_table(counts: np.ndarray) -> dict:
    o = np.asarray(counts, float)
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    stat, df = float(((o - e) ** 2 / e).sum()), (o.shape[0] - 1) * (o.shape[1] - 1)
    return {"statistic": stat, "df": df, "p_value": sp.chi2_sf(stat, df), "n": float(o.sum()), "cramers_v": math.sqrt(stat / o.sum() / min(o.shape[0] - 1, o.shape[1] - 1))}


def chi2_independence(df: DataFrame, row: str, column: str) -> dict:
    return chi2_table(contingency(df, row, column).to_numpy())


def chi2_goodness(observed: list[float], expected: list[float]) -> dict:
    o, e = np.array(observed, float), np.array(expected, float)
    e = e * o.sum() / e.sum()
    stat = float(((o - e) ** 2 / e).sum())
    return {"statistic": stat, "df": len(o) - 1, "p_value": sp.chi2_sf(stat, len(o) - 1)}


def fisher_exact(table: np.ndarray) -> dict:
    (a, b), (c, d) = np.asarray(table, int)
    n, r, k = a + b + c + d, a + b, a + c
    lo, hi = max(0, r + k - n), min(r, k)
    here = sp.hypergeometric_pmf(a, n, k, r)
    p = sum(q for q in (sp.hypergeometric_pmf(i, n, k, r) for i in range(lo, hi + 1)) if q <= here * (1 + 1e-7))
    return {"odds_ratio": float(a * d / (b * c)) if b * c else math.inf, "p_value": min(1.0, p)}


def mcnemar(df: DataFrame, before: str, after: str) -> dict:
    r = df.agg(F.count_if((F.col(before).cast("int") == 0) & (F.col(after).cast("int") == 1)).alias("b"), F.count_if((F.col(before).cast("int") == 1) & (F.col(after).cast("int") == 0)).alias("c")).first()
    b, c = r["b"], r["c"]
    if b + c == 0:
        raise ValueError("no discordant pair")
    stat = (b - c) ** 2 / (b + c)
    least, n = min(b, c), b + c
    p = 1.0 if b == c else min(1.0, 2 * (1 - sp.beta_inc(least + 1, n - least, 0.5)))  # exact binomial of the discordant pairs
    return {"statistic": stat, "b": b, "c": c, "p_value": p}


def cmh(df: DataFrame, exposed: str, outcome: str, strata: str) -> dict:
    """One row per stratum comes to the driver."""
    x, y = F.col(exposed).cast("int"), F.col(outcome).cast("int")
    cells = {"a": (1, 1), "b": (1, 0), "c": (0, 1), "d": (0, 0)}
    t = df.groupBy(strata).agg(*[F.count_if((x == i) & (y == j)).cast("double").alias(k) for k, (i, j) in cells.items()])  # products of four counts are no longs
    n = F.col("a") + F.col("b") + F.col("c") + F.col("d")
    r1, c1 = F.col("a") + F.col("b"), F.col("a") + F.col("c")
    var = F.when(n > 1, r1 * (n - r1) * c1 * (n - c1) / (n * n * (n - 1))).otherwise(0.0)
    g = t.agg(F.sum(F.col("a") - r1 * c1 / n).alias("e"), F.sum(var).alias("v"), F.sum(F.col("a") * F.col("d") / n).alias("p"), F.sum(F.col("b") * F.col("c") / n).alias("q")).first()
    stat = g["e"] ** 2 / g["v"]
    return {"statistic": stat, "p_value": sp.chi2_sf(stat, 1), "common_odds_ratio": g["p"] / g["q"]}


def levene(df: DataFrame, x: str, group: str, center: str = "mean") -> dict:
    """``median`` is the Brown-Forsythe test.  The centres (a row per group) are joined back by group."""
    c = df.groupBy(group).agg((F.avg if center == "mean" else F.median)(operand(x)).alias("__c"))
    z = df.join(F.broadcast(c) if c.count() <= 10_000 else c, group).select(F.col(group), F.abs(operand(x) - F.col("__c")).alias("z"))
    r = one_way(z, "z", group)
    return {"statistic": r["statistic"], "df1": r["df1"], "df2": r["df2"], "p_value": r["p_value"]}


def brown_forsythe(df: DataFrame, x: str, group: str) -> dict:
    return levene(df, x, group, "median")


def one_way(df: DataFrame, x: str, group: str) -> dict:
    g = group_moments(df, group, x)
    n, k = g["n"].sum(), len(g)
    grand = (g["n"] * g["mean"]).sum() / n
    between, within = (g["n"] * (g["mean"] - grand) ** 2).sum(), ((g["n"] - 1) * g["var"]).sum()
    stat = (between / (k - 1)) / (within / (n - k))
    return {"statistic": stat, "df1": k - 1, "df2": int(n - k), "p_value": sp.f_sf(stat, k - 1, n - k), "ss_between": between, "ss_within": within}


def bartlett(df: DataFrame, x: str, group: str) -> dict:
    g = group_moments(df, group, x)
    n, k = g["n"].sum(), len(g)
    pooled = ((g["n"] - 1) * g["var"]).sum() / (n - k)
    c = 1 + ((1 / (g["n"] - 1)).sum() - 1 / (n - k)) / (3 * (k - 1))
    stat = ((n - k) * math.log(pooled) - ((g["n"] - 1) * np.log(g["var"])).sum()) / c
    return {"statistic": stat, "df": k - 1, "p_value": sp.chi2_sf(stat, k - 1)}


def mann_whitney(df: DataFrame, x: str, group: str, first: object, second: object, alternative: str = "two_sided") -> dict:
    """Normal approximation with tie correction, without continuity correction."""
    cells = rank_counts(df.where(F.col(group).isin(first, second)), x, group)
    r = cells.groupBy("g").agg(F.sum(F.col("k") * F.col("r")).alias("rs"), F.sum("k").alias("n")).collect()
    by = {a["g"]: a for a in r}
    n1, n2 = by[first]["n"], by[second]["n"]
    n = n1 + n2
    tie = cells.dropDuplicates(["v"]).agg(F.sum(F.pow("t", 3) - F.col("t")).alias("s")).first()["s"]
    u = by[first]["rs"] - n1 * (n1 + 1) / 2
    mean, var = n1 * n2 / 2, n1 * n2 / 12 * ((n + 1) - tie / (n * (n - 1)))
    z = (u - mean) / math.sqrt(var)
    return {"statistic": u, "z": z, "p_value": _z(z, alternative)}


def kruskal_wallis(df: DataFrame, x: str, group: str) -> dict:
    cells = rank_counts(df, x, group)
    g = cells.groupBy("g").agg(F.sum(F.col("k") * F.col("r")).alias("rs"), F.sum("k").alias("n")).toPandas()
    n = g["n"].sum()
    tie = cells.dropDuplicates(["v"]).agg(F.sum(F.pow("t", 3) - F.col("t")).alias("s")).first()["s"]
    h = (12 / (n * (n + 1)) * (g["rs"] ** 2 / g["n"]).sum() - 3 * (n + 1)) / (1 - tie / (n**3 - n))
    return {"statistic": h, "df": len(g) - 1, "p_value": sp.chi2_sf(h, len(g) - 1)}


def mood_median(df: DataFrame, x: str, group: str) -> dict:
    m = df.agg(F.median(operand(x))).first()[0]
    g = df.groupBy(group).agg(F.count_if(operand(x) > m).alias("a"), F.count_if(operand(x) < m).alias("b")).toPandas()  # ties with the median are left out
    return chi2_table(g[["a", "b"]].to_numpy()) | {"median": m}


def wilcoxon(df: DataFrame, x: str, null_median: float = 0.0, alternative: str = "two_sided") -> dict:
    """Signed ranks without zeros: all signs are counted up to 20 differences, beyond that a normal approximation with the
    variance of the ranks as they are and without continuity correction."""
    d = df.select((operand(x) - null_median).alias("d")).where("d <> 0").select(F.abs("d").alias("v"), (F.col("d") > 0).alias("g"))
    cells = rank_counts(d, "v", "g")
    r = cells.agg(F.sum(F.when(F.col("g"), F.col("k") * F.col("r")).otherwise(0.0)).alias("w"), F.sum("k").alias("n"), F.sum(F.col("k") * F.col("r")).alias("s"), F.sum(F.col("k") * F.col("r") ** 2).alias("q")).first()
    n, w = r["n"], r["w"]
    z = (w - r["s"] / 2) / math.sqrt(r["q"] / 4)
    p = _signs(cells, w, r["s"], alternative) if n <= 20 else _z(z, alternative)
    return {"statistic": w, "z": z, "n": n, "p_value": p}


def _signs(cells: DataFrame, w: float, total: float, alternative: str) -> float:
    """The share of all sign patterns that are as extreme; at most 20 ranks, doubled to be whole."""
    ways = np.zeros(int(round(2 * total)) + 1)
    ways[0] = 1.0
    for c in cells.collect():
        step = int(round(2 * c["r"]))
        for _ in range(c["k"]):
            ways[step:] = ways[step:] + ways[:-step]
    sums = np.arange(len(ways)) / 2
    as_extreme = {"greater": sums >= w - 1e-9, "less": sums <= w + 1e-9}.get(alternative, np.abs(sums - total / 2) >= abs(w - total / 2) - 1e-9)
    return float(ways[as_extreme].sum() / ways.sum())


def wilcoxon_paired(df: DataFrame, before: str, after: str, alternative: str = "two_sided") -> dict:
    return wilcoxon(df.select((operand(before) - operand(after)).alias("d")), "d", 0.0, alternative)


def friedman(df: DataFrame, conditions: list[str]) -> dict:
    """Ranks within each row, as expressions over its conditions."""
    k = len(conditions)
    cols = [operand(c) for c in conditions]
    ranks = [sum((F.when(o < c, 1.0).when(o == c, 0.5).otherwise(0.0) for j, o in enumerate(cols) if j != i), F.lit(1.0)) for i, c in enumerate(cols)]
    # ties: sum of t^3 - t over the row equals the sum over its values of t^2 - 1
    same = [sum((F.when(o == c, 1.0).otherwise(0.0) for o in cols), F.lit(0.0)) for c in cols]
    ties = sum((s * s - 1 for s in same), F.lit(0.0))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(ties).alias("t"), *[F.sum(x).alias(f"r{i}") for i, x in enumerate(ranks)]).first()
    n = r["n"]
    s = sum(r[f"r{i}"] ** 2 for i in range(k))
    stat = (12 * s / (n * k * (k + 1)) - 3 * n * (k + 1)) / (1 - r["t"] / (n * k * (k * k - 1)))
    return {"statistic": stat, "df": k - 1, "p_value": sp.chi2_sf(stat, k - 1), "kendall_w": stat / (n * (k - 1))}


def cochran_q(df: DataFrame, conditions: list[str]) -> dict:
    k = len(conditions)
    total = sum((F.col(c).cast("double") for c in conditions[1:]), F.col(conditions[0]).cast("double"))
    r = df.agg(*[F.sum(F.col(c).cast("double")).alias(f"g{i}") for i, c in enumerate(conditions)], F.sum(total).alias("l"), F.sum(total * total).alias("l2")).first()
    g = np.array([r[f"g{i}"] for i in range(k)])
    stat = (k - 1) * (k * (g**2).sum() - g.sum() ** 2) / (k * r["l"] - r["l2"])
    return {"statistic": stat, "df": k - 1, "p_value": sp.chi2_sf(stat, k - 1)}


def runs(df: DataFrame, x: str, order: list[str], partition: list[str] = ()) -> dict:
    """Runs of a binary sequence in its order; large sequences can be split over ``partition`` and their runs added."""
    w = Window.partitionBy(*partition).orderBy(*order)
    v = F.col(x).cast("int")
    d = df.select(v.alias("v"), F.lag(v).over(w).alias("p"))
    r = d.agg(F.count_if(F.col("p").isNull() | (F.col("p") != F.col("v"))).alias("r"), F.sum("v").alias("n1"), F.count(F.lit(1)).alias("n")).first()
    n1, n = r["n1"], r["n"]
    n2 = n - n1
    mean = 2 * n1 * n2 / n + 1
    var = 2 * n1 * n2 * (2 * n1 * n2 - n) / (n * n * (n - 1))
    z = (r["r"] - mean) / math.sqrt(var)
    return {"runs": r["r"], "expected": mean, "statistic": z, "p_value": _z(z, "two_sided")}


def mann_kendall(df: DataFrame, x: str, order: str, alternative: str = "two_sided") -> dict:
    """S by merge counting of the ordered series (one series in one task, batches of numpy)."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        v = p.sort_values(order)[x].to_numpy(float)
        ranks = pd.Series(v).rank(method="dense").astype(int).to_numpy()
        m, n = ranks.max(), len(v)
        tree, s = np.zeros(m + 1, np.int64), 0
        for i, r in enumerate(ranks):
            less, j = 0, r - 1
            while j > 0:
                less += tree[j]
                j -= j & -j
            upto, j = 0, r
            while j > 0:
                upto += tree[j]
                j -= j & -j
            s += less - (i - upto)
            j = r
            while j <= m:
                tree[j] += 1
                j += j & -j
        t = np.bincount(ranks)[1:].astype(float)
        return pd.DataFrame({"s": [float(s)], "n": [float(n)], "t": [float((t * (t - 1) * (2 * t + 5)).sum())]})

    r = df.select(operand(x).alias(x), order).groupBy().applyInPandas(run, "s double, n double, t double").first()
    s, n = r["s"], r["n"]
    var = (n * (n - 1) * (2 * n + 5) - r["t"]) / 18
    z = (s - np.sign(s)) / math.sqrt(var)
    return {"s": s, "statistic": z, "tau": s / (n * (n - 1) / 2), "p_value": _z(z, alternative)}


def nonparametric(df: DataFrame, method: str, x: str, group: str, **options: object) -> dict:
    return {"mann_whitney": mann_whitney, "kruskal_wallis": kruskal_wallis, "mood_median": mood_median}[method](df, x, group, **options)
