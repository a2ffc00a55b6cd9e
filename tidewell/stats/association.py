"""Correlation and agreement."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.guards import operand
from tidewell.stats import special as sp
from tidewell.stats.core import cross, midranks, moments
from tidewell.stats.hypothesis import contingency


def _corr(r: float, n: float, controls: int, alternative: str, confidence: float) -> dict:
    df = n - 2 - controls
    t = math.inf if abs(r) >= 1 else r * math.sqrt(df / (1 - r * r))
    p = 0.0 if math.isinf(t) else sp.p_value(t, alternative, lambda z: sp.t_sf(z, df))
    out = {"coefficient": r, "observations": int(n), "statistic": t, "df": int(df), "p_value": p}
    if abs(r) < 1 and n - controls > 3:
        half = sp.normal_quantile(0.5 + confidence / 2) / math.sqrt(n - controls - 3)
        out |= {"lower": math.tanh(math.atanh(r) - half), "upper": math.tanh(math.atanh(r) + half)}
    return out


def pearson(df: DataFrame, x: str, y: str, alternative: str = "two_sided", confidence: float = 0.95) -> dict:
    _, s, n = cross(df, [x, y])
    return _corr(s[0, 1] / math.sqrt(s[0, 0] * s[1, 1]), n, 0, alternative, confidence)


def partial(df: DataFrame, x: str, y: str, controls: list[str], alternative: str = "two_sided", confidence: float = 0.95) -> dict:
    """From the inverse of the covariance matrix: one pair of passes."""
    _, s, n = cross(df, [x, y, *controls])
    c = s[:2, :2] - s[:2, 2:] @ np.linalg.solve(s[2:, 2:], s[2:, :2])
    return _corr(c[0, 1] / math.sqrt(c[0, 0] * c[1, 1]), n, len(controls), alternative, confidence)


def spearman(df: DataFrame, x: str, y: str, alternative: str = "two_sided") -> dict:
    ranked = midranks(midranks(df.select(operand(x).alias("x"), operand(y).alias("y")), "x", name="rx"), "y", name="ry")
    _, s, n = cross(ranked, ["rx", "ry"])
    r = _corr(s[0, 1] / math.sqrt(s[0, 0] * s[1, 1]), n, 0, alternative, 0.95)
    return {k: r[k] for k in ("coefficient", "observations", "statistic", "df", "p_value")}


def kendall(df: DataFrame, x: str, y: str, alternative: str = "two_sided") -> dict:
    """tau-b from the cells of distinct (x, y) pairs: concordance is summed by blocks of a sorted merge in one task over
    distinct pairs."""
    import pandas as pd

    cells = df.groupBy(operand(x).alias("x"), operand(y).alias("y")).agg(F.count(F.lit(1)).alias("k"))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["x", "y"], kind="stable")
        xs, ys, k = p["x"].to_numpy(), pd.Series(p["y"]).rank(method="dense").astype(int).to_numpy(), p["k"].to_numpy(float)
        m = int(ys.max())
        tree, con, dis, total, i = np.zeros(m + 1), 0.0, 0.0, 0.0, 0

        def upto(r: int) -> float:
            s = 0.0
            while r > 0:
                s += tree[r]
                r -= r & -r
            return s

        while i < len(xs):
            j = i
            while j < len(xs) and xs[j] == xs[i]:
                less, le = upto(ys[j] - 1), upto(ys[j])
                con += k[j] * less
                dis += k[j] * (total - le)
                j += 1
            for q in range(i, j):
                r = ys[q]
                while r <= m:
                    tree[r] += k[q]
                    r += r & -r
                total += k[q]
            i = j
        tx, ty = p.groupby("x")["k"].sum().to_numpy(float), p.groupby("y")["k"].sum().to_numpy(float)
        sums = [(t * (t - 1)).sum() for t in (tx, ty)] + [(t * (t - 1) * (2 * t + 5)).sum() for t in (tx, ty)] + [(t * (t - 1) * (t - 2)).sum() for t in (tx, ty)]
        return pd.DataFrame([[con, dis, total, *sums]], columns=list("abcdefghi"))

    r = cells.groupBy().applyInPandas(run, ", ".join(f"{c} double" for c in "abcdefghi")).first()
    s, n = r["a"] - r["b"], r["c"]
    n0 = n * (n - 1)
    tau = 2 * s / math.sqrt((n0 - r["d"]) * (n0 - r["e"]))
    var = (n0 * (2 * n + 5) - r["f"] - r["g"]) / 18 + r["h"] * r["i"] / (9 * n0 * (n - 2)) + r["d"] * r["e"] / (2 * n0)
    z = s / math.sqrt(var)
    return {"coefficient": tau, "observations": int(n), "statistic": z, "p_value": sp.p_value(z, alternative, sp.normal_sf)}


def kappa(df: DataFrame, first: str, second: str, weights: str = "none") -> dict:
    """Cohen's kappa of two raters; ``linear`` or ``quadratic`` weights by the order of the codes."""
    t = contingency(df, first, second)
    codes = sorted(set(t.index) | set(t.columns))
    o = t.reindex(index=codes, columns=codes).fillna(0).to_numpy(float)
    o /= o.sum()
    d = np.abs(np.subtract.outer(range(len(codes)), range(len(codes)))).astype(float)
    w = {"none": (d > 0).astype(float), "linear": d, "quadratic": d**2}[weights]
    e = np.outer(o.sum(1), o.sum(0))
    return {"kappa": 1 - (w * o).sum() / (w * e).sum(), "observed": 1 - (w * o).sum() / max(w.max(), 1), "categories": len(codes)}


def fleiss_kappa(df: DataFrame, raters: list[str]) -> dict:
    """Raters may be exchanged; agreement is summed over pairs of raters and category totals."""
    m = len(raters)
    pairs = sum((F.when(F.col(a) == F.col(b), 2.0).otherwise(0.0) for i, a in enumerate(raters) for b in raters[i + 1 :]), F.lit(0.0))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(pairs).alias("s")).first()
    shares = df.select(F.explode(F.array(*[F.col(c).cast("string") for c in raters])).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("k")).toPandas()
    p = shares["k"].to_numpy(float) / (r["n"] * m)
    observed, chance = r["s"] / (r["n"] * m * (m - 1)), (p**2).sum()
    return {"kappa": (observed - chance) / (1 - chance), "observed": observed, "expected": chance}


def icc(df: DataFrame, raters: list[str]) -> dict:
    """ICC(1,1), (2,1), (3,1) and their means over raters, from row and column sums in one pass."""
    k = len(raters)
    cols = [operand(c) for c in raters]
    row = sum(cols[1:], cols[0])
    sq = sum((c * c for c in cols[1:]), cols[0] * cols[0])
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("s"), F.sum(row * row).alias("r2"), F.sum(sq).alias("q"), *[F.sum(c).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    n = r["n"]
    corr = r["s"] ** 2 / (n * k)
    ssb, ssj, sst = r["r2"] / k - corr, sum(r[f"c{i}"] ** 2 for i in range(k)) / n - corr, r["q"] - corr
    msb, msj = ssb / (n - 1), ssj / (k - 1)
    mse, msw = (sst - ssb - ssj) / ((n - 1) * (k - 1)), (sst - ssb) / (n * (k - 1))
    return {
        "icc1": (msb - msw) / (msb + (k - 1) * msw), "icc2": (msb - mse) / (msb + (k - 1) * mse + k * (msj - mse) / n), "icc3": (msb - mse) / (msb + (k - 1) * mse),
        "icc1k": (msb - msw) / msb, "icc2k": (msb - mse) / (msb + (msj - mse) / n), "icc3k": (msb - mse) / msb, "ms_between": msb, "ms_error": mse,
    }


def bland_altman(df: DataFrame, x: str, y: str, agreement: float = 0.95) -> dict:
    d = moments(df.select((operand(x) - operand(y)).alias("d")), ["d"])["d"]
    sd, z = math.sqrt(d["var"]), sp.normal_quantile(0.5 + agreement / 2)
    return {"bias": d["mean"], "sd": sd, "lower": d["mean"] - z * sd, "upper": d["mean"] + z * sd, "observations": d["n"]}


def kendall_w(df: DataFrame, raters: list[str]) -> dict:
    """Concordance of raters (columns) over subjects (rows)."""
    m = len(raters)
    ranked = df.select(*[operand(c).alias(f"x{i}") for i, c in enumerate(raters)])
    ties = 0.0
    for i in range(m):
        ties += ranked.groupBy(f"x{i}").count().agg(F.sum(F.pow("count", 3) - F.col("count"))).first()[0]
        ranked = midranks(ranked, f"x{i}", name=f"r{i}")
    total = sum((F.col(f"r{i}") for i in range(1, m)), F.col("r0"))
    r = ranked.agg(F.count(F.lit(1)).alias("n"), F.var_pop(total).alias("v")).first()
    n = r["n"]
    w = 12 * r["v"] * n / (m * m * (n**3 - n) - m * ties)
    stat = m * (n - 1) * w
    return {"w": w, "statistic": stat, "df": n - 1, "p_value": sp.chi2_sf(stat, n - 1)}


def ridit(df: DataFrame, level: str, sample: str, reference: object) -> dict:
    """Mean ridits of the samples against a reference sample; a row per level and sample comes to the driver."""
    t = contingency(df, level, sample).astype(float)
    ref = t[reference].to_numpy()
    r = (np.cumsum(ref) - ref / 2) / ref.sum()
    out = {}
    for c in t.columns:
        n = t[c].sum()
        out[f"ridit_{c}"] = float((t[c].to_numpy() * r).sum() / n)
    return out


def rwg(df: DataFrame, group: str, item: str, options: int) -> DataFrame:
    """Within-group agreement per group against a uniform null of so many options."""
    null = (options**2 - 1) / 12
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.var_samp(operand(item)).alias("v"))
    return g.select(group, "n", F.greatest(1 - F.col("v") / null, F.lit(0.0)).alias("rwg"), (F.col("v") > null).alias("variance_truncated"))
