"""Decision analysis: weights and scores of alternatives (rows) on criteria (columns), and small matrix methods."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.guards import operand
from tidewell.stats.core import cross, midranks, moments


def _ranges(df: DataFrame, criteria: list[str]) -> dict[str, tuple[float, float]]:
    r = df.agg(*[f(operand(c)).alias(f"{n}{i}") for i, c in enumerate(criteria) for n, f in (("a", F.min), ("z", F.max))]).first()
    return {c: (r[f"a{i}"], r[f"z{i}"]) for i, c in enumerate(criteria)}


def oriented(df: DataFrame, criteria: list[str], cost: list[str] = ()) -> dict[str, Column]:
    """Min-max columns where 1 is best; a constant criterion is 0."""
    r = _ranges(df, criteria)
    out = {}
    for c in criteria:
        a, z = r[c]
        v = operand(c)
        out[c] = F.lit(0.0) if z == a else ((z - v) if c in cost else (v - a)) / (z - a)
    return out


def _normal(w: np.ndarray) -> np.ndarray:
    return w / w.sum()


def entropy_weights(df: DataFrame, criteria: list[str], cost: list[str] = ()) -> np.ndarray:
    x = oriented(df, criteria, cost)
    s = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(x[c]).alias(f"s{i}") for i, c in enumerate(criteria)]).first()
    ps = [x[c] / s[f"s{i}"] if s[f"s{i}"] else F.lit(0.0) for i, c in enumerate(criteria)]
    e = df.agg(*[F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0)).alias(f"e{i}") for i, p in enumerate(ps)]).first()
    h = np.array([-e[f"e{i}"] / math.log(s["n"]) if s[f"s{i}"] else 1.0 for i in range(len(criteria))])
    return _normal(1 - h)


def critic_weights(df: DataFrame, criteria: list[str], cost: list[str] = ()) -> np.ndarray:
    x = oriented(df, criteria, cost)
    _, s, n = cross(df, [x[c] for c in criteria])
    sd = np.sqrt(np.diag(s) / (n - 1))
    ok = sd > 0
    r = np.zeros_like(s)
    r[np.ix_(ok, ok)] = s[np.ix_(ok, ok)] / np.outer(sd[ok], sd[ok]) / (n - 1)
    return _normal(np.where(ok, sd * ((1 - r) * ok).sum(1), 0.0))


def information_weights(df: DataFrame, criteria: list[str]) -> np.ndarray:
    m = moments(df, criteria)
    return _normal(np.array([math.sqrt(m[c]["var"]) / m[c]["mean"] for c in criteria]))


def independence_weights(df: DataFrame, criteria: list[str]) -> np.ndarray:
    _, s, _ = cross(df, criteria)
    d = np.sqrt(np.diag(s))
    r2 = 1 - 1 / np.diag(np.linalg.inv(s / np.outer(d, d)))
    return _normal(1 / np.sqrt(r2))


def weights(df: DataFrame, criteria: list[str], method: str = "equal", cost: list[str] = (), explicit: list[float] | None = None) -> np.ndarray:
    if explicit is not None:
        return _normal(np.array(explicit, float))
    return {"equal": lambda: np.full(len(criteria), 1 / len(criteria)), "entropy": lambda: entropy_weights(df, criteria, cost), "critic": lambda: critic_weights(df, criteria, cost), "information": lambda: information_weights(df, criteria), "independence": lambda: independence_weights(df, criteria)}[method]()


def composite(df: DataFrame, criteria: list[str], w: np.ndarray, cost: list[str] = (), name: str = "score") -> DataFrame:
    x = oriented(df, criteria, cost)
    return df.withColumn(name, sum((float(v) * x[c] for v, c in zip(w, criteria)), F.lit(0.0)))


def efficacy(df: DataFrame, criteria: list[str], w: np.ndarray, cost: list[str] = ()) -> DataFrame:
    x = oriented(df, criteria, cost)
    return df.withColumn("score", sum((float(v) * (60 + 40 * x[c]) for v, c in zip(w, criteria)), F.lit(0.0)))


def topsis(df: DataFrame, criteria: list[str], w: np.ndarray, cost: list[str] = ()) -> DataFrame:
    """Vector normalisation; adds the distances to the best and the worst point and the closeness."""
    r = df.agg(*[F.sum(operand(c) ** 2).alias(f"s{i}") for i, c in enumerate(criteria)]).first()
    k = [float(v) / math.sqrt(r[f"s{i}"]) for i, v in enumerate(w)]
    g = _ranges(df, criteria)
    best = [(g[c][0] if c in cost else g[c][1]) * f for c, f in zip(criteria, k)]
    worst = [(g[c][1] if c in cost else g[c][0]) * f for c, f in zip(criteria, k)]
    dist = lambda to: F.sqrt(sum(((operand(c) * f - t) ** 2 for c, f, t in zip(criteria, k, to)), F.lit(0.0)))
    d = df.withColumn("d_best", dist(best)).withColumn("d_worst", dist(worst))
    return d.withColumn("closeness", F.col("d_worst") / (F.col("d_best") + F.col("d_worst")))


def entropy_topsis(df: DataFrame, criteria: list[str], cost: list[str] = ()) -> DataFrame:
    return topsis(df, criteria, entropy_weights(df, criteria, cost), cost)


def grey_relational(df: DataFrame, criteria: list[str], w: np.ndarray, cost: list[str] = (), rho: float = 0.5) -> DataFrame:
    x = oriented(df, criteria, cost)
    top = df.agg(F.max(F.greatest(*[1 - x[c] for c in criteria])) if len(criteria) > 1 else F.max(1 - x[criteria[0]])).first()[0]
    return df.withColumn("grade", sum((float(v) * (rho * top) / ((1 - x[c]) + rho * top) for v, c in zip(w, criteria)), F.lit(0.0)))


def vikor(df: DataFrame, criteria: list[str], w: np.ndarray, cost: list[str] = (), majority: float = 0.5) -> DataFrame:
    x = oriented(df, criteria, cost)
    terms = [float(v) * (1 - x[c]) for v, c in zip(w, criteria)]
    d = df.withColumn("s", sum(terms, F.lit(0.0))).withColumn("r", F.greatest(*terms) if len(terms) > 1 else terms[0])
    g = d.agg(F.min("s").alias("a"), F.max("s").alias("b"), F.min("r").alias("c"), F.max("r").alias("e")).first()
    part = lambda col, lo, hi: (F.col(col) - lo) / (hi - lo) if hi > lo else F.lit(0.0)
    return d.withColumn("q", majority * part("s", g["a"], g["b"]) + (1 - majority) * part("r", g["c"], g["e"]))


def rank_sum_ratio(df: DataFrame, criteria: list[str], w: np.ndarray, cost: list[str] = ()) -> DataFrame:
    n = df.count()
    d = df
    for i, c in enumerate(criteria):
        d = midranks(d, c, name=f"__r{i}")
    ranks = [(n + 1 - F.col(f"__r{i}")) if c in cost else F.col(f"__r{i}") for i, c in enumerate(criteria)]
    return d.withColumn("wrsr", sum((float(v) * r / n for v, r in zip(w, ranks)), F.lit(0.0))).drop(*[f"__r{i}" for i in range(len(criteria))])


def coupling_coordination(df: DataFrame, criteria: list[str], w: np.ndarray) -> DataFrame:
    """Systems with scores in [0, 1]: coupling, comprehensive level and their geometric mean."""
    k = len(criteria)
    v = [operand(c) for c in criteria]
    total = sum(v[1:], v[0])
    prod = F.lit(1.0)
    for c in v:
        prod = prod * c
    coupling = F.when(total > 0, k * F.pow(prod, F.lit(1 / k)) / total).otherwise(0.0)
    level = sum((float(a) * c for a, c in zip(w, v)), F.lit(0.0))
    return df.withColumn("coupling", coupling).withColumn("level", level).withColumn("coordination", F.sqrt(F.col("coupling") * F.col("level")))


def obstacle_degree(df: DataFrame, criteria: list[str], w: np.ndarray, cost: list[str] = ()) -> DataFrame:
    x = oriented(df, criteria, cost)
    gaps = [float(v) * (1 - x[c]) for v, c in zip(w, criteria)]
    total = sum(gaps[1:], gaps[0])
    return df.select("*", *[F.when(total > 0, g / total).otherwise(0.0).alias(f"obstacle_{c}") for g, c in zip(gaps, criteria)])


def rfm(df: DataFrame, recency: str, frequency: str, monetary: str, scores: int = 5) -> DataFrame:
    """Scores 1..5 by average-tie rank shares; low recency is best."""
    n = df.count()
    d = df
    for i, c in enumerate((recency, frequency, monetary)):
        d = midranks(d, c, name=f"__r{i}")
    at = lambda r: F.least(F.floor((r - 0.5) * scores / n) + 1, F.lit(scores)).cast("int")
    return d.withColumn("r", at(n + 1 - F.col("__r0"))).withColumn("f", at(F.col("__r1"))).withColumn("m", at(F.col("__r2"))).drop("__r0", "__r1", "__r2")


def nps(df: DataFrame, rating: str) -> dict:
    r = df.agg(F.count(rating).alias("n"), F.count_if(F.col(rating) >= 9).alias("p"), F.count_if(F.col(rating) <= 6).alias("d")).first()
    return {"promoters": r["p"], "detractors": r["d"], "passives": r["n"] - r["p"] - r["d"], "score": 100.0 * (r["p"] - r["d"]) / r["n"]}


#: The evaluation of each pair of answers (fixed values; rows: functional 1..5, columns: dysfunctional 1..5).
KANO = ("QAAAO", "RIIIM", "RIIIM", "RIIIM", "RRRRQ")


def kano(df: DataFrame, functional: str, dysfunctional: str) -> dict:
    cells = df.groupBy(F.col(functional).cast("int").alias("f"), F.col(dysfunctional).cast("int").alias("d")).count().collect()  # 25 cells
    n = dict.fromkeys("AOMIRQ", 0)
    for r in cells:
        n[KANO[r["f"] - 1][r["d"] - 1]] += r["count"]
    total = n["A"] + n["O"] + n["M"] + n["I"]
    return n | {"better": (n["A"] + n["O"]) / total, "worse": -(n["O"] + n["M"]) / total}


def price_sensitivity(df: DataFrame, too_cheap: str, cheap: str, expensive: str, too_expensive: str) -> DataFrame:
    """The four cumulative curves at every distinct price, from counts."""
    names = ["too_cheap", "cheap", "expensive", "too_expensive"]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("k"), operand(c).alias("price")) for n, c in zip(names, (too_cheap, cheap, expensive, too_expensive))])).alias("x")).select("x.*")
    c = long.groupBy("price").agg(*[F.count_if(F.col("k") == n).alias(n) for n in names])
    n = df.count()
    up, down = Window.orderBy("price").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy(F.desc("price")).rowsBetween(Window.unboundedPreceding, 0)
    return c.select("price", *[(F.sum(x).over(down) / n).alias(x) for x in names[:2]], *[(F.sum(x).over(up) / n).alias(x) for x in names[2:]])


def turf(df: DataFrame, items: list[str], size: int) -> dict:
    """The combination that reaches most rows; all combinations are counted in one pass over distinct patterns."""
    p = df.groupBy(*[F.col(i).cast("int").alias(i) for i in items]).count().toPandas()  # at most 2^items patterns
    best, reach, ties, tried = None, -1, 0, 0
    for c in itertools.combinations(items, size):
        r = int(p.loc[p[list(c)].max(axis=1) > 0, "count"].sum())
        tried += 1
        if r > reach:
            best, reach, ties = c, r, 1
        elif r == reach:
            ties += 1
    return {"combination": list(best), "reach": reach, "ties": ties, "evaluated": tried}


def delphi(df: DataFrame, items: list[str], full_score: float) -> list[dict]:
    r = df.agg(*[e for i, c in enumerate(items) for e in (F.avg(operand(c)).alias(f"m{i}"), F.stddev_samp(operand(c)).alias(f"s{i}"), F.percentile(operand(c), [0.25, 0.5, 0.75]).alias(f"q{i}"), F.avg((operand(c) == full_score).cast("double")).alias(f"f{i}"))]).first()
    return [{"item": c, "mean": r[f"m{i}"], "sd": r[f"s{i}"], "cv": r[f"s{i}"] / abs(r[f"m{i}"]), "q1": r[f"q{i}"][0], "median": r[f"q{i}"][1], "q3": r[f"q{i}"][2], "full_score_share": r[f"f{i}"]} for i, c in enumerate(items)]


def conjoint(df: DataFrame, rating: str, factors: list[str]) -> dict:
    """Part-worths by dummy least squares and the importance of each factor."""
    from tidewell.stats.linear import fit

    x, names, spans = [], [], {}
    for f in factors:
        levels = sorted(r[0] for r in df.select(f).distinct().collect())
        spans[f] = (len(x), levels)
        x += [(F.col(f) == lv).cast("double") for lv in levels[1:]]
        names += [f"{f}={lv}" for lv in levels[1:]]
    m = fit(df, rating, x)
    ranges = {}
    for f, (at, levels) in spans.items():
        u = [0.0, *m.beta[1 + at : at + len(levels)]]
        ranges[f] = max(u) - min(u)
    total = sum(ranges.values())
    return {"terms": ["Intercept", *names], "utilities": m.beta, "importance": {f: r / total for f, r in ranges.items()}, "r_squared": 1 - m.rss / m.tss}


# -- matrices of judgments (small, on the driver) ------------------------------------------------------------------

#: Mean consistency indices of random judgments of 1 to 15 criteria after Tummala and Ling (fixed values).
RANDOM_INDEX = (0, 0, 0.5799, 0.8921, 1.1159, 1.2358, 1.3322, 1.3952, 1.4537, 1.4882, 1.5117, 1.5356, 1.5571, 1.5714, 1.5831)


def ahp(a: np.ndarray, random_index: float = 0.0) -> dict:
    """Weights by the principal eigenvector; without a random index for the order the consistency ratio is None."""
    a = np.asarray(a, float)
    n = len(a)
    if not np.allclose(np.log(a * a.T), 0, atol=1e-8):
        raise ValueError("opposite judgments are no reciprocals")
    val, vec = np.linalg.eig(a)
    i = int(np.argmax(val.real))
    w = _normal(np.abs(vec[:, i].real))
    ci = (val[i].real - n) / (n - 1) if n > 1 else 0.0
    ri = random_index or (RANDOM_INDEX[n - 1] if n <= len(RANDOM_INDEX) else 0.0)
    return {"weights": w, "lambda_max": val[i].real, "consistency_index": ci, "random_index": ri or None, "consistency_ratio": ci / ri if ri else None}


def fahp(a: np.ndarray) -> np.ndarray:
    a = np.asarray(a, float)
    n = len(a)
    if not np.allclose(a + a.T, 1, atol=1e-8):
        raise ValueError("opposite judgments do not add up to 1")
    return _normal((a.sum(1) + n / 2 - 1) / (n * (n - 1)))


def dematel(a: np.ndarray) -> dict:
    a = np.asarray(a, float)
    x = a / max(a.sum(1).max(), a.sum(0).max())
    if max(abs(np.linalg.eigvals(x))) >= 1 - 1e-10:
        raise ValueError("the influences diverge")
    t = x @ np.linalg.inv(np.eye(len(a)) - x)
    d, r = t.sum(1), t.sum(0)
    return {"total": t, "prominence": d + r, "relation": d - r}


def ism(a: np.ndarray) -> dict:
    """Reachability and levels."""
    n = len(a)
    r = (np.asarray(a) > 0) | np.eye(n, dtype=bool)
    for k in range(n):
        r |= np.outer(r[:, k], r[k])
    left, levels = set(range(n)), []
    while left:
        top = [i for i in left if {j for j in left if r[i, j]} <= {j for j in left if r[j, i]}]
        levels.append(sorted(top))
        left -= set(top)
    return {"reachability": r.astype(int), "levels": levels}


def fuzzy_evaluation(m: np.ndarray, w: np.ndarray | None = None, operator: str = "weighted_average") -> np.ndarray:
    m = np.asarray(m, float)
    m = m / m.sum(1, keepdims=True)
    w = _normal(np.asarray(w, float)) if w is not None else np.full(len(m), 1 / len(m))
    r = w @ m if operator == "weighted_average" else np.max(np.minimum(w[:, None], m), 0)
    return r / r.sum()
