"""What the statistical operators share: one-pass moments, cross products, ranks, and likelihood maximisation.

No operator brings rows to the driver.  Passes return a few sums; small systems are solved there with numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.guards import operand

#: Bins of a pass that looks for a median.
BINS = 1 << 14


def frame(spark: SparkSession, rows: dict | list[dict]) -> DataFrame:
    """Results as a table; numbers as double, counts as they are."""
    rows = [rows] if isinstance(rows, dict) else rows
    clean = [{k: v.item() if isinstance(v, np.generic) else v for k, v in r.items()} for r in rows]
    return spark.createDataFrame(pd.DataFrame(clean))


def moments(df: DataFrame, columns: list[str]) -> dict[str, dict[str, float]]:
    """n, mean, var of each column in one pass; null or non-finite values are errors."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        aggs += [F.avg(operand(c)).alias(f"m{i}"), F.var_samp(operand(c)).alias(f"v{i}"), F.var_pop(operand(c)).alias(f"p{i}")]
    r = df.agg(*aggs).first()
    return {c: {"n": r["n"], "mean": r[f"m{i}"], "var": r[f"v{i}"], "var_pop": r[f"p{i}"]} for i, c in enumerate(columns)}


def group_moments(df: DataFrame, group: str, value: str) -> pd.DataFrame:
    """One row per group: n, mean, var."""
    got = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(operand(value)).alias("mean"), F.coalesce(F.var_samp(operand(value)), F.lit(0.0)).alias("var"))
    return got.orderBy(group).toPandas()  # a row per group


def cross(df: DataFrame, columns: list[str | Column], weight: str | Column | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """(means, centred cross products, total weight) of the columns.

    Two passes: the second sums products of centred values, which keeps small differences of large numbers exact.
    """
    cols = [operand(c) for c in columns]
    w = operand(weight) if weight is not None else F.lit(1.0)
    named = df.select(*[c.alias(f"x{i}") for i, c in enumerate(cols)], w.alias("w"))
    first = named.agg(F.sum("w").alias("w"), *[(F.sum(F.col(f"x{i}") * F.col("w")) / F.sum("w")).alias(f"m{i}") for i in range(len(cols))]).first()
    mean = np.array([first[f"m{i}"] for i in range(len(cols))], float)
    centred = [F.col(f"x{i}") - F.lit(float(mean[i])) for i in range(len(cols))]
    k = len(cols)
    second = named.agg(*[F.sum(centred[i] * centred[j] * F.col("w")).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    s = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            s[i, j] = s[j, i] = second[f"s{i}_{j}"] or 0.0
    return mean, s, float(first["w"] or 0)


def gram(df: DataFrame, columns: list[str | Column], weight: str | Column | None = None, constant: bool = True) -> tuple[np.ndarray, float]:
    """(X'WX, n) with a leading 1 if ``constant``; put together from centred sums."""
    mean, s, w = cross(df, columns, weight)
    raw = s + w * np.outer(mean, mean)
    if not constant:
        return raw, w
    top = np.concatenate([[w], w * mean])
    return np.block([[top[:1], top[None, 1:]], [top[1:, None], raw]]), w


def solve_ls(df: DataFrame, y: str | Column, x: list[str | Column], weight: str | Column | None = None, constant: bool = True) -> dict:
    """Least squares from cross products: coefficients (constant first), residual and total sums of squares, inverse Gram."""
    mean, s, w = cross(df, [y, *x], weight)
    k = len(x)
    if constant:
        sxx, sxy = s[1:, 1:], s[1:, 0]
        slopes = np.linalg.solve(sxx, sxy) if k else np.zeros(0)
        inv = np.linalg.inv(sxx) if k else np.zeros((0, 0))
        m = mean[1:]
        beta = np.concatenate([[mean[0] - m @ slopes], slopes])
        full = np.block([[np.array([[1 / w + m @ inv @ m]]), -(m @ inv)[None, :]], [-(inv @ m)[:, None], inv]])
        rss, tss = s[0, 0] - sxy @ slopes, s[0, 0]
    else:
        raw = s + w * np.outer(mean, mean)
        full = np.linalg.inv(raw[1:, 1:])
        beta = full @ raw[1:, 0]
        rss, tss = raw[0, 0] - raw[1:, 0] @ beta, raw[0, 0]
    return {"beta": beta, "inv": full, "rss": max(float(rss), 0.0), "tss": float(tss), "n": w, "k": k + int(constant)}


def fitted(x: list[str | Column], beta: np.ndarray, constant: bool = True) -> Column:
    """The linear predictor as one expression."""
    cols = [operand(c) for c in x]
    total = F.lit(float(beta[0])) if constant else F.lit(0.0)
    for b, c in zip(beta[int(constant):], cols):
        total = total + F.lit(float(b)) * c
    return total


def exact_median(df: DataFrame, value: Column, low: float, high: float) -> float:
    """The median, exactly, without a sort and without holding the distinct values.

    Values are counted in equal bins between ``low`` and ``high``, a guess, with a bin for what lies below and one for
    what lies above; then within the bin that holds the middle, and so on.  A pass sends ``BINS`` rows at most.
    """
    v, values = F.col("v"), df.select(value.alias("v"))
    while True:
        at = F.floor((v - low) / ((high - low) or 1.0) * BINS)
        bins = values.groupBy(F.when(v < low, -1).when(v > high, BINS + 1).otherwise(at).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        got = bins.toPandas().sort_values("b")
        upto = got["n"].cumsum().to_numpy()
        a, b = (got.iloc[np.searchsorted(upto, k)] for k in ((upto[-1] + 1) // 2, upto[-1] // 2 + 1))  # the two in the middle
        if a["b"] != b["b"] or a["low"] == a["high"]:
            return float((a["high"] + b["low"]) / 2)
        low, high = float(a["low"]), float(a["high"])


def midranks(df: DataFrame, value: str, group: list[str] = (), name: str = "rank") -> DataFrame:
    """Adds the mean rank of ties.

    Ranks come from the counts of distinct values (``groupBy`` first), so the window runs over distinct values and the
    rows are joined to them by value.
    """
    from tidewell.operators.skew import salted_join

    counts = df.groupBy(*group, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__k"))
    w = Window.partitionBy(*group).orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn(name, F.coalesce(F.sum("__k").over(w), F.lit(0)) + (F.col("__k") + 1) / 2).drop("__k")
    return salted_join(df.withColumn("__v", F.col(value)), ranked, [*group, "__v"], [F.monotonically_increasing_id()], salts=8).drop("__v")


def rank_counts(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, rank sum, n) and tie counts without joining rows back: sums over counts by (value, group)."""
    cell = df.groupBy(operand(value).alias("v"), F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("k"))
    ties = cell.groupBy("v").agg(F.sum("k").alias("t"))
    w = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)  # over distinct values
    ranked = ties.withColumn("r", F.coalesce(F.sum("t").over(w), F.lit(0)) + (F.col("t") + 1) / 2)
    return cell.join(ranked, "v").select("g", "k", "r", "t", "v")


def maximise(df: DataFrame, columns: list[str], loglik: Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray], start: np.ndarray, iterations: int = 100, tolerance: float = 1e-8, sums: Callable | None = None) -> dict:
    """Maximum likelihood by Newton steps over the distributed rows.

    ``loglik(parameters, arrays)`` gives a batch's log-likelihoods row by row.  Each step is one pass: every batch sums
    value, gradient and Hessian (by central differences of the vectorised function) and sends one row.  The step is
    halved until the likelihood grows, all halvings being valued in one further pass.
    """
    data = df.select(*[operand(c).alias(c) for c in columns]).cache()
    k = len(start)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[dict[str, np.ndarray]]:
        for p in it:
            if len(p):
                yield {c: p[c].to_numpy(float) for c in columns}

    def derivatives(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        h = 1e-4 * np.maximum(1.0, np.abs(at))

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for a in batches(it):
                f0 = loglik(at, a).sum()
                up, down = np.zeros(k), np.zeros(k)
                for i in range(k):
                    e = np.zeros(k)
                    e[i] = h[i]
                    up[i], down[i] = loglik(at + e, a).sum(), loglik(at - e, a).sum()
                out = [f0, *((up - down) / (2 * h))]
                for i in range(k):
                    for j in range(i, k):
                        if i == j:
                            out.append((up[i] - 2 * f0 + down[i]) / h[i] ** 2)
                        else:
                            ei, ej = np.zeros(k), np.zeros(k)
                            ei[i], ej[j] = h[i], h[j]
                            out.append((loglik(at + ei + ej, a).sum() - loglik(at + ei - ej, a).sum() - loglik(at - ei + ej, a).sum() + loglik(at - ei - ej, a).sum()) / (4 * h[i] * h[j]))
                yield pd.DataFrame([out], columns=names)

        names = [f"s{i}" for i in range(1 + k + k * (k + 1) // 2)]
        got = data.mapInPandas(run, ", ".join(f"{n} double" for n in names)).agg(*[F.sum(n).alias(n) for n in names]).first()
        v = np.array([got[n] for n in names], float)
        hess, at_ = np.zeros((k, k)), 1 + k
        for i in range(k):
            for j in range(i, k):
                hess[i, j] = hess[j, i] = v[at_]
                at_ += 1
        return v[0], v[1 : 1 + k], hess

    def values(points: list[np.ndarray]) -> np.ndarray:
        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for a in batches(it):
                yield pd.DataFrame([[loglik(p, a).sum() for p in points]], columns=[f"s{i}" for i in range(len(points))])

        names = [f"s{i}" for i in range(len(points))]
        got = data.mapInPandas(run, ", ".join(f"{n} double" for n in names)).agg(*[F.sum(n).alias(n) for n in names]).first()
        return np.array([got[n] if got[n] is not None else np.nan for n in names], float)

    try:
        at, converged = np.asarray(start, float), False
        for step in range(iterations):
            f, g, hess = derivatives(at)
            shift = 0.0
            eig = np.linalg.eigvalsh(hess)
            if eig[-1] >= -1e-10:
                shift = eig[-1] + 1e-3 * max(1.0, abs(eig[0]))
            move = np.linalg.solve(hess - shift * np.eye(k), -g)
            sizes = [2.0**-i for i in range(12)]
            got = values([at + s * move for s in sizes])
            got = np.where(np.isfinite(got), got, -np.inf)
            best = int(np.argmax(got))
            if got[best] <= f + 1e-12 * abs(f):
                converged = True
                break
            at = at + sizes[best] * move
            if np.max(np.abs(sizes[best] * move)) < tolerance * (1 + np.max(np.abs(at))):
                converged = True
                break
        f, g, hess = derivatives(at)
        cov = np.linalg.pinv(-hess)
        return {"parameters": at, "loglik": f, "covariance": cov, "se": np.sqrt(np.maximum(np.diag(cov), 0)), "iterations": step + 1, "converged": converged}
    finally:
        data.unpersist()
