"""What plots show, computed on all rows; only points of a drawing are thinned out, to at most ``POINTS``."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.guards import finite, operand
from tidewell.operators.profile import histogram as _histogram

POINTS, GROUPS, BINS, WORDS, HEAT_ROWS = 2_048, 64, 128, 256, 128


def thinned(df: DataFrame, columns: list[str], order: list[str], points: int = POINTS) -> DataFrame:
    """Every k-th row in order, so that a drawing has at most ``points``."""
    from tidewell.operators.combine import row_numbers

    n = df.count()
    rows = df.select(*dict.fromkeys([*columns, *order]))
    if n <= points:
        return rows.orderBy(*order).select(*columns)
    step = -(-n // points)
    return row_numbers(rows, [F.col(o) for o in order], "__pos").where(F.col("__pos") % step == 0).orderBy("__pos").select(*columns)


def scatter(df: DataFrame, x: str, y: str, order: list[str]) -> DataFrame:
    return thinned(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), [x, y], order)


line = scatter


def error_bars(df: DataFrame, x: str, y: str, lower: str, upper: str, order: list[str]) -> DataFrame:
    return thinned(df.where(F.col(lower) <= F.col(upper)), [x, y, lower, upper], order)


def bubble(df: DataFrame, x: str, y: str, size: str, order: list[str]) -> DataFrame:
    return thinned(df.where(F.col(size) >= 0), [x, y, size], order)


def quadrants(df: DataFrame, x: str, y: str, x_cut: float, y_cut: float) -> DataFrame:
    """Rows per quadrant: 1 right above, 2 left above, 3 left below, 4 right below; the cuts belong to right and above."""
    right, above = F.col(x) >= x_cut, F.col(y) >= y_cut
    q = F.when(right & above, 1).when(~right & above, 2).when(~right & ~above, 3).otherwise(4)
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(q.alias("quadrant")).agg(F.count(F.lit(1)).alias("n"))


def ecdf(df: DataFrame, x: str) -> DataFrame:
    """value, n, cumulative share; the window runs over distinct values, which are counted first."""
    counts = df.where(F.col(x).isNotNull()).groupBy(finite(x).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("value", "n", (F.sum("n").over(w) / F.sum("n").over(Window.partitionBy())).alias("share"))


def histogram(df: DataFrame, x: str, bins: int = 20) -> DataFrame:
    return _histogram(df, x, min(bins, BINS))


def kde(df: DataFrame, x: str, points: int = 128) -> DataFrame:
    """Gaussian kernel density with Silverman's bandwidth on a grid; the grid (at most 512 points) meets each distinct
    value once."""
    got = df.agg(F.count(x).alias("n"), F.stddev_samp(finite(x)).alias("s"), F.min(finite(x)).alias("a"), F.max(finite(x)).alias("z"), F.percentile(finite(x), [0.25, 0.75]).alias("q")).first()
    spread = min(got["s"], (got["q"][1] - got["q"][0]) / 1.349 or got["s"])
    h = 0.9 * spread * got["n"] ** -0.2
    a, z = got["a"] - 3 * h, got["z"] + 3 * h
    points = min(points, 512)
    grid = [a + (z - a) * i / (points - 1) for i in range(points)]
    counts = df.where(F.col(x).isNotNull()).groupBy(finite(x).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    norm = got["n"] * h * math.sqrt(2 * math.pi)
    sums = counts.agg(*[F.sum(F.col("k") * F.exp(-0.5 * F.pow((F.col("v") - g) / h, 2))).alias(f"d{i}") for i, g in enumerate(grid)])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(g).alias("x"), (F.col(f"d{i}") / norm).alias("density")) for i, g in enumerate(grid)])))


def box(df: DataFrame, x: str, groups: list[str] = ()) -> DataFrame:
    """Quartiles, whiskers within 1.5 times their distance, and the values outside, per group."""
    q = df.groupBy(*groups).agg(F.percentile(finite(x), [0.25, 0.5, 0.75]).alias("q"), F.count(x).alias("n"))
    q = q.select(*groups, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    low, high = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    joined = df.join(q, list(groups)) if groups else df.crossJoin(F.broadcast(q))  # without groups the quartiles are one row
    inside = F.col(x).between(low, high)
    return joined.groupBy(*groups, "n", "q1", "median", "q3").agg(F.min(F.when(inside, F.col(x))).alias("lower"), F.max(F.when(inside, F.col(x))).alias("upper"), F.count_if(~inside).alias("outside"))


def violin(df: DataFrame, x: str, points: int = 64) -> DataFrame:
    return kde(df, x, points)


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """x, y, r for all pairs, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    got = df.agg(*[F.corr(operand(a), operand(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return got.select(F.inline(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def heatmap(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    return df.orderBy(*order).select(*columns).limit(HEAT_ROWS)


def word_counts(df: DataFrame, words: str, most: int = WORDS) -> DataFrame:
    counted = df.where(F.col(words).isNotNull() & (F.btrim(words) != "")).groupBy(F.btrim(words).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "word").limit(min(most, WORDS))


def pareto(df: DataFrame, category: str) -> DataFrame:
    """Categories by falling count with the share of all up to each; the window runs over the categories."""
    counts = df.where(F.col(category).isNotNull()).groupBy(F.col(category).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("n"), "category").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("category", "n", (F.sum("n").over(w) / F.sum("n").over(Window.partitionBy())).alias("share"))


def roc(df: DataFrame, label: str, score: str) -> DataFrame:
    """threshold, false and true positive rate; one row per distinct score, after counting."""
    counts = df.groupBy(finite(score).alias("threshold")).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.sum(1 - F.col(label).cast("bigint")).alias("q"))
    w, whole = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    return counts.select("threshold", (F.sum("q").over(w) / F.sum("q").over(whole)).alias("fpr"), (F.sum("p").over(w) / F.sum("p").over(whole)).alias("tpr"))


def auc(curve: DataFrame) -> DataFrame:
    """The area below a ROC curve, by trapezoids from (0, 0)."""
    w = Window.orderBy(F.desc("threshold"))
    step = curve.select((F.col("fpr") - F.coalesce(F.lag("fpr").over(w), F.lit(0.0))).alias("d"), (F.col("tpr") + F.coalesce(F.lag("tpr").over(w), F.lit(0.0))).alias("s"))
    return step.agg((F.sum(F.col("d") * F.col("s")) / 2).alias("auc"))


def qq(df: DataFrame, x: str, mean: float | None = None, sd: float | None = None) -> DataFrame:
    """sample value and normal quantile at (rank - 0.5) / n, one point per distinct value's middle rank."""
    from tidewell.stats.special import normal_quantile_column

    got = df.agg(F.count(x).alias("n"), F.avg(finite(x)).alias("m"), F.stddev_samp(finite(x)).alias("s")).first()
    m, s = got["m"] if mean is None else mean, got["s"] if sd is None else sd
    counts = df.where(F.col(x).isNotNull()).groupBy(finite(x).alias("value")).agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    p = (upto - F.col("k") / 2) / got["n"]
    return counts.select("value", p.alias("p")).select("value", "p", (normal_quantile_column(F.col("p")) * s + m).alias("theoretical"))


def combination(df: DataFrame, category: str, bars: str, lines: str, order: list[str]) -> DataFrame:
    return df.orderBy(*order).select(category, bars, lines).limit(POINTS)
