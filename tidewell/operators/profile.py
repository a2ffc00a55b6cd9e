"""Profiles of tables: statistics, distributions and an overview, each in one or two passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.guards import finite_or_null

BINS, TOP = 20, 15


def numeric_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, nulls, min, max, mean, median, std, variance; non-finite values are left out."""
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(columns):
        d = finite_or_null(c)
        aggs += [F.count(d).alias(f"c{i}"), F.count_if(F.col(c).isNull()).alias(f"u{i}"), F.min(d).alias(f"a{i}"), F.max(d).alias(f"z{i}"), F.avg(d).alias(f"m{i}"), F.median(d).alias(f"h{i}"), F.stddev_samp(d).alias(f"s{i}"), F.var_samp(d).alias(f"v{i}")]
        rows.append(F.struct(F.lit(c).alias("column"), *[F.col(f"{k}{i}").alias(n) for k, n in (("c", "count"), ("u", "nulls"), ("a", "min"), ("z", "max"), ("m", "mean"), ("h", "median"), ("s", "std"), ("v", "variance"))]))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def text_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, nulls, empty, unique, mode (the smallest of the most frequent values)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    counts = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    seen = F.col("v").isNotNull()
    best = F.min(F.when(seen, F.struct((-F.col("n")).alias("n"), F.col("v").alias("v"))))["v"]
    return counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)).alias("count"), F.coalesce(F.sum(F.when(~seen, F.col("n"))), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(F.col("v") == "", F.col("n"))), F.lit(0)).alias("empty"), F.count("v").alias("unique"), best.alias("mode"),
    )


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """Equal bins between the least and the greatest finite value, the last one closed; a constant has one bin."""
    d = finite_or_null(column)
    got = df.agg(F.min(d).alias("a"), F.max(d).alias("z")).first()
    if got["a"] is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, frequency bigint")
    a, z = got["a"], got["z"]
    n = bins if z > a else 1
    width = (z - a) / n if z > a else 0.0
    at = F.least(F.floor((d - a) / F.lit(width)), F.lit(n - 1)).cast("int") if width else F.lit(0)
    counted = df.where(d.isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("frequency"))
    grid = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"), (F.lit(a) + F.col("id") * F.lit(width)).alias("lower"), (F.lit(a) + (F.col("id") + 1) * F.lit(width)).alias("upper"))
    return grid.join(counted, "bin", "left").select("bin", "lower", "upper", F.coalesce("frequency", F.lit(0)).alias("frequency"))


def top_values(df: DataFrame, column: str, top: int = TOP) -> DataFrame:
    """The most frequent values, and all others together (value null, ``other`` true)."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("frequency"))
    best = counts.orderBy(F.desc("frequency"), F.asc("value")).limit(top)
    rest = counts.join(best.select("value"), "value", "left_anti").agg(F.sum("frequency").alias("frequency"))
    return best.withColumn("other", F.lit(False)).unionByName(rest.where("frequency is not null").select(F.lit(None).cast("string").alias("value"), "frequency", F.lit(True).alias("other")))


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, nulls, and rows with a null."""
    nulls = [F.col(f"`{c}`").isNull().cast("bigint") for c in df.columns]
    total = sum(nulls[1:], nulls[0])
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).cast("bigint").alias("column_count"), F.coalesce(F.sum(total), F.lit(0)).alias("nulls"), F.count_if(total > 0).alias("rows_with_nulls"))
