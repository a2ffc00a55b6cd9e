"""Grouped and whole-table aggregation, reshaping and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.calendar import truncate
from tidewell.functions.guards import finite

OPERATIONS = ("count", "sum", "mean", "min", "max", "std", "median")


def operation(name: str, x: Column) -> Column:
    """One of ``OPERATIONS`` over a column, as double (count: bigint); non-finite values are errors."""
    if name == "count":
        return F.count(x)
    d = finite(x)
    return {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "median": F.median}[name](d)


def group_aggregate(df: DataFrame, keys: list[str], **columns: list[str]) -> DataFrame:
    """``columns``: for each operation the columns it is applied to; ``row_count`` always comes first.

    Names are ``<column>_<operation>``.  Null keys are a group.
    """
    if not keys:
        raise ValueError("groups need a key")
    wanted = [(c, op) for op in OPERATIONS for c in columns.get(op, [])]
    if len(set(wanted)) != len(wanted) or set(columns) - set(OPERATIONS):
        raise ValueError("unknown or repeated aggregates")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), *[operation(op, F.col(c)).alias(f"{c}_{op}") for c, op in wanted])


def describe(df: DataFrame, numeric: list[str], labelled: list[str] = ()) -> DataFrame:
    """One row per column, in one pass: count, missing, mean, std, min, q25, median, q75, max, or unique values."""
    n = len(numeric) + len(labelled)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(numeric):
        d = finite(c)
        aggs += [F.count(c).alias(f"c{i}"), F.avg(d).alias(f"m{i}"), F.stddev_samp(d).alias(f"s{i}"), F.min(d).alias(f"a{i}"), F.max(d).alias(f"z{i}"), F.percentile(d, [0.25, 0.5, 0.75]).alias(f"q{i}")]
    for i, c in enumerate(labelled):
        aggs += [F.count(c).alias(f"c{len(numeric) + i}"), F.count_distinct(c).alias(f"u{len(numeric) + i}")]
    none = F.lit(None).cast("double")
    rows = []
    for i, c in enumerate([*numeric, *labelled]):
        own = i < len(numeric)
        rows.append(
            F.struct(
                F.lit(c).alias("column"), F.col(f"c{i}").alias("count"), (F.col("n") - F.col(f"c{i}")).alias("missing"),
                *[(F.col(f"{k}{i}") if own else none).alias(a) for k, a in (("m", "mean"), ("s", "std"), ("a", "min"))],
                *[(F.col(f"q{i}")[j] if own else none).alias(a) for j, a in enumerate(("q25", "median", "q75"))],
                (F.col(f"z{i}") if own else none).alias("max"), (F.lit(None).cast("bigint") if own else F.col(f"u{i}")).alias("unique"),
            )
        )
    if not n:
        raise ValueError("nothing to describe")
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def frequency(df: DataFrame, column: str, include_null: bool = False) -> DataFrame:
    """value, frequency, proportion; nulls count for the proportion only if they are included."""
    rows = df if include_null else df.where(F.col(column).isNotNull())
    counted = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("frequency"))
    total = rows.agg(F.count(F.lit(1)).alias("__total"))
    return counted.join(F.broadcast(total)).select("value", "frequency", (F.col("frequency") / F.col("__total")).alias("proportion"))  # the total is one row


def reduce_series(df: DataFrame, column: str, how: str, integer: bool = False) -> DataFrame:
    """One value: length, count, sum (integers exactly; 0 if empty) or mean."""
    c = F.col(column)
    value = {"length": F.count(F.lit(1)), "count": F.count(c), "sum": F.coalesce(F.sum(c.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")) if integer else F.coalesce(F.sum(finite(c)), F.lit(0.0)), "mean": F.avg(finite(c))}[how]
    return df.agg(value.alias(how))


def pivot(df: DataFrame, keys: list[str], category: str, value: str, levels: list, names: list[str], aggregate: str = "sum") -> DataFrame:
    """One column per declared level (None for null), in one pass; other levels are left out."""
    if len(levels) != len(names) or len(set(names)) != len(names) or set(names) & set(keys):
        raise ValueError("levels need distinct free names")
    c = F.col(category)
    cells = [operation(aggregate, F.when(c.isNull() if lv is None else c == F.lit(lv), F.col(value))).alias(n) for lv, n in zip(levels, names)]
    return df.groupBy(*keys).agg(*cells) if keys else df.agg(*cells)


def unpivot(df: DataFrame, keys: list[str], columns: list[str], variable_name: str = "variable", value_name: str = "value", include_null: bool = True) -> DataFrame:
    """One row per key row and column; the columns need one type."""
    types = dict(df.dtypes)
    if len({types[c] for c in columns}) != 1:
        raise ValueError("the columns differ in type")
    long = df.unpivot([F.col(k) for k in keys], [F.col(c) for c in columns], variable_name, value_name)
    return long if include_null else long.where(F.col(value_name).isNotNull())


def resample(df: DataFrame, time_column: str, unit: str, keys: list[str], columns: list[str], aggregate: str = "mean") -> DataFrame:
    """Aggregates of calendar buckets; buckets without rows do not come up."""
    kind = dict(df.dtypes)[time_column]
    return df.groupBy(truncate(F.col(time_column), unit, kind).alias(time_column), *keys).agg(*[operation(aggregate, F.col(c)).alias(f"{c}_{aggregate}") for c in columns])


def encode(df: DataFrame, column: str, levels: list, names: list[str], reference: object = None, drop_reference: bool = False) -> DataFrame:
    """A boolean column per declared level; ``reference`` may be left out."""
    c = F.col(column)
    kept = [(lv, n) for lv, n in zip(levels, names) if not (drop_reference and lv == reference)]
    return df.select("*", *[(c.isNull() if lv is None else F.coalesce(c == F.lit(lv), F.lit(False))).alias(n) for lv, n in kept])


def single_value(df: DataFrame, column: str, method: str, fill: object = 0) -> Column:
    """The value that stands in for nulls: mean, median, mode (the smallest of several) or a constant."""
    if method == "constant":
        return F.lit(fill)
    c = F.col(column)
    if method == "mode":
        top = df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("v")).limit(1).collect()
        value = top[0]["v"] if top else None
    else:
        value = df.agg((F.avg if method == "mean" else F.median)(finite(c))).first()[0]
    if value is None:
        raise ValueError(f"{column} has no value to impute from")
    return F.lit(value)


def impute(df: DataFrame, column: str, method: str = "mean", fill: object = 0) -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), single_value(df, column, method, fill)))


def standardize(df: DataFrame, column: str, name: str | None = None) -> tuple[DataFrame, float, float]:
    """(x - mean) / sd, with the mean and the sd; one pass for the statistics."""
    got = df.agg(F.avg(finite(column)).alias("m"), F.stddev_samp(finite(column)).alias("s")).first()
    if got["m"] is None or not got["s"]:
        raise ValueError(f"{column} has no spread")
    return df.withColumn(name or column, (finite(column) - got["m"]) / got["s"]), got["m"], got["s"]


def inverse_standardize(df: DataFrame, column: str, mean: float, sd: float, name: str | None = None) -> DataFrame:
    return df.withColumn(name or column, finite(column) * sd + mean)
