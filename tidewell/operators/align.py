"""Regular time grids for series and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _checked(df: DataFrame, keys: list[str]) -> None:
    bad = df.where(" or ".join(f"`{k}` is null" for k in keys)).limit(1).count() or df.groupBy(*keys).count().where("count > 1").limit(1).count()
    if bad:
        raise ValueError(f"{keys} are missing or repeated")


def time_align(df: DataFrame, time_column: str, interval: int) -> DataFrame:
    """All times from the first to the last at the interval; times without a row come with nulls.

    Two passes: the range and the check that every time lies on the grid, then a join on the time.
    """
    if interval < 1:
        raise ValueError("the interval is positive")
    _checked(df, [time_column])
    kind = dict(df.dtypes)[time_column]
    number = F.datediff(F.col(time_column), F.lit("1970-01-01").cast("date")).cast("bigint") if kind == "date" else F.col(time_column).cast("bigint")
    got = df.agg(F.min(number).alias("a"), F.max(number).alias("z")).first()
    if got["a"] is None:
        return df
    if df.where(F.pmod(number - F.lit(got["a"]), F.lit(interval)) != 0).limit(1).count():
        raise ValueError("a time lies between the grid's points")
    grid = df.sparkSession.range(got["a"], got["z"] + 1, interval)
    at = F.date_add(F.lit("1970-01-01").cast("date"), F.col("id").cast("int")) if kind == "date" else F.col("id").cast(kind)
    return grid.select(at.alias(time_column)).join(df, time_column, "left").select(*df.columns)


def panel_align(df: DataFrame, entity_column: str, time_column: str) -> DataFrame:
    """Every entity on the observed times between its first and last one; gaps come with nulls.

    The grid is that of the distinct times, numbered in order (as many rows as there are times).
    """
    _checked(df, [entity_column, time_column])
    times = df.select(time_column).distinct().withColumn("__slot", F.row_number().over(Window.orderBy(time_column)))  # distinct times only
    placed = df.join(times, time_column)
    spans = placed.groupBy(entity_column).agg(F.min("__slot").alias("a"), F.max("__slot").alias("z"))
    slots = spans.select(entity_column, F.explode(F.sequence("a", "z")).alias("__slot")).join(times, "__slot")
    return slots.join(placed.drop(time_column), [entity_column, "__slot"], "left").select(*df.columns)
