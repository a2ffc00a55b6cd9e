"""Projection, row selection and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.types import BINARY, CATEGORICAL, IDENTIFIER, ORDINAL, Meaning, MeaningError

_ORDERING = ("lessThan", "lessThanOrEqual", "greaterThan", "greaterThanOrEqual")


def columns_of(df: DataFrame, names: list[str]) -> list[str]:
    missing = [n for n in names if n not in df.columns]
    if missing or len(set(names)) != len(names):
        raise ValueError(f"unknown or repeated columns: {missing or names}")
    return names


def project(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{n}`") for n in columns_of(df, names)])


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    columns_of(df, names)
    if not names or len(names) == len(df.columns):
        raise ValueError("drop takes at least one column and leaves at least one")
    return df.drop(*names)


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    columns_of(df, [old])
    if not new.strip() or new in df.columns:
        raise ValueError(f"{new!r} is blank or taken")
    return df.withColumnRenamed(old, new)


def set_column(df: DataFrame, value: Column, name: str = "computed") -> DataFrame:
    """In place if the column exists, else at the end."""
    return df.withColumn(name, value)


def predicate(column: str, operator: str, value: object = None, meaning: Meaning | None = None) -> Column:
    """One comparison with a literal; an Ordinal column is compared by the rank of its levels."""
    c = F.col(f"`{column}`")
    if operator == "isNull":
        return c.isNull()
    if operator == "isNotNull":
        return c.isNotNull()
    kind = meaning.kind if meaning else None
    if operator in _ORDERING and kind in (CATEGORICAL, BINARY, IDENTIFIER):
        raise MeaningError(f"{kind} columns have no order")
    if operator in _ORDERING and kind == ORDINAL:
        levels = list(meaning.levels)
        at = levels.index(value)
        inside = {"lessThan": levels[:at], "lessThanOrEqual": levels[: at + 1], "greaterThan": levels[at + 1 :], "greaterThanOrEqual": levels[at:]}[operator]
        return F.when(c.isNull(), None).otherwise(c.isin(inside) if inside else F.lit(False))
    v = value if isinstance(value, Column) else F.lit(value)
    return {"equal": c == v, "notEqual": c != v, "lessThan": c < v, "lessThanOrEqual": c <= v, "greaterThan": c > v, "greaterThanOrEqual": c >= v}[operator]


def filter_rows(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def drop_rows(df: DataFrame, condition: Column) -> DataFrame:
    """Drops the rows for which the condition is true; unknown rows stay."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def filter_mask(df: DataFrame, mask: Column, drop_matches: bool = False) -> DataFrame:
    return drop_rows(df, mask) if drop_matches else df.where(mask)


def dropna_rows(df: DataFrame, subset: list[str] | None = None, how: str = "any") -> DataFrame:
    """Only nulls are missing: NaN and empty texts are values."""
    names = columns_of(df, subset or df.columns)
    nulls = [F.col(f"`{n}`").isNull() for n in names]
    missing = nulls[0]
    for n in nulls[1:]:
        missing = missing | n if how == "any" else missing & n
    return df.where(~missing)


def dropna_columns(df: DataFrame, subset: list[str] | None = None, how: str = "any") -> DataFrame:
    """One pass counts the values of all columns; an empty table keeps its columns."""
    names = columns_of(df, subset or df.columns)
    got = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]).first()
    drop = {n for i, n in enumerate(names) if got["n"] and (got[f"c{i}"] < got["n"] if how == "any" else got[f"c{i}"] == 0)}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in drop])


def order_keys(names: list[str], descending: list[str] = (), nulls_first: bool = False, meanings: dict[str, Meaning] | None = None) -> list[Column]:
    """Sort keys with explicit nulls; Ordinal columns by the rank of their levels."""
    keys = []
    for n in names:
        c = F.col(f"`{n}`")
        m = (meanings or {}).get(n)
        if m and m.kind == ORDINAL:
            if not m.levels:
                raise MeaningError(f"{n} has no declared order")
            rank = F.when(F.lit(False), 0)
            for i, level in enumerate(m.levels):
                rank = rank.when(c == F.lit(level), i)
            c = rank
        down = n in descending
        keys.append({(False, False): c.asc_nulls_last, (False, True): c.asc_nulls_first, (True, False): c.desc_nulls_last, (True, True): c.desc_nulls_first}[down, nulls_first]())
    return keys


def sort(df: DataFrame, names: list[str], descending: list[str] = (), nulls_first: bool = False, meanings: dict[str, Meaning] | None = None, then: list[str] = ()) -> DataFrame:
    """``then``: the order columns of the frame, which make the sort stable."""
    return df.orderBy(*order_keys(columns_of(df, list(names)), descending, nulls_first, meanings), *[F.col(f"`{t}`").asc_nulls_last() for t in then])


def limit(df: DataFrame, rows: int, offset: int = 0, order: list[str] = ()) -> DataFrame:
    ordered = df.orderBy(*[F.col(f"`{o}`").asc_nulls_last() for o in order]) if order else df
    return (ordered.offset(offset) if offset else ordered).limit(rows)


def page(df: DataFrame, offset: int, rows: int, order: list[str] = ()) -> tuple[DataFrame, bool]:
    """A page of at most ``rows`` rows and whether there are more; probes one row beyond."""
    got = limit(df, rows + 1, offset, order).collect()  # a page is bounded by its size
    return df.sparkSession.createDataFrame(got[:rows], df.schema), len(got) > rows
