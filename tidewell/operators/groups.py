"""User functions over groups."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key_prefix: str = "group.") -> DataFrame:
    """``fn`` over each group; its columns come after the keys, which get the prefix.  Groups run in parallel."""
    probe = [c.split()[0].strip("`") for c in schema.split(",")]
    names = [key_prefix + k for k in keys]
    if set(names) & set(probe):
        raise ValueError("a column has the name of a key")
    types = dict(df.dtypes)
    full = ", ".join(f"`{n}` {types[k]}" for n, k in zip(names, keys)) + ", " + schema

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf)
        for n, k in reversed(list(zip(names, key))):
            out.insert(0, n, [k] * len(out))
        return out

    return df.groupBy(*keys).applyInPandas(run, full)


def transform(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: list[str]) -> DataFrame:
    """Like apply, for functions that keep the rows and their order; another number of rows is an error."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        out = fn(pdf)
        if len(out) != len(pdf):
            raise ValueError("a transform keeps its rows")
        return out

    return df.groupBy(*keys).applyInPandas(run, schema)


def window_transform(df: DataFrame, columns: dict[str, object]) -> DataFrame:
    """A transform whose columns are window expressions: stays in the JVM."""
    return df.select("*", *[F.expr(c).alias(n) if isinstance(c, str) else c.alias(n) for n, c in columns.items()])
