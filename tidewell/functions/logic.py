"""Comparisons, three-valued logic, choices and mappings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.guards import finite

OPERATORS = ("equal", "not_equal", "less", "less_equal", "greater", "greater_equal")


def compare(a: Column, b: Column, operator: str, absolute: float | None = None, relative: float = 0.0) -> Column:
    """One of ``OPERATORS``; with ``absolute`` values within ``absolute + relative * max(|a|, |b|)`` are equal.

    Without a tolerance integers and decimals are compared as they are, never as doubles.  Null gives null.
    """
    if operator not in OPERATORS:
        raise ValueError(f"unknown comparison {operator}")
    if absolute is None:
        same, less, more = a == b, a < b, a > b
    else:
        if absolute < 0 or relative < 0:
            raise ValueError("tolerances are not negative")
        x, y = finite(a), finite(b)
        # halves keep the difference of two huge values finite
        near = F.abs(x / 2 - y / 2) <= absolute / 2 + relative * F.greatest(F.abs(x), F.abs(y)) / 2
        same, less, more = near, ~near & (x < y), ~near & (x > y)
    return {"equal": same, "not_equal": ~same, "less": less, "less_equal": same | less, "greater": more, "greater_equal": same | more}[operator]


def truth(x: Column, positive: object) -> Column:
    """A Binary column as boolean: whether it has its positive value."""
    return x == F.lit(positive)


def choose(condition: Column, yes: Column, no: Column) -> Column:
    """An unknown condition takes the second branch."""
    return F.when(condition, yes).otherwise(no)


def map_values(x: Column, source: list, target: list, unmatched: str = "keep") -> Column:
    """Each value of ``source`` becomes that of ``target`` at its place; None stands for null on either side."""
    if len(source) != len(target) or len(set(source)) != len(source) or unmatched not in ("keep", "null"):
        raise ValueError("a mapping needs as many targets as distinct sources")
    out = F.when(F.lit(False), x)
    for s, t in zip(source, target):
        out = out.when(x.isNull() if s is None else x == F.lit(s), F.lit(t))
    return out.otherwise(x) if unmatched == "keep" else out
