"""Arithmetic that fails rather than giving null, NaN or an infinity."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.guards import demand, finite, operand, present

PI, E = F.lit, F.lit


def pi() -> Column:
    return F.lit(math.pi)


def e() -> Column:
    return F.lit(math.e)


def _both(a: Column, b: Column, integer: bool) -> tuple[Column, Column]:
    return (present(a).cast("bigint"), present(b).cast("bigint")) if integer else (operand(a), operand(b))


def add(*operands: Column, integer: bool = False) -> Column:
    """The sum of two or more operands; integers stay integers, an overflow is an error."""
    if len(operands) < 2:
        raise ValueError("add takes at least two operands")
    return reduce(lambda a, b: a + b, [present(x).cast("bigint") if integer else operand(x) for x in operands])


def subtract(a: Column, b: Column, integer: bool = False) -> Column:
    a, b = _both(a, b, integer)
    return a - b


def multiply(a: Column, b: Column, integer: bool = False) -> Column:
    a, b = _both(a, b, integer)
    return a * b


def divide(a: Column, b: Column) -> Column:
    """Always a double; division by zero is an error."""
    return finite(operand(a) / demand(operand(b) != 0, operand(b), "division by zero"), "quotient")


def power(a: Column, b: Column) -> Column:
    """Fails for zero to a power not above zero and for a negative base with a fraction."""
    a, b = operand(a), operand(b)
    sound = ((a != 0) | (b > 0)) & ((a >= 0) | (b == F.floor(b)))
    return finite(F.pow(demand(sound, a, "power outside its domain"), b), "power")


def log(value: Column, base: Column) -> Column:
    value, base = operand(value), operand(base)
    return F.ln(demand(value > 0, value, "logarithm of a value not above zero")) / F.ln(demand((base > 0) & (base != 1), base, "unusable base"))


def ln(x: Column) -> Column:
    return F.ln(demand(operand(x) > 0, operand(x), "logarithm of a value not above zero"))


def log2(x: Column) -> Column:
    return F.log2(demand(operand(x) > 0, operand(x), "logarithm of a value not above zero"))


def log10(x: Column) -> Column:
    return F.log10(demand(operand(x) > 0, operand(x), "logarithm of a value not above zero"))


def square(x: Column) -> Column:
    return finite(operand(x) * operand(x), "square")


def sqrt(x: Column) -> Column:
    return F.sqrt(demand(operand(x) >= 0, operand(x), "root of a negative value"))


def clip(x: Column, lower: float, upper: float) -> Column:
    """Null stays null."""
    if not (math.isfinite(lower) and math.isfinite(upper) and lower <= upper):
        raise ValueError("clip needs finite bounds in order")
    d = finite(x)
    return F.when(d < lower, F.lit(float(lower))).when(d > upper, F.lit(float(upper))).otherwise(d)


def bins(x: Column, edges: list[float], labels: list[str]) -> Column:
    """Left-closed bins between the edges; one label more than edges."""
    if len(labels) != len(edges) + 1 or sorted(set(edges)) != list(edges) or len(set(labels)) != len(labels):
        raise ValueError("bins need increasing edges and one distinct label more than edges")
    d = finite(x)
    out = F.when(d.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        out = out.when(d < edge, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))
