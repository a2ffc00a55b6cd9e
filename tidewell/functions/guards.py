"""Strict values: expressions that fail on values an operator must not take, instead of passing them on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The greatest integer up to which every integer is a double.
EXACT = 1 << 53


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str, what: str = "value") -> Column:
    """``x`` as double; NaN and infinities raise, null stays."""
    d = _col(x).cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), F.raise_error(F.lit(f"non-finite {what}")).cast("double")).otherwise(d)


def finite_or_null(x: Column | str) -> Column:
    """``x`` as double; NaN and infinities become null (for profiles, which leave them out)."""
    d = _col(x).cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def present(x: Column | str, what: str = "operand") -> Column:
    """``x`` itself; null raises."""
    c = _col(x)
    return F.when(c.isNull(), F.raise_error(F.lit(f"missing {what}"))).otherwise(c)


def operand(x: Column | str, what: str = "operand") -> Column:
    """A double that is neither null nor non-finite."""
    d = _col(x).cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.raise_error(F.lit(f"missing or non-finite {what}")).cast("double")).otherwise(d)


def lossless(x: Column | str) -> Column:
    """An integer as double; raises if the double is another number."""
    c = _col(x)
    return F.when(F.abs(c.cast("decimal(38,0)")) <= F.lit(EXACT), c.cast("double")).when(c.cast("double").cast("decimal(38,0)") == c.cast("decimal(38,0)"), c.cast("double")).when(c.isNull(), None).otherwise(
        F.raise_error(F.lit("an integer has no exact double")).cast("double")
    )


def demand(condition: Column, value: Column, message: str) -> Column:
    """``value`` where the condition holds or is null; otherwise an error."""
    return F.when(~F.coalesce(condition, F.lit(True)), F.raise_error(F.lit(message))).otherwise(value)
