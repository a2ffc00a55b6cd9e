"""Conversions between meanings; a value that cannot be kept exactly is an error unless ``force`` turns it to null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZONE = r"\s*(?:[Zz]|UTC|GMT|[+-]\d{2}:?\d{2})$"


def _fail(message: str, value: Column, force: bool, kind: str) -> Column:
    return F.lit(None).cast(kind) if force else F.raise_error(F.concat(F.lit(message + ": "), value.cast("string"))).cast(kind)


def to_numeric(x: Column, mode: str = "auto", force: bool = False) -> Column:
    """Text to numbers.  ``integer`` takes whole numbers only, ``real`` gives doubles, ``auto`` decimals (kept exactly)."""
    text = F.btrim(x.cast("string"))
    if mode == "integer":
        exact = text.try_cast("decimal(38,0)")
        sound = text.try_cast("decimal(38,18)").isNotNull() & (text.try_cast("decimal(38,18)") == exact) & text.try_cast("bigint").isNotNull()
        return F.when(x.isNull(), None).when(sound, text.try_cast("bigint")).otherwise(_fail("no integer", x, force, "bigint"))
    number = text.try_cast("double")
    sound = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(x.isNull(), None).when(sound, number).otherwise(_fail("no number", x, force, "double"))


def to_text(x: Column) -> Column:
    return x.cast("string")


def to_identifier(x: Column) -> Column:
    return x.cast("string")


def to_category(x: Column, levels: list, force: bool = False) -> Column:
    """The value if it is one of the levels."""
    return F.when(x.isNull() | x.isin(levels), x).otherwise(_fail("undeclared level", x, force, "string"))


def to_binary(x: Column, true: list = ("true", "1"), false: list = ("false", "0"), force: bool = False) -> Column:
    text = F.lower(F.btrim(x.cast("string")))
    return F.when(text.isin(*map(str, true)), True).when(text.isin(*map(str, false)), False).when(x.isNull(), None).otherwise(_fail("no binary code", x, force, "boolean"))


def to_datetime(x: Column, kind: str = "datetime", pattern: str | None = None, force: bool = False) -> Column:
    """``date`` or ``datetime``; an offset or zone is dropped and the clock kept."""
    text = F.regexp_replace(F.btrim(x.cast("string")), _ZONE, "")
    target = "date" if kind == "date" else "timestamp_ntz"
    got = (F.try_to_timestamp(text, F.lit(pattern)) if pattern else text.try_cast("timestamp_ntz")).cast("timestamp_ntz")
    if kind == "date":
        sound = got.isNotNull() & (got == F.date_trunc("day", got).cast("timestamp_ntz"))
    else:
        sound = got.isNotNull()
    return F.when(x.isNull(), None).when(sound, got.cast(target)).otherwise(_fail("no " + kind, x, force, target))
