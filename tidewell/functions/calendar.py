"""Date and time functions on dates and timestamps without zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = ("year", "quarter", "month", "week", "day", "doy", "dow", "hour", "minute", "second")
TRUNCATIONS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")
#: Microseconds of the units with a fixed length.
MICROS = {"week": 604_800_000_000, "day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1_000, "microsecond": 1}


def part(x: Column, name: str) -> Column:
    """A part as double: ISO weeks, days of the week from Sunday = 0, whole seconds."""
    if name not in PARTS:
        raise ValueError(f"unknown part {name}")
    if name == "dow":
        return (F.dayofweek(x) - 1).cast("double")
    got = {"year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth, "doy": F.dayofyear, "hour": F.hour, "minute": F.minute, "second": F.second}[name](x)
    return got.cast("double")


def truncate(x: Column, unit: str, to: str = "timestamp_ntz") -> Column:
    """``to``: the type of the column, which is kept (``timestamp_ntz`` or ``date``)."""
    if unit not in TRUNCATIONS:
        raise ValueError(f"unknown unit {unit}")
    return F.date_trunc(unit, x).cast(to)


def micros(x: Column) -> Column:
    """Microseconds since 1970, read in the session's zone, which is UTC."""
    return F.unix_micros(x.cast("timestamp"))


def shift(x: Column, amount: int, unit: str, to: str = "timestamp_ntz") -> Column:
    """Years and months end at the month's last day; other units are fixed lengths; units finer than the type raise."""
    if unit in ("year", "quarter", "month"):
        months = amount * {"year": 12, "quarter": 3, "month": 1}[unit]
        if to == "date":
            return F.add_months(x, months)
        return (x + F.make_interval(months=F.lit(months))).cast(to)
    if unit not in MICROS or to == "date" and MICROS[unit] < MICROS["day"]:
        raise ValueError(f"{unit} is finer than the column")
    if to == "date":
        return F.date_add(x, amount * MICROS[unit] // MICROS["day"])
    return F.timestamp_micros(micros(x) + F.lit(amount * MICROS[unit])).cast(to)


def difference(a: Column, b: Column, unit: str) -> Column:
    """``a - b`` in units, with its fraction."""
    if unit == "nanosecond":
        return (micros(a) - micros(b)).cast("double") * 1000.0
    if unit not in MICROS:
        raise ValueError(f"unknown unit {unit}")
    return (micros(a) - micros(b)).cast("double") / float(MICROS[unit])
