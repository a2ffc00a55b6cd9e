"""Text functions; positions count characters from 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim(x: Column) -> Column:
    """Without the blanks at both ends; tabs stay."""
    return F.btrim(x)


lower, upper = F.lower, F.upper


def replace(x: Column, old: str, new: str) -> Column:
    if not old:
        raise ValueError("replace needs a text to look for")
    return F.replace(x, F.lit(old), F.lit(new))


def substring(x: Column, start: int, length: int) -> Column:
    if start < 1 or length < 0:
        raise ValueError("substring starts at 1 or later and has no negative length")
    return F.substring(x, start, length)


def split_part(x: Column, separator: str, part: int) -> Column:
    """A negative part counts from the end; a part that is not there is empty."""
    if not separator or part == 0:
        raise ValueError("split_part needs a separator and a part other than 0")
    return F.split_part(x, F.lit(separator), F.lit(part))


def concatenate(parts: list[Column], separator: str = "") -> Column:
    """Null if any part is null."""
    if len(parts) < 2:
        raise ValueError("concatenate takes at least two parts")
    woven = [parts[0]]
    for p in parts[1:]:
        woven += [F.lit(separator), p]
    return F.concat(*[w.cast("string") for w in woven])
