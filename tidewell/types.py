"""Meanings of columns: what a column stands for decides which operators take it.

A meaning is kept beside the frame (see ``relation``), because Spark drops field metadata on derived columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

NUMERIC, CATEGORICAL, ORDINAL, BINARY, DATETIME, TEXT, IDENTIFIER = "Numeric", "Categorical", "Ordinal", "Binary", "Datetime", "Text", "Identifier"
KINDS = (NUMERIC, CATEGORICAL, ORDINAL, BINARY, DATETIME, TEXT, IDENTIFIER)
#: More levels are no categories.
MOST_LEVELS = 65_536


class MeaningError(ValueError):
    """An operator got a column whose meaning it does not take."""


@dataclass(frozen=True)
class Meaning:
    """``levels``: the declared values, for Ordinal from lowest to highest; ``positive``: the Binary value that counts as true."""

    kind: str
    levels: tuple = field(default=())
    positive: object = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise MeaningError(f"unknown meaning {self.kind}")
        if len(set(self.levels)) != len(self.levels) or len(self.levels) > MOST_LEVELS:
            raise MeaningError("levels must be distinct and at most 65,536")
        if self.kind == BINARY and self.levels and len(self.levels) != 2:
            raise MeaningError("a Binary column has exactly two levels")

    def with_levels(self, levels: tuple) -> Meaning:
        return replace(self, levels=tuple(levels))


def infer(data_type: T.DataType) -> Meaning:
    """The default meaning, from the physical type only."""
    if isinstance(data_type, T.BooleanType):
        return Meaning(BINARY, (False, True), True)
    if isinstance(data_type, T.NumericType):
        return Meaning(NUMERIC)
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return Meaning(DATETIME)
    if isinstance(data_type, T.StringType):
        return Meaning(TEXT)
    return Meaning(IDENTIFIER)


def require(meaning: Meaning, *kinds: str, what: str = "column") -> None:
    if meaning.kind not in kinds:
        raise MeaningError(f"{what} is {meaning.kind}; needed is {' or '.join(kinds)}")


#: Which meanings a physical type can carry.
def admits(meaning: Meaning, data_type: T.DataType) -> bool:
    if meaning.kind == NUMERIC:
        return isinstance(data_type, T.NumericType)
    if meaning.kind == DATETIME:
        return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))
    if meaning.kind == TEXT:
        return isinstance(data_type, T.StringType)
    return not isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)) or meaning.kind == IDENTIFIER
