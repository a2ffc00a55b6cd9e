"""Joins that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Copies of each row of the key-unique side; a hot key is spread over so many tasks.
SALTS = 32


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[Column], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join ``left`` to a ``right`` side that has one row per key, spreading each key over ``salts`` tasks.

    ``spread`` are expressions over the left side that differ among the rows of one key.  The right side is
    repeated ``salts`` times, which is cheap as it has one small row per key.
    """
    salt = "__salt"
    left = left.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, salt], how).drop(salt)
