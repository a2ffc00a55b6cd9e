"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.select import columns_of

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def free_name(name: str, taken: set[str], suffix: str = "") -> str:
    """The name with its suffix, and _2, _3 ... after that as long as it is taken."""
    base = name if name not in taken else name + suffix
    out, i = base, 2
    while out in taken:
        out, i = f"{base}_{i}", i + 1
    return out


def join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner", right_suffix: str = "_right") -> DataFrame:
    """Equi-join that keeps both sides' keys.  Keys need the same type; null keys never match.

    The physical strategy is Catalyst's: a side below the broadcast threshold is broadcast by its real size, larger
    ones are merged with skew handling at run time.
    """
    types_l, types_r = dict(left.dtypes), dict(right.dtypes)
    for a, b in keys:
        if types_l[a] != types_r[b]:
            raise ValueError(f"{a} is {types_l[a]} and {b} is {types_r[b]}")
    taken = set(left.columns)
    names = {}
    if how not in ("semi", "anti"):
        for c in right.columns:
            names[c] = free_name(c, taken, right_suffix)
            taken.add(names[c])
    inner = {c: f"__r{i}" for i, c in enumerate(right.columns)}
    r = right.select(*[F.col(f"`{c}`").alias(inner[c]) for c in right.columns])
    on: Column = F.lit(True)
    for a, b in keys:
        on = on & (left[f"`{a}`"] == r[inner[b]])
    joined = left.join(r, on, KINDS[how])
    if not names:
        return joined
    return joined.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(inner[c]).alias(names[c]) for c in right.columns])


def concat_rows(frames: list[DataFrame], column_match: str = "by_name") -> DataFrame:
    """All rows of all frames; columns of one name need one type, absent ones are null."""
    out = frames[0]
    for f in frames[1:]:
        a, b = dict(out.dtypes), dict(f.dtypes)
        if column_match == "by_position":
            if [t for _, t in out.dtypes] != [t for _, t in f.dtypes]:
                raise ValueError("the frames differ in the number or types of their columns")
            out = out.union(f)
        else:
            if any(a[c] != b[c] for c in a.keys() & b.keys()):
                raise ValueError("columns of one name differ in type")
            out = out.unionByName(f, allowMissingColumns=True)
    return out


def concat_columns(df: DataFrame, groups: list[list[Column]], names: list[list[str]]) -> DataFrame:
    """Side by side, for columns over one row domain; repeated names get _2, _3 ..."""
    taken: set[str] = set()
    picked = []
    for columns, own in zip(groups, names):
        for c, n in zip(columns, own):
            name = free_name(n, taken)
            taken.add(name)
            picked.append(c.alias(name))
    return df.select(*picked)


def deduplicate(df: DataFrame, keys: list[str] | None = None, keep: str = "first", order: list[str] = ()) -> DataFrame:
    """One row per key: the first or last in ``order``, or (``none``) only rows whose key is unique; nulls are equal.

    First and last are taken by an aggregate that combines before the shuffle, so a hot key sends one row per task.
    """
    names = columns_of(df, list(keys or df.columns))
    if keep == "none" or order:
        key = [F.col(f"`{n}`") for n in names]
        every = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        if keep == "none":
            return df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.any_value(every).alias("__r")).where("__n = 1").select("__r.*")
        at = F.struct(*[F.col(f"`{o}`").isNull().alias(f"n{i}") if j == 0 else F.col(f"`{o}`").alias(f"v{i}") for i, o in enumerate(order) for j in (0, 1)])
        pick = F.min_by if keep == "first" else F.max_by
        return df.groupBy(*key).agg(pick(every, at).alias("__r")).select("__r.*")
    if set(names) == set(df.columns):
        return df.distinct()
    raise ValueError("first and last need an order")


def row_numbers(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Dense positions from 0 in a global order, without a window over all rows in one task.

    The rows are range-partitioned and sorted; each partition's rows are counted, and the (few) partition counts
    give the offsets.
    """
    from tidewell.runtime import materialise

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id()), "positions")
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    offset = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per partition
    return placed.join(counts.select("__part", "__first", offset.alias("__offset")), "__part").withColumn(name, F.col("__id") - F.col("__first") + F.col("__offset")).drop("__part", "__id", "__first", "__offset")
