"""Edited tables: immutable base files with patches, inserted rows and tombstones, merged when read.

Rows are known by ``row_id``; ``display_order`` gives their place.  Patches are long: (row_id, column, value as
text, is_null).  Edits are small against the base, so the base is scanned once, never rewritten; rows without
edits go through a left join whose small side Spark broadcasts by its real size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID, ORDER = "row_id", "display_order"


def merge(base: DataFrame, patches: DataFrame | None = None, inserted: DataFrame | None = None, deleted: DataFrame | None = None) -> DataFrame:
    """The table as edited: patched cells win, deleted rows are gone, inserted rows are there."""
    df = base.unionByName(inserted) if inserted is not None else base
    if deleted is not None:
        df = df.join(deleted.select(ID).distinct(), ID, "left_anti")
    if patches is not None:
        types = dict(df.dtypes)
        cells = [c for c in df.columns if c not in (ID, ORDER)]
        wide = patches.groupBy(ID).agg(*[F.max(F.when(F.col("column") == c, F.struct(F.lit(1).alias("set"), F.when(~F.col("is_null"), F.col("value")).alias("v")))).alias(f"__p_{c}") for c in cells])
        df = df.join(wide, ID, "left")
        df = df.select(*[F.when(F.col(f"__p_{c}").isNotNull(), F.col(f"__p_{c}.v").cast(types[c])).otherwise(F.col(f"`{c}`")).alias(c) if c in cells else F.col(c) for c in base.columns])
    return df.select(*base.columns)


def cell_edits(base: DataFrame, edits: list[tuple[int, str, object]]) -> DataFrame:
    """Patches for (row id, column, value); the columns have to exist and the value to fit its type."""
    types = {f.name: f.dataType for f in base.schema.fields}
    rows = []
    for row, column, value in edits:
        if column not in types or column in (ID, ORDER):
            raise ValueError(f"no editable column {column}")
        if value is not None and isinstance(types[column], T.NumericType):
            float(value)
        rows.append((row, column, None if value is None else str(value), value is None))
    return base.sparkSession.createDataFrame(rows, f"{ID} bigint, column string, value string, is_null boolean")


def insert_rows(base: DataFrame, rows: list[dict], after: float | None = None) -> DataFrame:
    """Rows to insert, with new ids above all others and places after the given one (at the end if None)."""
    got = base.agg(F.max(ID).alias("i"), F.max(ORDER).alias("o")).first()
    start, place = (got["i"] or 0) + 1, after if after is not None else (got["o"] or 0.0)
    step = 1.0 if after is None else 1.0 / (len(rows) + 1)
    data = [tuple(start + k if f.name == ID else float(place + (k + 1) * step) if f.name == ORDER else r.get(f.name) for f in base.schema.fields) for k, r in enumerate(rows)]
    return base.sparkSession.createDataFrame(data, base.schema)


def delete_rows(base: DataFrame, ids: list[int]) -> DataFrame:
    return base.sparkSession.createDataFrame([(i,) for i in ids], f"{ID} bigint")


def cast_column(df: DataFrame, column: str, to: str, force: bool = False) -> DataFrame:
    """Lossless: a value that would change or not fit is an error, or null with ``force``."""
    c = F.col(f"`{column}`")
    new = c.try_cast(to)
    kept = new.isNotNull() & (new.cast(dict(df.dtypes)[column]) == c)
    bad = F.lit(None).cast(to) if force else F.raise_error(F.concat(F.lit(f"{column} has no exact {to}: "), c.cast("string"))).cast(to)
    return df.withColumn(column, F.when(c.isNull(), None).when(kept, new).otherwise(bad))


def compact(df: DataFrame, path: str) -> DataFrame:
    """A new generation of base files holding the merged table in its order."""
    df.repartitionByRange(ORDER).sortWithinPartitions(ORDER).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
