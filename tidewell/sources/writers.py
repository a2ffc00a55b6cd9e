"""Writing tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, order: list[str] = (), mode: str = "error") -> None:
    """ZSTD; rows are sorted within files by the order columns, so that row groups can be skipped by range."""
    ordered = df.sortWithinPartitions(*order) if order else df
    ordered.write.mode(mode).option("compression", "zstd").parquet(path)


def export_csv(df: DataFrame, path: str, order: list[str] = (), single: bool = True) -> None:
    """With a header even for an empty table.  One file needs one task; ``single=False`` writes one per partition."""
    ordered = df.orderBy(*[F.col(f"`{o}`").asc_nulls_last() for o in order]) if order else df
    (ordered.coalesce(1) if single else ordered).write.option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def export_parquet(df: DataFrame, path: str, order: list[str] = ()) -> None:
    (df.orderBy(*[F.col(f"`{o}`").asc_nulls_last() for o in order]) if order else df).write.option("compression", "zstd").parquet(path)


def write_arrow(df: DataFrame, path: str) -> None:
    """One Arrow IPC file, batch by batch through the driver."""
    import pyarrow as pa

    t = df.toArrow()
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, t.schema) as writer:
        writer.write_table(t)


def visit_rows(df: DataFrame) -> Iterator[object]:
    """The rows one after another; one partition at a time is on the driver."""
    return df.toLocalIterator(prefetchPartitions=True)


def numeric_columns(df: DataFrame, columns: list[Column | str]) -> DataFrame:
    """The columns as doubles; a null or non-finite value is an error when it is reached."""
    from tidewell.functions.guards import operand

    return df.select(*[operand(c).alias(c if isinstance(c, str) else f"c{i}") for i, c in enumerate(columns)])
