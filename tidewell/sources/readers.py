"""Reading tables from files and databases."""

from __future__ import annotations

import re
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.convert import to_datetime

_STAMP = re.compile(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?\s*([Zz]|[+-]\d{2}:?\d{2})?$")
#: Rows from which the types of a CSV file are inferred.
SAMPLE_ROWS = 10_000


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", has_header: bool = True, infer_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Quoted fields may hold line ends.  Types come from the first rows; text that looks like a time becomes a
    timestamp without zone, its offset dropped and its clock kept."""
    options = {"sep": delimiter, "header": str(has_header).lower(), "multiLine": "true", "escape": '"', "quote": '"', "mode": "FAILFAST"}
    text = spark.read.options(**options).csv(path)
    sample = text.limit(infer_rows).collect()  # a bounded sample, only for the types
    chosen = []
    for i, name in enumerate(text.columns):
        seen = [r[i] for r in sample if r[i] not in (None, "")]
        c = F.col(f"`{name}`")
        if seen and all(re.fullmatch(r"[+-]?\d{1,18}", v) and not re.match(r"[+-]?0\d", v) for v in seen):
            chosen.append(c.cast("bigint").alias(name))
        elif seen and all(re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v) and not re.match(r"[+-]?0\d", v) for v in seen):
            chosen.append(c.cast("double").alias(name))
        elif seen and all(v.lower() in ("true", "false") for v in seen):
            chosen.append(c.cast("boolean").alias(name))
        elif seen and all(re.fullmatch(r"\d{4}-\d{2}-\d{2}", v) for v in seen):
            chosen.append(c.cast("date").alias(name))
        elif seen and all(_STAMP.match(v) for v in seen):
            chosen.append(to_datetime(c).alias(name))
        else:
            chosen.append(c)
    return text.select(*chosen)


def read_parquet(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return df.select(*columns) if columns else df


def read_files(spark: SparkSession, files: list[str], schema: T.StructType) -> DataFrame:
    """A managed table: its files are listed, never discovered, and its schema is fixed."""
    return spark.read.schema(schema).parquet(*files)


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 16, **properties: str) -> DataFrame:
    """A table of PostgreSQL, MySQL or another JDBC database; with a partition column it is read by many tasks."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**properties)
    if partition_column and bounds:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


_SQLITE = {"INT": T.LongType(), "BIGINT": T.LongType(), "INTEGER": T.LongType(), "REAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType(), "TEXT": T.StringType(), "VARCHAR": T.StringType(), "BLOB": T.BinaryType(), "BOOLEAN": T.BooleanType()}


def sqlite_tables(path: str) -> list[str]:
    with sqlite3.connect(path) as con:
        return [r[0] for r in con.execute("select name from sqlite_master where type in ('table', 'view') order by name")]


def read_sqlite(spark: SparkSession, path: str, table: str, rows_per_part: int = 50_000) -> DataFrame:
    """A table of a SQLite file that all executors can open, read by ranges of ``rowid``.

    Types are those declared; a value of another type is an error, an unknown type too.
    """
    quoted = '"' + table.replace('"', '""') + '"'
    with sqlite3.connect(path) as con:
        info = con.execute(f"pragma table_info({quoted})").fetchall()
        low, high = con.execute(f"select min(rowid), max(rowid) from {quoted}").fetchone()
    if not info:
        raise ValueError(f"no table {table}")
    fields = []
    for _, name, kind, *_ in info:
        base = re.sub(r"\(.*", "", kind.upper()).strip()
        if base not in _SQLITE:
            raise ValueError(f"{name} has the unsupported type {kind}")
        fields.append(T.StructField(name, _SQLITE[base]))
    schema = T.StructType(fields)
    if low is None:
        return spark.createDataFrame([], schema)
    takes = {T.LongType(): int, T.DoubleType(): (int, float), T.StringType(): str, T.BinaryType(): bytes, T.BooleanType(): int}
    kinds = [takes[f.dataType] for f in fields]
    names = [f.name for f in fields]

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for batch in batches:
            for start in batch.column(0).to_pylist():
                with sqlite3.connect(path) as con:
                    got = con.execute(f"select * from {quoted} where rowid >= ? and rowid < ?", (start, start + rows_per_part)).fetchall()
                for row in got:
                    for v, k, n in zip(row, kinds, names):
                        if v is not None and not isinstance(v, k):
                            raise ValueError(f"{n} holds a value of another type: {v!r}")
                cols = [[bool(r[i]) if isinstance(f.dataType, T.BooleanType) and r[i] is not None else float(r[i]) if isinstance(f.dataType, T.DoubleType) and r[i] is not None else r[i] for r in got] for i, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([pa.array(c, {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.StringType(): pa.string(), T.BinaryType(): pa.binary(), T.BooleanType(): pa.bool_()}[f.dataType]) for c, f in zip(cols, fields)], names)

    starts = spark.range(low, high + 1, rows_per_part)
    return starts.repartition(max(1, (high - low) // rows_per_part + 1)).mapInArrow(run, schema)


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """One sheet of a workbook; needs a reader for the format, which is looked for when it is used."""
    import pandas as pd

    try:
        frame = pd.read_excel(path, sheet_name=sheet)
    except ImportError as e:
        raise RuntimeError("reading workbooks needs openpyxl") from e
    return spark.createDataFrame(frame)


def read_arrow(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """An Arrow IPC file."""
    import pyarrow as pa

    with pa.memory_map(path) as source:
        t = pa.ipc.open_file(source).read_all()
    return spark.createDataFrame(t.select(columns) if columns else t)
