"""Consolidating many tiny files into few well-sized ones (problem 2).

Method: engine split packing.  Files are packed in catalogue order into splits of at most ``target_bytes``,
where every file also costs some bytes for being opened, as Spark's own file scan does it.  The cost is tuned for each
generation: an eighth of the mean size of its small files, but no less than ``LEAST_OPEN_COST``, which bounds the files
of a split, and no more than ``OPEN_COST``.  A full split is thus close to the target in bytes, whatever the size of
its files.  Physical files are read through such combined splits, coalesced without a shuffle, written to a staging
folder, verified and only then moved to their place.

Defined results for odd input
-----------------------------
* A repeated catalogue row counts once; rows of one generation whose paths lead to the same place are one
  file, given by its lowest ordinal.
* A null path leads nowhere: such rows are told apart by their ordinals.
* A null or negative size is unknown; such files are left where they are.  Size 0 is known.
* An empty catalogue gives an empty plan.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.runtime import scratch_path

#: A file below this size is small.
SMALL_BYTES = 1 << 20
#: Aim for files of this size.
TARGET_BYTES = 128 << 20
#: What opening a file costs at most, in bytes that could be read in that time (Spark's own default), and at least.
OPEN_COST, LEAST_OPEN_COST = 4 << 20, 4 << 10
#: Catalogue ordinals in one block of the prefix sums.
BLOCK_ROWS = 100_000


def canonical_path(path: Column) -> Column:
    """The path with ``/`` as separator and without empty, ``.`` and ``..`` segments.

    A leading scheme (``s3://``) or root slash is kept; ``..`` above the start of a relative path is kept too.
    Pure ``Column`` expression; plain paths skip the segment-by-segment part.
    """
    slashed = F.translate(path, "\\", "/")
    head = F.regexp_extract(slashed, r"^([A-Za-z][A-Za-z0-9+.\-]+:/+|/+)", 1)
    rest = F.substring(slashed, F.length(head) + F.lit(1), F.length(slashed))
    last = lambda acc: F.element_at(acc, -1)
    kept = F.aggregate(
        F.split(rest, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "") | (s == "."), acc)
        .when((s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((s == "..") & (F.length(head) > 0) & (F.size(acc) == 0), acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    odd = slashed.rlike(r"//|(^|/)\.{1,2}(/|$)|/$")
    return F.when(odd, F.concat(head, F.concat_ws("/", kept))).otherwise(slashed)


def distinct_files(catalogue: DataFrame) -> DataFrame:
    """One row per generation and place: (generation_id, place, ordinal, path, row_count, size_bytes)."""
    place = F.coalesce(canonical_path(F.col("path")), F.concat(F.lit("\0"), F.col("ordinal").cast("string")), F.lit("\0"))
    kept = F.min(F.struct("ordinal", "path", "row_count", "size_bytes")).alias("f")
    return catalogue.groupBy("generation_id", place.alias("place")).agg(kept).select("generation_id", "place", "f.*")


def split_packing(catalogue: DataFrame, small_bytes: int = SMALL_BYTES, target_bytes: int = TARGET_BYTES, open_cost: int | None = None) -> DataFrame:
    """The files to consolidate, each with the number of the combined split (``target_file``) it goes to.

    A file takes part if its size is known and below ``small_bytes`` and its generation has another such file.  A null
    ``open_cost`` is tuned for each generation.  Columns: generation_id, ordinal, place, row_count, size_bytes, target_file.

    Files are summed up within blocks of ``BLOCK_ROWS`` ordinals, so a generation with any share of the files is spread
    over tasks; only one row for each block is ordered by generation.
    """
    small = distinct_files(catalogue).where((F.col("size_bytes") >= 0) & (F.col("size_bytes") < small_bytes))
    small = small.withColumn("__key", F.coalesce("generation_id", F.lit("\0")))
    # files without an ordinal come first, by place
    small = small.withColumn("__block", F.coalesce(F.floor(F.col("ordinal") / BLOCK_ROWS), F.lit(-(2**63)).cast("bigint")))
    small = small.repartition("__key", "__block")
    totals = small.groupBy("__key", "__block").agg(F.count(F.lit(1)).alias("__n"), F.sum("size_bytes").alias("__bytes"))
    whole, before = Window.partitionBy("__key"), Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    files, size = F.sum("__n").over(whole), F.sum("__bytes").over(whole)
    cost = F.lit(open_cost) if open_cost is not None else F.greatest(F.least(F.expr("__size div (8 * __files)"), F.lit(OPEN_COST)), F.lit(LEAST_OPEN_COST))
    totals = totals.select("__key", "__block", files.alias("__files"), size.alias("__size"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__bytes0"))
    totals = totals.where("__files >= 2").withColumn("__cost", cost.cast("bigint"))
    within = Window.partitionBy("__key", "__block").orderBy("ordinal", "place").rowsBetween(Window.unboundedPreceding, -1)
    placed = small.withColumn("__b", F.coalesce(F.sum("size_bytes").over(within), F.lit(0))).withColumn("__r", F.count(F.lit(1)).over(within)).join(totals, ["__key", "__block"])
    start = F.col("__bytes0") + F.col("__b") + (F.col("__n0") + F.col("__r")) * F.col("__cost")
    return placed.select("generation_id", "ordinal", "place", "row_count", "size_bytes", F.floor(start / F.lit(target_bytes)).alias("target_file"))


def generation_report(catalogue: DataFrame, generations: DataFrame, **packing: int) -> DataFrame:
    """Per generation the files before and after, and whether its rows add up to ``generations.row_count``.

    ``status``: ``exact``, ``unknown`` (some file has no row count) or ``differs``.
    """
    files = distinct_files(catalogue).groupBy("generation_id").agg(
        F.count(F.lit(1)).alias("files_before"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("known_rows"), F.count_if(F.col("row_count").isNull()).alias("unknown_files")
    )
    packed = split_packing(catalogue, **packing).groupBy("generation_id").agg(F.count(F.lit(1)).alias("packed_files"), F.count_distinct("target_file").alias("packed_into"))
    stored = generations.groupBy(F.col("id").alias("generation_id")).agg(F.max("row_count").alias("row_count"))
    joined = files.join(packed, "generation_id", "left").join(stored, "generation_id", "left")
    after = F.col("files_before") - F.coalesce("packed_files", F.lit(0)) + F.coalesce("packed_into", F.lit(0))
    status = F.when(F.col("unknown_files") > 0, "unknown").when(F.col("known_rows") == F.col("row_count"), "exact").otherwise("differs")
    return joined.select("generation_id", "files_before", after.alias("files_after"), "known_rows", "unknown_files", "row_count", status.alias("status"))


def rewrite_records(records: DataFrame, catalogue: DataFrame, out: str, **packing: int) -> DataFrame:
    """Write the records of the packed files as consolidated files below ``out`` and return a scan of them.

    ``records`` has a ``path`` in canonical spelling.  Each record goes to the split of its file; a split is at
    most one target size, so no task gets more than one output file's worth of rows, however large the
    generation.  Records are written to ``out/_staging`` first; number and content hash are compared with
    what went in before the folder is moved, and an error leaves ``out`` untouched.
    """
    spark = records.sparkSession
    plan = split_packing(catalogue, **packing).select("generation_id", "target_file", F.col("ordinal").alias("file_ordinal"), F.col("place").alias("path"))
    placed = records.join(plan, "path")
    names = [c for c in records.columns]
    digest = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*names).cast("decimal(38,0)")).alias("h")).first()
    staged = f"{out}/_staging"
    ordered = placed.repartition("generation_id", "target_file").sortWithinPartitions("generation_id", "target_file", "file_ordinal")
    ordered.drop("file_ordinal").write.option("compression", "zstd").partitionBy("generation_id", "target_file").parquet(staged)
    written = spark.read.parquet(staged)
    if digest(written) != digest(placed):
        raise RuntimeError("the consolidated files differ from their sources; nothing was published")
    _move(spark, staged, f"{out}/files")
    return spark.read.parquet(f"{out}/files")


def compact_folder(spark: SparkSession, source: str | list[str], out: str, fmt: str = "parquet", target_bytes: int = TARGET_BYTES, open_cost: int | None = None) -> dict[str, int]:
    """Rewrite physical files: combined splits in, one well-sized file per split out, no shuffle.

    The scan packs files into splits of ``target_bytes`` with the tuned cost of opening one, each split is one task and
    one output file.  The settings are those of a session of its own, so other queries keep theirs.  The staged output is
    verified (rows and content hash) and moved to ``out``.  Returns files and rows before and after.
    """
    own = spark.newSession()
    paths = [source] if isinstance(source, str) else source
    if open_cost is None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        summary = [path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path(p)) for p in paths]
        open_cost = max(min(sum(x.getLength() for x in summary) // (8 * max(sum(x.getFileCount() for x in summary), 1)), OPEN_COST), LEAST_OPEN_COST)
    for k, v in {"maxPartitionBytes": target_bytes, "openCostInBytes": open_cost, "minPartitionNum": 1}.items():
        own.conf.set(f"spark.sql.files.{k}", str(v))
    df = own.read.format(fmt).load(paths)
    splits = max(1, df.rdd.getNumPartitions())
    staged = f"{out}/_staging"
    df.coalesce(splits).write.format(fmt).save(staged)
    new = own.read.format(fmt).schema(df.schema).load(staged)
    digest = lambda x: x.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*x.columns).cast("decimal(38,0)")).alias("h")).first()
    old_digest, new_digest = digest(df), digest(new)
    if old_digest != new_digest:
        raise RuntimeError("the consolidated files differ from their sources; nothing was published")
    counts = {"files_before": len(df.inputFiles()), "files_after": len(new.inputFiles()), "rows": new_digest["n"]}
    _move(spark, staged, f"{out}/files")
    return counts


def compacted(spark: SparkSession, source: str) -> DataFrame:
    """The rows of ``source`` read back from its consolidated copy in a new folder of the shared root."""
    out = scratch_path(spark, "compacted")
    compact_folder(spark, source, out)
    return spark.read.parquet(f"{out}/files")


def _move(spark: SparkSession, source: str, target: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path(target)) or not fs.rename(path(source), path(target)):
        raise RuntimeError(f"{source} can't be moved to {target}")


def rewritten(records: DataFrame, catalogue: DataFrame, **packing: int) -> DataFrame:
    """``rewrite_records`` into a new folder of the shared root."""
    return rewrite_records(records, catalogue, scratch_path(records.sparkSession, "files"), **packing)
