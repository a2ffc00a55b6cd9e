"""Queries of the general training-data problems (2 and 4) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import nested, smallfiles
from tidewell.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files to consolidate."""
    return smallfiles.split_packing(table(spark, sf_dir, "dataset_files")).select("generation_id", "ordinal")


def p2_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files to write: one row per combined split."""
    files = smallfiles.split_packing(table(spark, sf_dir, "dataset_files"))
    return files.groupBy("generation_id", "target_file").agg(F.count(F.lit(1)).alias("n_files"), F.sum("row_count").alias("row_count"), F.sum("size_bytes").alias("size_bytes"), F.min("ordinal").alias("first_ordinal"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files before and after per generation, and whether its rows add up."""
    return smallfiles.generation_report(table(spark, sf_dir, "dataset_files"), table(spark, sf_dir, "generations"))


def p2_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the consolidated files, read back from what was written."""
    files = smallfiles.rewritten(table(spark, sf_dir, "file_rows"), table(spark, sf_dir, "dataset_files"))
    return files.select("row_id", "generation_id", F.col("target_file").cast("bigint").alias("target_file"), "path", "ordinal_in_file", "plot", "reading", "note")


def p2_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of the physical files of ``file_rows``, read back from their consolidated copy."""
    return smallfiles.compacted(spark, f"{sf_dir}/file_rows.parquet").select("row_id", "path", "ordinal_in_file", "plot", "reading", "note")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every child of every event."""
    return nested.child_rows(table(spark, sf_dir, "assistant_event"))


def p4_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of events, one row per event and depth."""
    return nested.shred(table(spark, sf_dir, "assistant_event"), tags=("event",), with_payload=False)["event"].select("session_id", "sequence", "depth", "turn_id", "occurred_at", "type")


QUERIES = {f.__name__: f for f in (p2_found, p2_plan, p2_report, p2_files, p2_compacted, p4_found, p4_events)}

_FILES = r"""
WITH spelt AS (
  SELECT generation_id, ordinal, row_count, size_bytes,
         regexp_replace(regexp_replace(regexp_replace(replace(path, '\', '/'), '(^|/)(\./)+', '\1', 'g'), '[^/]+/\.\./', '', 'g'), '//+', '/', 'g') AS place
  FROM dataset_files),
files AS (
  SELECT * FROM spelt QUALIFY row_number() OVER (PARTITION BY generation_id, place ORDER BY ordinal) = 1),
small AS (
  SELECT * FROM files WHERE size_bytes >= 0 AND size_bytes < 1048576
  QUALIFY count(*) OVER (PARTITION BY generation_id) >= 2),
packed AS (
  SELECT *, CAST(floor(coalesce(sum(size_bytes + cost) OVER (PARTITION BY generation_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 134217728) AS BIGINT) AS target_file
  FROM (SELECT *, greatest(least(CAST(sum(size_bytes) OVER g AS BIGINT) // (8 * count(*) OVER g), 4194304), 4096) AS cost FROM small WINDOW g AS (PARTITION BY generation_id)))
"""

_EVENTS = """
WITH RECURSIVE raw AS (
  SELECT session_id, sequence, CASE WHEN json_type(payload_json) = 'VARCHAR' THEN CAST(json_extract_string(payload_json, '$') AS JSON) ELSE CAST(payload_json AS JSON) END AS e
  FROM assistant_event),
once AS (SELECT session_id, sequence, any_value(e) AS e FROM raw GROUP BY ALL),
nested AS (
  SELECT session_id, sequence, 0 AS depth, e FROM once
  UNION ALL
  SELECT session_id, sequence, depth + 1, json_extract(e, '$.payload.event') FROM nested
  WHERE json_extract_string(e, '$.type') = 'agent_run_output' AND json_type(e, '$.payload.event') = 'OBJECT')
"""

SQL = {
    "p2_found": _FILES + "SELECT generation_id, ordinal FROM packed",
    "p2_plan": _FILES + "SELECT generation_id, target_file, count(*) AS n_files, CAST(sum(row_count) AS BIGINT) AS row_count, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, min(ordinal) AS first_ordinal FROM packed GROUP BY ALL",
    "p2_report": _FILES
    + """, f AS (SELECT generation_id, count(*) AS files_before, CAST(coalesce(sum(row_count), 0) AS BIGINT) AS known_rows, count(*) FILTER (row_count IS NULL) AS unknown_files FROM files GROUP BY 1),
    k AS (SELECT generation_id, count(*) AS n, count(DISTINCT target_file) AS m FROM packed GROUP BY 1),
    g AS (SELECT id, max(row_count) AS row_count FROM generations GROUP BY 1)
    SELECT f.generation_id, files_before, files_before - coalesce(n, 0) + coalesce(m, 0) AS files_after, known_rows, unknown_files, g.row_count,
           CASE WHEN unknown_files > 0 THEN 'unknown' WHEN known_rows = g.row_count THEN 'exact' ELSE 'differs' END AS status
    FROM f LEFT JOIN k USING (generation_id) LEFT JOIN g ON g.id = f.generation_id""",
    "p2_files": _FILES + "SELECT r.row_id, p.generation_id, p.target_file, r.path, r.ordinal_in_file, r.plot, r.reading, r.note FROM file_rows r JOIN packed p ON p.place = r.path",
    "p2_compacted": "SELECT row_id, path, ordinal_in_file, plot, reading, note FROM file_rows",
    "p4_found": _EVENTS
    + """, held AS (
      SELECT session_id, sequence, json_extract(e, '$.payload.' || m.child) AS v, m.child FROM nested,
        (VALUES ('resources', 'turn_started'), ('artifacts', 'agent_run_finished'), ('results', 'agent_run_finished')) AS m(child, kind)
      WHERE json_extract_string(e, '$.type') = m.kind AND (m.kind = 'agent_run_finished' OR depth = 0)),
    arrays AS (
      SELECT session_id, sequence, child, CASE WHEN json_type(v) = 'ARRAY' THEN CAST(v AS JSON[]) ELSE [v] END AS a FROM held WHERE json_type(v) IN ('ARRAY', 'OBJECT')),
    elements AS (SELECT session_id, sequence, child, unnest(a) AS x, unnest(range(len(a))) AS ordinal FROM arrays)
    SELECT session_id, sequence, child, CAST(ordinal AS BIGINT) AS ordinal, coalesce(json_extract_string(x, CASE child WHEN 'results' THEN '$.resultId' ELSE '$.resource.id' END), '') AS child_ref
    FROM elements WHERE json_type(x) <> 'NULL'
    UNION ALL
    SELECT session_id, sequence, 'model', 0, coalesce(json_extract_string(e, '$.payload.model.providerName'), '') FROM nested
    WHERE depth = 0 AND json_extract_string(e, '$.type') = 'turn_started' AND json_type(e, '$.payload.model') = 'OBJECT'""",
    "p4_events": _EVENTS
    + """SELECT session_id, sequence, CAST(depth AS INTEGER) AS depth, max(json_extract_string(e, '$.turnId')) OVER w AS turn_id, max(CAST(json_extract_string(e, '$.occurredAt') AS BIGINT)) OVER w AS occurred_at, json_extract_string(e, '$.type') AS type
    FROM nested WINDOW w AS (PARTITION BY session_id, sequence)""",
}
