"""Queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import conversations, garbled, leaks, pairs, quantiles, tokens
from tidewell.runtime import materialise, table

MEASURES = ["sepal_length", "petal_length"]
FRACTIONS = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def _day_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantiles.distinct_samples(table(spark, sf_dir, "iris").select("sample_id", "species", "measured_on", *MEASURES))
    return quantiles.digests(rows, ["species", "measured_on"], MEASURES)


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per species, put together from the digests of single days."""
    days = materialise(_day_digests(spark, sf_dir), "digests")
    return quantiles.percentiles(quantiles.merge(days, ["species"]), ["species"], FRACTIONS)


def p1_daily_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians per species and day, from the same digests."""
    return quantiles.percentiles(_day_digests(spark, sf_dir), ["species", "measured_on"], [0.5])


def p1_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the stated bound holds for digests that compress (k = 24), counted over all values."""
    k = 24
    rows = quantiles.distinct_samples(table(spark, sf_dir, "iris").select("sample_id", "species", "measured_on", *MEASURES))
    days = materialise(quantiles.digests(rows, ["species", "measured_on"], MEASURES, k), "digests")
    got = quantiles.percentiles(quantiles.merge(days, ["species"], k), ["species"], FRACTIONS, k)
    values = quantiles.finite_values(rows, ["species"], MEASURES).withColumnRenamed("species", "s").withColumnRenamed("measure", "m")
    both = got.join(values, F.col("species").eqNullSafe(F.col("s")) & (F.col("measure") == F.col("m")))
    upto, below = F.count_if(F.col("x") <= F.col("value")), F.count_if(quantiles.node_of(F.col("x")) < quantiles.node_of(F.col("value")))
    counted = both.groupBy("species", "measure", "p", "n", "rank_error").agg(upto.alias("upto"), below.alias("below"), F.count(F.lit(1)).alias("rows"))
    return counted.select("species", "measure", "p", "n", ((F.col("rows") == F.col("n")) & (F.col("upto") >= F.col("p") * F.col("n") - 1e-6) & (F.col("below") <= F.col("p") * F.col("n") + F.col("rank_error"))).alias("holds"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defective pair with its defect."""
    return pairs.defective_pairs(table(spark, sf_dir, "assistant_event"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions to drop."""
    return conversations.rebuild(spark, f"{sf_dir}/assistant_event.parquet", batches=conversations.BATCHES).dropped()


def p5_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of all sessions that can be rebuilt."""
    return conversations.rebuild(spark, f"{sf_dir}/assistant_event.parquet", batches=conversations.BATCHES).conversations()


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the evaluation items it leaks."""
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks with the words they share and whether the whole item is there."""
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled documents."""
    return garbled.restore(table(spark, sf_dir, "documents")).select("doc_id")


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled documents with the text restored and the chains that did it."""
    return garbled.restore(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (p1_percentiles, p1_daily_medians, p1_bound, p3_found, p5_found, p5_conversations, p6_ids, p7_found, p7_report, p8_found, p8_restored)}

_CELLS = """
WITH once AS (SELECT species, measured_on, sepal_length, petal_length FROM iris QUALIFY row_number() OVER (PARTITION BY sample_id) = 1),
long AS (
  SELECT species, measured_on, 'sepal_length' AS measure, sepal_length AS x FROM once UNION ALL
  SELECT species, measured_on, 'petal_length', petal_length FROM once),
finite AS (SELECT *, CASE WHEN x = 0 THEN 0 ELSE floor(log2(abs(x))) END AS g FROM long WHERE x IS NOT NULL AND isfinite(x)),
scaled AS (SELECT *, CASE WHEN x = 0 THEN 0 WHEN pow(2, g) > abs(x) THEN g - 1 WHEN abs(x) / pow(2, g) >= 2 THEN g + 1 ELSE g END AS e FROM finite),
cells AS (SELECT *, CASE WHEN x = 0 THEN 0 ELSE floor((abs(x) / pow(2, e) - 1) * 4096) END AS c FROM scaled)
"""


def _ranked(keys: str, fractions: list[float]) -> str:
    ps = ", ".join(f"({p})" for p in fractions)
    return f"""{_CELLS}, ranked AS (
      SELECT {keys}, measure, x, max(x) OVER (PARTITION BY {keys}, measure, sign(x), e, c) AS high,
             row_number() OVER (PARTITION BY {keys}, measure ORDER BY x) AS r, count(*) OVER (PARTITION BY {keys}, measure) AS n FROM cells)
    SELECT {keys}, measure, CAST(p AS DOUBLE) AS p, n, high AS value, CAST(floor(n / {quantiles.K}) * 24 AS BIGINT) AS rank_error
    FROM ranked, (VALUES {ps}) AS f(p) WHERE r = greatest(CAST(ceil(round(CAST(p AS DOUBLE) * n, 6)) AS BIGINT), 1)"""


_MESSAGES = """
WITH raw AS (
  SELECT session_id, sequence, CASE WHEN json_type(payload_json) = 'VARCHAR' THEN CAST(json_extract_string(payload_json, '$') AS JSON) ELSE CAST(payload_json AS JSON) END AS e
  FROM assistant_event),
m AS (
  SELECT session_id, sequence, any_value(json_extract_string(e, '$.type')) AS type, any_value(json_extract_string(e, '$.turnId')) AS turn, any_value(json_extract_string(e, '$.payload.runId')) AS run,
         any_value(json_extract_string(e, '$.payload.role')) AS role, any_value(coalesce(json_extract_string(e, '$.payload.userMessage'), json_extract_string(e, '$.payload.finalText'))) AS text
  FROM raw GROUP BY ALL),
turns AS (
  SELECT session_id, turn, count(*) FILTER (type = 'turn_started') AS s, count(*) FILTER (type = 'turn_completed') AS f,
         min(sequence) FILTER (type = 'turn_started') AS a, min(sequence) FILTER (type = 'turn_completed') AS b
  FROM m WHERE type IN ('turn_started', 'turn_completed') AND turn IS NOT NULL GROUP BY ALL),
runs AS (
  SELECT session_id, run, count(*) FILTER (type = 'agent_run_started') AS s, count(*) FILTER (type = 'agent_run_finished') AS f, min(coalesce(role, '')) AS r0, max(coalesce(role, '')) AS r1
  FROM m WHERE type IN ('agent_run_started', 'agent_run_finished') AND run IS NOT NULL GROUP BY ALL),
dropped AS (
  SELECT session_id FROM m WHERE session_id NOT IN (SELECT session_id FROM turns)
  UNION SELECT session_id FROM turns WHERE NOT (s = 1 AND f = 1 AND a < b)
  UNION SELECT session_id FROM (SELECT session_id, a, lag(b) OVER (PARTITION BY session_id ORDER BY a) AS p FROM turns WHERE a IS NOT NULL AND b IS NOT NULL) WHERE p > a
  UNION SELECT session_id FROM runs WHERE NOT (s = 1 AND f = 1 AND r0 = r1 AND r0 IN ('manager', 'data', 'stats', 'plot', 'report', 'review')))
"""

#: Exact while no group has twice K rows (sf0.01): up to that size a digest has nothing to compress.
SQL = {
    "p1_percentiles": _ranked("species", FRACTIONS),
    "p1_bound": _CELLS + f"SELECT species, measure, CAST(p AS DOUBLE) AS p, count(*) AS n, true AS holds FROM cells, (VALUES {', '.join(f'({p})' for p in FRACTIONS)}) AS f(p) GROUP BY ALL",
    "p5_found": _MESSAGES + "SELECT session_id FROM dropped",
    "p5_conversations": _MESSAGES
    + """SELECT m.session_id, m.turn AS turn_id, t.a AS turn_start, m.sequence, CASE type WHEN 'turn_started' THEN 'user' WHEN 'turn_completed' THEN 'assistant' ELSE role END AS role, text
    FROM m LEFT JOIN turns t ON t.session_id = m.session_id AND t.turn = m.turn
    WHERE type IN ('turn_started', 'turn_completed', 'agent_run_started', 'agent_run_finished') AND m.turn IS NOT NULL AND m.session_id NOT IN (SELECT session_id FROM dropped)""",
    "p1_daily_medians": _ranked("species, measured_on", [0.5]),
}
