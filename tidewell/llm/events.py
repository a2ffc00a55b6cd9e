"""Reading the assistant event log: envelope fields as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of the envelope and its payload that the operators on conversations use.
ENVELOPE = "turnId string, occurredAt bigint, type string, payload struct<userMessage:string,finalText:string,runId:string,role:string,failureCode:string>"


def may_be(column: str, types: tuple[str, ...]) -> Column:
    """Whether a JSON text can hold one of the types: it has the name, or escapes that may spell it."""
    text = F.col(column)
    possible = text.contains("\\u00")
    for t in types:
        possible = possible | text.contains(t)
    return possible


def envelope(payload_json: Column) -> Column:
    """The envelope as a struct; JSON wrapped in a JSON string is unwrapped; null if there is no object."""
    wrapped = F.ltrim(payload_json).startswith('"')
    text = F.when(wrapped, F.get_json_object(F.concat(F.lit('{"x":'), payload_json, F.lit("}")), "$.x")).otherwise(payload_json)
    return F.from_json(text, ENVELOPE)


def parsed_once(rows: DataFrame, value: Column, name: str = "e") -> DataFrame:
    """Adds a parsed column.  It goes through a generator, because the optimizer would repeat the parsing in every later
    expression and filter that uses a part of it."""
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))


def messages(events: DataFrame, types: tuple[str, ...], also_others: bool = False) -> DataFrame:
    """(session_id, sequence, turn_id, at, type, user_message, final_text, run_id, role, failure_code).

    Only events of ``types`` have members parsed; with ``also_others`` the other rows come with null members.
    Texts that cannot hold one of the types are not parsed at all.
    """
    e = events.select("session_id", F.col("sequence").cast("bigint").alias("sequence"), "payload_json", may_be("payload_json", types).alias("possible"))
    if not also_others:
        e = e.where("possible")
    e = parsed_once(e, F.when(F.col("possible"), envelope(F.col("payload_json"))))
    e = e.withColumn("e", F.when(F.col("e.type").isin(*types), F.col("e")))
    if not also_others:
        e = e.where(F.col("e").isNotNull())
    p = "e.payload."
    return e.select(
        "session_id", "sequence", F.col("e.turnId").alias("turn_id"), F.col("e.occurredAt").alias("at"), F.col("e.type").alias("type"),
        F.col(p + "userMessage").alias("user_message"), F.col(p + "finalText").alias("final_text"), F.col(p + "runId").alias("run_id"),
        F.col(p + "role").alias("role"), F.col(p + "failureCode").alias("failure_code"),
    )
