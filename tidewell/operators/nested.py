"""Flattening deeply nested records into related tables (problem 4).

Method: single-pass tagged emission.  A depth-first visitor goes through each record once and emits rows of
(table tag, primary key, parent key, position, payload); the rows are written partitioned by tag, and each
table is read back with its own schema.

Defined results for odd input
-----------------------------
* Text that is not JSON, is null or empty, or whose top level is no object gives no row but an ``event`` row with
  a null type, so that no record is lost.  A JSON string that holds JSON is read as what it holds.
* A null element of an array is no child but keeps its position; an object in place of an array is one child
  at position 0; an absent or null reference is the empty string; other scalars are children without reference.
* A record delivered again (same key) counts once.  Further columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.runtime import scratch_path, spread

#: Child tables: tag, types of the event that has them, member, whether several, path of the reference.
CHILDREN = (
    ("model", "turn_started", "model", False, ("providerName",)),
    ("resources", "turn_started", "resources", True, ("resource", "id")),
    ("artifacts", "agent_run_finished", "artifacts", True, ("resource", "id")),
    ("results", "agent_run_finished", "results", True, ("resultId",)),
)
#: The event that wraps another one, and the types that count inside it.
WRAPPER, WRAPPED = "agent_run_output", frozenset({"agent_run_finished"})

_EMITTED = "tag string, session_id string, sequence bigint, depth int, ordinal bigint, ref string, turn_id string, occurred_at bigint, type string, payload string"


def _load(text: str | None) -> object:
    """The JSON value in a text, also if it is wrapped in JSON strings; None if there is none."""
    value: object = text
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return None
    return value


def _reference(child: object, path: tuple[str, ...]) -> str:
    for name in path:
        child = child.get(name) if isinstance(child, dict) else None
    return "" if child is None else child if isinstance(child, str) else json.dumps(child, ensure_ascii=False)


def visit(text: str | None, with_payload: bool = True, children: tuple = CHILDREN) -> Iterator[tuple]:
    """Depth first through one record: (tag, depth, ordinal, ref, turn_id, occurred_at, type, payload)."""
    event = _load(text)
    depth, turn, at = 0, None, None
    if not isinstance(event, dict):
        yield "event", 0, 0, "", None, None, None, text if with_payload else None
        return
    while isinstance(event, dict):
        kind, payload = event.get("type"), event.get("payload")
        kind = kind if isinstance(kind, str) else None
        if depth == 0:
            turn, at = event.get("turnId"), event.get("occurredAt")
            turn, at = (turn if isinstance(turn, str) else None), (at if isinstance(at, int) and not isinstance(at, bool) else None)
        yield "event", depth, 0, "", turn, at, kind, json.dumps(payload, ensure_ascii=False, sort_keys=True) if with_payload and kind != WRAPPER and payload is not None else None
        if not isinstance(payload, dict):
            return
        if depth == 0 or kind in WRAPPED:
            for tag, owner, member, many, path in children:
                if owner != kind:
                    continue
                value = payload.get(member)
                if isinstance(value, list) and many:
                    found = enumerate(value)
                elif isinstance(value, dict):
                    found = enumerate([value])
                else:
                    continue
                for i, child in found:
                    if child is not None:
                        yield tag, depth, i, _reference(child, path), turn, at, kind, json.dumps(child, ensure_ascii=False, sort_keys=True) if with_payload else None
        if kind != WRAPPER:
            return
        event, depth = payload.get("event"), depth + 1


def emit(records: DataFrame, tags: tuple[str, ...] | None = None, with_payload: bool = True) -> DataFrame:
    """The tagged rows of all records (``session_id, sequence, payload_json``); with ``tags`` only those tables."""
    wanted = frozenset(tags) if tags else None
    names = ["tag", "depth", "ordinal", "ref", "turn_id", "occurred_at", "type", "payload"]
    types = {"tag": pa.string(), "depth": pa.int32(), "ordinal": pa.int64(), "ref": pa.string(), "turn_id": pa.string(), "occurred_at": pa.int64(), "type": pa.string(), "payload": pa.string()}
    order = [x.split()[0] for x in _EMITTED.split(", ")]
    children = tuple(c for c in CHILDREN if wanted is None or c[0] in wanted)
    quick = None if wanted is None or "event" in wanted else tuple({c[1] for c in children})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            source: list[int] = []
            for i, text in enumerate(batch.column(2).to_pylist()):
                if quick is not None and (text is None or "\\u00" not in text and not any(q in text for q in quick)):
                    continue  # none of the wanted tables can come from this record
                for row in visit(text, with_payload, children):
                    if wanted is None or row[0] in wanted:
                        source.append(i)
                        for column, value in zip(rows, row):
                            column.append(value)
            at = pa.array(source, pa.int64())
            columns = {n: pa.array(v, types[n]) for n, v in zip(names, rows)} | {"session_id": batch.column(0).take(at), "sequence": batch.column(1).take(at)}
            yield pa.RecordBatch.from_arrays([columns[n] for n in order], order)

    return spread(records.select("session_id", F.col("sequence").cast("bigint"), "payload_json")).mapInArrow(run, _EMITTED)


def shred(records: DataFrame, tags: tuple[str, ...] | None = None, with_payload: bool = True) -> dict[str, DataFrame]:
    """Write the tagged rows partitioned by tag and return each table with its schema.

    Every child carries the key of its event (``session_id, sequence``) and the depth at which it was found.
    Rows are made unique by their keys, so repeated delivery of a record changes nothing; keys are spread by
    ``sequence``, so a session with any share of the rows is no hot key.
    """
    spark, path = records.sparkSession, scratch_path(records.sparkSession, "shred")
    emit(records, tags, with_payload).write.partitionBy("tag").option("compression", "zstd").parquet(path)
    schema = ", ".join(x for x in _EMITTED.split(", "))
    stored = spark.read.schema(schema).parquet(path)
    key = ["session_id", "sequence"]
    tables = {}
    for tag in tags or ("event", *(c[0] for c in CHILDREN)):
        own = stored.where(F.col("tag") == tag)
        if tag == "event":
            tables[tag] = own.groupBy(*key, "depth").agg(F.max_by(F.struct("turn_id", "occurred_at", "type", "payload"), F.coalesce(F.length("payload"), F.lit(0))).alias("e")).select(*key, "depth", "e.*")
        else:
            columns = [F.col("ref").alias("child_ref"), "turn_id", *(["payload"] if with_payload else [])]
            tables[tag] = own.dropDuplicates([*key, "depth", "ordinal"]).select(*key, "depth", "ordinal", *columns)
    return tables


def child_rows(records: DataFrame) -> DataFrame:
    """All children of all records in one table: session_id, sequence, child, ordinal, child_ref."""
    tags = tuple(c[0] for c in CHILDREN)
    spark, path = records.sparkSession, scratch_path(records.sparkSession, "shred")
    emit(records, tags, with_payload=False).write.partitionBy("tag").option("compression", "zstd").parquet(path)
    stored = spark.read.schema(_EMITTED).parquet(path)
    unique = stored.dropDuplicates(["session_id", "sequence", "tag", "depth", "ordinal"])
    return unique.select("session_id", "sequence", F.col("tag").alias("child"), "ordinal", F.col("ref").alias("child_ref"))
