"""Rebuilding conversations from message rows (problem 5).

Method: keyed streaming state with event-time watermarks.  Each micro-batch of the event log is parsed once into
message rows, which are buffered in the state of their session until the watermark (the newest event time seen in
earlier batches less ``LATENESS``) has passed the session's last event by ``IDLE``.  A session that is closed so, or
by the end of the stream, is validated and emitted: its message rows with roles and texts, and a verdict.  A row
behind the watermark is late: it is counted, and it opens its session again, which is emitted anew with a verdict over
all its rows.  The last verdict of a session thus rests on all its rows, however the log is cut into batches.

Spark's own stateful operators drop late rows without a way to get at them, so the state is kept by ``foreachBatch``
as tables below the shared folder, in a folder for each batch that is overwritten if the batch is run again.  State is
rows, never one value for a key: a session with a third of all rows is spread over many tasks.  For validation, rows
are put together by (session, block of ``BLOCK`` sequence numbers), and what spans blocks (turns, runs, the order of
turns) comes from small summaries.

Clocks: a row whose clock is missing, negative or more than ``AHEAD`` ahead of what was seen before counts as coming
now: it is never late.  The newest event time of a batch is the 99th percentile of its clocks, so single clocks far ahead
do not move the watermark.  A wrong clock can only close a session early, never lose a row.

Defined results for odd input: a session stays only if all rules of ``verdicts`` hold; a session without messages is
dropped; rows that are no JSON object belong to no turn but make their session known; a run message without
``runId`` names no run; rows without a session id are no session; rows delivered again count once; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.events import envelope, may_be, parsed_once
from tidewell.runtime import materialise, scratch_path, spread

#: Sequence numbers that are validated together.
BLOCK = 2048
#: Idle time after which a session is closed, and how late rows may come behind the newest event time.
IDLE, LATENESS = "30 days", "10 days"
AHEAD = "365 days"
#: Batches in which the queries work off a log.
BATCHES = 4
#: The speakers of delegated runs (fixed values of the event log).
ROLES = ("manager", "data", "stats", "plot", "report", "review")
KINDS = {"turn_started": "S", "turn_completed": "E", "agent_run_started": "B", "agent_run_finished": "F"}
_DAY_MS = 86_400_000
_ROWS = "session_id string, block bigint, sequence bigint, kind string, turn string, run string, role string, text string, at bigint, seen bigint, late boolean"
_VERDICT = "session_id string, bad boolean"


def _stream_path(spark: SparkSession, path: str) -> str:
    """The path as a file stream takes it: a single file as a pattern that only it matches."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return f"{path[:-1]}[{path[-1]}]"
    return path


def _milliseconds(span: str) -> int:
    n, unit = span.split()
    return int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": _DAY_MS}[unit.rstrip("s")]


def message_rows(events: DataFrame, watermark: int | None) -> DataFrame:
    """One row for each event of a batch, the members that conversations need parsed.

    ``seen`` is the event time ``at``, for rows without a believable clock the watermark; ``late`` says that the event time
    lies before the watermark.
    """
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    message = may_be("payload_json", tuple(KINDS))
    read = parsed_once(events.where(F.col("session_id").isNotNull()), F.when(message, envelope(F.col("payload_json")))).select("session_id", F.col("sequence").cast("bigint").alias("sequence"), "e", F.when(~message, F.col("payload_json")).alias("other"))
    clock = F.coalesce("e.occurredAt", F.regexp_extract("other", r'occurredAt\\*"\s*:\s*(\d{1,15})', 1).try_cast("bigint"))
    at = F.when(clock >= 0, clock)
    kind = F.try_element_at(kinds, F.col("e.type"))
    talk, run = kind.isNotNull(), kind.isin("B", "F")
    mark = F.lit(watermark).cast("bigint")
    return read.select(
        "session_id", F.floor(F.col("sequence") / BLOCK).alias("block"), F.when(talk, F.col("sequence")).alias("sequence"), kind.alias("kind"), F.when(talk, F.col("e.turnId")).alias("turn"), F.when(run, F.col("e.payload.runId")).alias("run"),
        F.when(run, F.col("e.payload.role")).alias("role"), F.when(talk, F.coalesce("e.payload.userMessage", "e.payload.finalText")).alias("text"),
        at.alias("at"), F.when(at > mark + _milliseconds(AHEAD), mark).otherwise(F.coalesce(at, mark)).alias("seen"), F.coalesce(at < mark, F.lit(False)).alias("late"),
    )


@dataclass
class Progress:
    """What a micro-batch did."""

    rows: int
    late: int
    without_clock: int
    closed: int
    revised: int
    watermark: int | None


@dataclass
class Rebuilt:
    """The outcome of a stream: emitted message rows, verdicts of every emission, and the progress of each batch."""

    spark: SparkSession
    root: str
    batches: list[Progress] = field(default_factory=list)
    emitted: list[str] = field(default_factory=list)
    judged: list[str] = field(default_factory=list)
    state: str | None = None

    def read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def verdicts(self) -> DataFrame:
        """(session_id, bad): the last verdict of each session."""
        if len(self.judged) == 1:
            return self.read(self.judged, _VERDICT)
        each = [self.read([p], _VERDICT).withColumn("emission", F.lit(i)) for i, p in enumerate(self.judged)]
        if not each:
            return self.read([], _VERDICT)
        return reduce(DataFrame.unionByName, each).groupBy("session_id").agg(F.max_by("bad", "emission").alias("bad"))

    def dropped(self) -> DataFrame:
        """(session_id) of the sessions that can't be rebuilt."""
        return self.verdicts().where("bad").select("session_id")

    def conversations(self) -> DataFrame:
        """The emitted messages of the sessions that stay: session_id, turn_id, turn_start, sequence, role, text.

        Ordered by (session_id, sequence); ``turn_start`` is the sequence of the turn's user message and groups the
        messages of a turn.  One row per message, so a long session is never one value.
        """
        m = self.read(self.emitted, _ROWS).where(F.col("kind").isNotNull() & F.col("turn").isNotNull())
        role = F.when(F.col("kind") == "S", "user").when(F.col("kind") == "E", "assistant").otherwise(F.col("role"))
        once = m.select("session_id", "sequence", F.col("turn").alias("turn_id"), "kind", role.alias("role"), "text").dropDuplicates(["session_id", "sequence"])
        kept = once.join(self.dropped(), "session_id", "left_anti")
        starts = kept.where("kind = 'S'").groupBy("session_id", "turn_id").agg(F.min("sequence").alias("turn_start"))
        return kept.join(starts, ["session_id", "turn_id"], "left").select("session_id", "turn_id", "turn_start", "sequence", "role", "text")


def rebuild(spark: SparkSession, path: str, idle: str = IDLE, lateness: str = LATENESS, files_per_batch: int | None = None, batches: int | None = None) -> Rebuilt:
    """Run the event files below ``path`` through the stateful operator, in one batch or ``files_per_batch`` at a time.

    With ``batches``, in about that many batches at least: of several files, or, if there are fewer files, of equal parts
    of a file by the places of the rows, which is how an append-only log was written.  The outcome does not depend on the
    batches; ``Rebuilt.batches`` counts the late rows and the sessions emitted again.
    """
    out = Rebuilt(spark, scratch_path(spark, "stream"))
    idle_ms, late_ms = _milliseconds(idle), _milliseconds(lateness)
    table = spark.read.parquet(path).select("session_id", "sequence", "payload_json")
    parts = 1
    if batches:
        files = max(len(table.inputFiles()), 1)
        files_per_batch, parts = max(files // batches, 1), math.ceil(batches / files)
    source = spark.readStream.schema(table.schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)

    def step(batch: DataFrame, number: int) -> None:
        last = batch.agg(F.max("place")).first()[0] if parts > 1 else None
        if last is None:
            advance(batch, str(number))
        else:  # a batch is one file
            for i in range(parts):
                advance(batch.where(F.floor(F.col("place") * parts / F.lit(last + 1)) == i), f"{number}-{i}")

    def advance(batch: DataFrame, number: str) -> None:
        mark = out.batches[-1].watermark if out.batches else None
        arrived = f"{out.root}/arrived/{number}"
        message_rows(spread(batch), mark).write.mode("overwrite").option("compression", "zstd").parquet(arrived)
        new = out.read([arrived], _ROWS)
        n, late, clockless, newest = new.agg(F.count(F.lit(1)), F.count_if("late"), F.count_if(F.col("at").isNull()), F.percentile_approx("at", 0.99, 1000)).first()
        ahead = [x for x in (mark, None if newest is None else newest - late_ms) if x is not None]
        closed = revised = 0
        if out.state is None:
            out.state = arrived
        else:
            closed, revised = _close(out, out.read([out.state, arrived], _ROWS), mark, idle_ms, number)
        out.batches.append(Progress(n, late, clockless, closed, revised, max(ahead) if ahead else None))

    rows = source.parquet(_stream_path(spark, path))
    if parts > 1:
        rows = rows.select("*", F.col("_metadata.row_index").alias("place"))
    query = rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{out.root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    if out.state:  # the end of the stream closes what is open
        _emit(out, out.state, "end")
    return out


def _close(out: Rebuilt, open_rows: DataFrame, mark: int | None, idle_ms: int, number: str) -> tuple[int, int]:
    """Emit the sessions that the watermark has passed; the rest is the new state.  (sessions closed, emitted again)"""
    last = open_rows.groupBy("session_id").agg(F.max("seen").alias("last"))
    shut = materialise(last.where(F.col("last") + idle_ms <= F.lit(mark).cast("bigint")).select("session_id"), "closed")
    emission, state = f"{out.root}/emitted/{number}", f"{out.root}/state/{number}"
    open_rows.join(shut, "session_id", "left_semi").write.mode("overwrite").option("compression", "zstd").parquet(emission)
    open_rows.join(shut, "session_id", "left_anti").write.mode("overwrite").option("compression", "zstd").parquet(state)
    out.state = state
    return shut.count(), _emit(out, emission, number)


def _emit(out: Rebuilt, emission: str, name: str) -> int:
    """Judge the sessions of an emission, with their earlier rows if they were emitted before; how many were."""
    rows, again = out.read([emission], _ROWS), 0
    if out.judged:
        before = materialise(out.read(out.judged, _VERDICT).select("session_id").distinct().join(rows.select("session_id").distinct(), "session_id", "left_semi"), "again")
        again = before.count()
        if again:
            rows = rows.unionByName(out.read(out.emitted, _ROWS).join(before, "session_id", "left_semi"))
    judged = f"{out.root}/judged/{name}"
    verdicts(materialise(_blocks(rows), "blocks")).write.mode("overwrite").parquet(judged)
    out.emitted.append(emission)
    out.judged.append(judged)
    return again


def _blocks(rows: DataFrame) -> DataFrame:
    """(session_id, block, items): the distinct messages of each block of sequence numbers, without texts."""
    item = F.when(F.col("kind").isNotNull(), F.struct("sequence", "kind", "turn", "run", "role"))
    return rows.groupBy("session_id", "block").agg(F.collect_set(item).alias("items"))


def _bad_order(before: Column, now: Column) -> Column:
    """Whether ``now`` may not follow ``before``: a reply follows its own turn's message, a message a reply."""
    reply = (now["kind"] == "E") & ((before["kind"] != "S") | (before["turn"] != now["turn"]))
    return reply | (now["kind"] == "S") & (before["kind"] != "E")


def verdicts(blocks: DataFrame) -> DataFrame:
    """(session_id, bad): whether the session can't be rebuilt.

    A session stays if it has a turn, if every turn with a user message or a reply has exactly one of each, the
    user first, if no turn overlaps another, and if every run has exactly one start and one finish of the same
    known role.  Each rule is a partial verdict per turn, run or block; verdicts are combined per session.
    """
    items = blocks.select("session_id", "block", F.explode("items").alias("i")).select("session_id", "block", "i.*")
    talk = items.where(F.col("kind").isin("S", "E") & F.col("turn").isNotNull())
    started, replied = F.col("kind") == "S", F.col("kind") == "E"
    count = lambda c: F.count_if(c)
    turns = talk.groupBy("session_id", "turn").agg(count(started).alias("s"), count(replied).alias("e"), F.min(F.when(started, F.col("sequence"))).alias("first"), F.min(F.when(replied, F.col("sequence"))).alias("last"))
    turn_bad = turns.select("session_id", (~F.coalesce((F.col("s") == 1) & (F.col("e") == 1) & (F.col("first") < F.col("last")), F.lit(False))).alias("bad"), F.lit(True).alias("turn"))

    runs = items.where(F.col("kind").isin("B", "F") & F.col("run").isNotNull()).groupBy("session_id", "run").agg(
        count(F.col("kind") == "B").alias("b"), count(F.col("kind") == "F").alias("f"), F.min(F.coalesce("role", F.lit(""))).alias("r0"), F.max(F.coalesce("role", F.lit(""))).alias("r1")
    )
    run_bad = runs.select("session_id", (~((F.col("b") == 1) & (F.col("f") == 1) & (F.col("r0") == F.col("r1")) & F.col("r0").isin(*ROLES))).alias("bad"), F.lit(False).alias("turn"))

    own = F.array_sort(F.filter("items", lambda i: i["kind"].isin("S", "E") & i["turn"].isNotNull()))
    merged = blocks.select("session_id", "block", own.alias("o")).where(F.size("o") > 0)
    pairs = F.zip_with(F.slice("o", F.lit(1), F.size("o") - 1), F.slice("o", F.lit(2), F.size("o") - 1), lambda a, b: _bad_order(a, b))
    ends = merged.select("session_id", "block", F.when(F.size("o") > 1, F.exists(pairs, lambda x: x)).otherwise(F.lit(False)).alias("inner_bad"), F.element_at("o", 1).alias("head"), F.element_at("o", -1).alias("tail"))
    before = F.lag("tail").over(Window.partitionBy("session_id").orderBy("block"))  # one row per block
    edge = F.when(F.col("before").isNull(), F.col("head.kind") != "S").otherwise(_bad_order(F.col("before"), F.col("head")))
    block_bad = ends.withColumn("before", before).select("session_id", (F.col("inner_bad") | edge).alias("bad"), F.lit(False).alias("turn"))

    known = blocks.select("session_id", F.lit(False).alias("bad"), F.lit(False).alias("turn"))
    partial = known.unionAll(turn_bad).unionAll(run_bad).unionAll(block_bad)
    return partial.groupBy("session_id").agg(F.max("bad").alias("b"), F.max("turn").alias("t")).select("session_id", (F.col("b") | ~F.col("t")).alias("bad"))
