import json
import os
import shutil
import time
from pathlib import Path

import pytest

from tidewell.llm import conversations as C
from tidewell.llm.events import messages

SCHEMA = "session_id string, sequence bigint, payload_json string"


def e(s, q, kind, turn=None, at=1_740_000_000_000, **payload):
    return (s, q, json.dumps({"sequence": q, "sessionId": s, "turnId": turn, "occurredAt": at + q, "type": kind, "payload": payload}))


def turn(s, q, t, **kw):
    return [e(s, q, "turn_started", t, userMessage="u", **kw), e(s, q + 1, "turn_completed", t, finalText="")]


CASES = {
    "good": (turn("good", 1, "a") + turn("good", 5, "b"), False),
    "run": (turn("run", 1, "a") + [e("run", 10, "agent_run_started", "a", runId="r", role="data"), e("run", 11, "agent_run_finished", "a", runId="r", role="data")], False),
    "noturn": ([e("noturn", 1, "session_created"), e("noturn", 2, "turn_failed", "t")], True),
    "noreply": ([e("noreply", 1, "turn_started", "a", userMessage="u")], True),
    "reversed": ([e("reversed", 2, "turn_started", "a"), e("reversed", 1, "turn_completed", "a")], True),
    "two_users": (turn("two_users", 1, "a") + [e("two_users", 9, "turn_started", "a")], True),
    "overlap": ([e("overlap", 1, "turn_started", "a"), e("overlap", 2, "turn_started", "b"), e("overlap", 3, "turn_completed", "a"), e("overlap", 4, "turn_completed", "b")], True),
    "badrole": (turn("badrole", 1, "a") + [e("badrole", 10, "agent_run_started", "a", runId="r", role="chef"), e("badrole", 11, "agent_run_finished", "a", runId="r", role="chef")], True),
    "nofinish": (turn("nofinish", 1, "a") + [e("nofinish", 10, "agent_run_started", "a", runId="r", role="data")], True),
    "roles": (turn("roles", 1, "a") + [e("roles", 10, "agent_run_started", "a", runId="r", role="data"), e("roles", 11, "agent_run_finished", "a", runId="r", role="stats")], True),
    "again": (turn("again", 1, "a") + [("again", 1, json.dumps(turn("again", 1, "a")[0][2]))] + turn("again", 1, "a"), False),
    "far": (turn("far", 1, "a") + turn("far", 5, "b", at=1_780_000_000_000) + [e("far", 20_000, "turn_started", "c"), e("far", 90_000, "turn_completed", "c")], False),
    "noturnid": (turn("noturnid", 1, "a") + [e("noturnid", 9, "turn_started", None)], False),
    "broken": ([("broken", 1, "{no json turn_started"), ("broken", 2, None)], True),
    "": (turn("", 1, "a"), False),
    "wildclock": (turn("wildclock", 1, "a", at=9 * 10**18) + turn("wildclock", 5, "b", at=-(10**15)), False),
    "noclock": ([("noclock", 1, json.dumps({"turnId": "a", "type": "turn_started", "payload": {}})), ("noclock", 2, json.dumps({"turnId": "a", "type": "turn_completed", "payload": []}))], False),
}


def hot():
    rows = []
    for i in range(1500):
        rows += turn("hot", i * 7, f"t{i}")
    return rows + [e("hot", 1500 * 7 + 1, "turn_started", "last"), e("hot", 1500 * 7 + 3000, "turn_completed", "last")]


def test_rules(spark, tmp_path):
    rows = [r for c, _ in CASES.values() for r in c] + hot() + [(None, 1, None)]
    path = str(tmp_path / "ev")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    done = C.rebuild(spark, path)
    assert {r["session_id"] for r in done.dropped().collect()} == {k for k, (_, bad) in CASES.items() if bad}
    kept = done.conversations()
    assert kept.where("session_id = 'again'").count() == 2 and kept.where("session_id = 'hot'").count() == 3002
    assert {r["role"] for r in kept.where("session_id = 'run'").collect()} == {"user", "assistant", "data"}


@pytest.mark.parametrize("files_per_batch", [1, 2, None])
def test_any_batches_give_the_same_with_the_default_lateness(spark, tmp_path, files_per_batch):
    # the first file moves the watermark far beyond the others, which all come late and revise their sessions
    later = turn("later", 1, "a", at=1_700_000_000_000)
    rows = [r for c, _ in CASES.values() for r in c]
    path = str(tmp_path / "ev")
    now = int(time.time() * 1000) - 1000
    for i, part in enumerate([turn("newest", 1, "a", at=now) * 2 + later[:1], *(rows[i::4] + later[1:] * (i == 3) for i in range(4))]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{path}-{i}")
        file = next(Path(f"{path}-{i}").glob("part-*.parquet"))
        Path(path).mkdir(exist_ok=True)
        shutil.copy(file, f"{path}/{i}.parquet")
        os.utime(f"{path}/{i}.parquet", (now / 1000 - 100 + i * 10,) * 2)
    done = C.rebuild(spark, path, files_per_batch=files_per_batch)
    assert {r["session_id"] for r in done.dropped().collect()} == {k for k, (_, bad) in CASES.items() if bad}
    assert sum(b.rows for b in done.batches) == len(rows) + 6
    assert done.conversations().where("session_id = 'again'").count() == 2
    if files_per_batch == 1:
        assert len(done.batches) == 5 and sum(b.late for b in done.batches) > 10 and sum(b.revised for b in done.batches) > 3


def test_the_queries_work_off_a_single_file_in_batches(spark, tmp_path, monkeypatch):
    """The watermark closes sessions while the log is read, and what comes late revises their verdicts."""
    from tidewell.llm.queries import p5_conversations, p5_found

    month = 31 * 24 * 3_600_000
    rows = [r for i in range(40) for r in turn(f"s{i}", 1, "a", at=1_740_000_000_000 + i * month)]
    rows[60:60] = [e("s0", 9, "turn_started", "b")]  # s0 was sound when it was closed
    rows[70:70] = turn("s1", 9, "b", at=1_740_000_000_000 + month)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "log"))
    shutil.copy(next((tmp_path / "log").glob("part-*.parquet")), tmp_path / "assistant_event.parquet")
    runs, rebuild = [], C.rebuild
    monkeypatch.setattr(C, "rebuild", lambda *a, **k: runs.append(rebuild(*a, **k)) or runs[-1])
    assert {r["session_id"] for r in p5_found(spark, str(tmp_path)).collect()} == {"s0"}
    kept = p5_conversations(spark, str(tmp_path))
    assert kept.count() == 2 * 39 + 2 and kept.where("session_id = 's1'").count() == 4
    for run in runs:
        assert len(run.batches) == C.BATCHES and sum(b.rows for b in run.batches) == len(rows)
        assert sum(b.closed for b in run.batches) > 10 and sum(b.late for b in run.batches) >= 3 and sum(b.revised for b in run.batches) >= 1


def test_clocks_far_ahead_or_missing_are_not_late(spark):
    at = [2_900_000_000_000, 5, 9_999, 10_001]
    rows = spark.createDataFrame([e("s", i, "turn_started", "a", at=a - i) for i, a in enumerate(at)] + [("s", 4, "{}")], SCHEMA)
    got = C.message_rows(rows, 10_000).collect()
    assert sorted((r["seen"], r["late"]) for r in got) == [(5, True), (9_999, True), (10_000, False), (10_000, False), (10_001, False)]


def test_a_type_written_with_escapes_is_a_message(spark):
    text = json.dumps({"turnId": "a", "type": "turn_started", "payload": {"userMessage": "u"}}).replace("turn_started", "turn\\u005fstarted")
    assert messages(spark.createDataFrame([("s", 1, text)], SCHEMA), ("turn_started",)).count() == 1


def test_empty_table_and_single_file(spark, tmp_path):
    path = str(tmp_path / "none")
    spark.createDataFrame([], SCHEMA).coalesce(1).write.parquet(path)
    assert C.rebuild(spark, path).dropped().count() == 0
    one = tmp_path / "one"
    spark.createDataFrame(turn("s", 1, "a"), SCHEMA).coalesce(1).write.parquet(str(one))
    file = str(tmp_path / "single.parquet")
    shutil.copy(next(one.glob("part-*.parquet")), file)
    assert C.rebuild(spark, file).dropped().count() == 0


def test_messages_keep_all_rows_on_demand(spark):
    df = spark.createDataFrame([("s", 1, None), ("s", 2, "[]")], SCHEMA)
    assert messages(df, ("turn_started",), True).count() == 2 and messages(df, ("turn_started",)).count() == 0
