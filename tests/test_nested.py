import json

from tidewell.operators import nested as N

SCHEMA = "session_id string, sequence bigint, payload_json string, child string"


def ev(kind, payload, **more):
    return {"sequence": 1, "turnId": "t", "occurredAt": 5, "type": kind, "payload": payload} | more


def wrap(e, n):
    for _ in range(n):
        e = {"type": "agent_run_output", "payload": {"event": e}}
    return e


def test_children_of_all_kinds_and_shapes(spark):
    res = lambda i: {"resource": {"id": i}}
    rows = [
        ("s", 1, json.dumps(ev("turn_started", {"model": {"providerName": "P"}, "resources": [res("a"), None, {"name": 1}]}))),
        ("s", 1, json.dumps(json.dumps(ev("turn_started", {"model": {"providerName": "P"}, "resources": [res("a"), None, {"name": 1}]})))),
        ("s", 2, json.dumps(ev("turn_started", {"model": None, "resources": res("b")}))),
        ("s", 3, json.dumps(wrap(ev("agent_run_finished", {"artifacts": [res("c")], "results": [{"resultId": "r"}, {"resultId": None}, "text"]}), 4))),
        ("s", 4, None), ("s", 5, ""), ("s", 6, "{broken"), ("s", 7, "[1]"), ("s", 8, json.dumps(ev("agent_run_finished", {"results": None, "artifacts": []}))),
        ("s", 9, json.dumps(wrap(ev("turn_started", {"model": {"providerName": "nested"}}), 1))),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = sorted((r["sequence"], r["child"], r["ordinal"], r["child_ref"]) for r in N.child_rows(df).collect())
    assert got == [(1, "model", 0, "P"), (1, "resources", 0, "a"), (1, "resources", 2, ""), (2, "resources", 0, "b"), (3, "artifacts", 0, "c"), (3, "results", 0, "r"), (3, "results", 1, ""), (3, "results", 2, "")]
    tables = N.shred(df)
    assert set(tables) == {"event", "model", "resources", "artifacts", "results"}
    events = tables["event"].collect()
    assert {(r["sequence"], r["depth"]) for r in events} == {(1, 0), (2, 0), *((3, d) for d in range(5)), (4, 0), (5, 0), (6, 0), (7, 0), (8, 0), (9, 0), (9, 1)}
    assert len(events) == 14
    for t in ("model", "resources", "artifacts", "results"):
        assert not tables[t].join(tables["event"], ["session_id", "sequence", "depth"], "left_anti").count()


def test_empty_table(spark):
    assert N.child_rows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_deep_nesting_does_not_recurse():
    e = ev("agent_run_finished", {"results": [{"resultId": "deep"}]})
    text = json.dumps(wrap(e, 150))
    assert [r[3] for r in N.visit(text) if r[0] == "results"] == ["deep"]
