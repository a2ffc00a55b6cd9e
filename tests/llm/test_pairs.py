import json

import pytest

from tidewell.llm import pairs as P
from tidewell.llm.language import language_of

LONG = "The median of arm_code was 751, while the upper quartile reached 7809. "


@pytest.mark.parametrize(
    ("message", "answer", "want"),
    [
        ("How many rows?", None, "empty"), ("How many rows?", "", "empty"), ("How many rows?", " ​—…", "empty"), ("How many rows?", "42", None), ("How many rows?", "depth_m 12.5 %", None), ("How?", "because of", "truncated"), ("ok", "OK!", "copied"),
        ("How many rows?", LONG, None), ("How many rows?", LONG + "and the results also show that the", "truncated"), ("q " * 9, LONG + "```\nfor row in resu", "truncated"),
        ("How do I run it on the table?", LONG + "```\nx\n```", None), ("How?", LONG + "\n- a: 1\n- b: 2", None), ("How?", LONG + "\n- a: 1\n- b: 2\n- c", "truncated"), ("How?", LONG + "The column x holds 4,", "truncated"),
        ("How?", "I'm sorry, but I can't help with that request.", "refusal"), ("如何？", "很抱歉，我无法协助处理这个请求。", "refusal"), ("How?", "> As an assistant I must decline to work on x. Please ask something else.", "refusal"),
        ("How?", "I cannot reject the null hypothesis for x, since the interval covers zero.", None), ("How?", "I'm sorry for the wait. " + LONG, None),
        ("Plot fare_cents over time, please.", "PLOT  FARE_CENTS over time, please", "copied"), ("Plot fare_cents over time, please.", "As you asked: Plot fare_cents over time, please.", "copied"),
        ("Plot fare_cents over time, please.", "Plot fare_cents over time, please.\nPlot fare_cents over time, please.", "copied"), ("Plot fare_cents over time, please.", "Plot fare_cents over time, please. " + LONG, None),
        ("Which rows have a missing value?", "Die Gruppen von x unterscheiden sich nicht, und der Median lag bei 4.", "wrong_language"), ("Which rows have a missing value? Please answer in German.", "Die Gruppen von x unterscheiden sich nicht, und der Median lag bei 4.", None),
        ("Which rows have a missing value?", "The groups differ in the median. Die Gruppen von x unterscheiden sich nicht.", None), ("哪些行缺少值？", "De las filas de la tabla, la columna está completa.", "wrong_language"), ("哪些行缺少值？请用西班牙文回答。", "De las filas de la tabla, la columna está completa.", None),
        (None, LONG, None),
    ],
)
def test_rules(message, answer, want):
    assert P.defect_of(message, answer, False, False, False, False) == want


def test_codes_and_signals():
    assert P.defect_of("q", LONG, True, False, False, False) == "truncated" and P.defect_of("q", LONG, False, True, False, False) == "refusal"
    assert P.defect_of("q", "", True, False, False, False) == "empty" and P.defect_of("q", LONG, False, False, True, False) == "truncated"


def test_languages():
    assert [language_of(s) for s in ("The table has no rows and is empty.", "Die Tabelle ist nicht leer und hat keine Zeilen.", "Les lignes de la table ne sont pas vides.", "Las filas de la tabla no están vacías y son buenas.", "这个表没有行。", "表の行はありません。", "В таблице нет строк.", "42", "depth_m 816")] == ["en", "de", "fr", "es", "zh", "ja", "ru", None, None]


def event(s, q, kind, t, **payload):
    return (s, q, json.dumps({"turnId": t, "type": kind, "payload": payload}), "clash")


SCHEMA = "session_id string, sequence bigint, payload_json string, final_text string"


def test_pairs_from_events(spark):
    u = "Which rows of the table have a missing value?"
    full = "The report lists the model, its assumptions and 4 cases. It grew by 45.25 percent after all of it."
    rows = [
        event("s", 1, "turn_started", "ok", userMessage=u), event("s", 2, "turn_completed", "ok", finalText=full),
        event("s", 3, "turn_started", "short", userMessage=u), event("s", 4, "turn_completed", "short", finalText=full[: full.index("45.") + 3]),
        event("s", 5, "turn_started", "code", userMessage=u), event("s", 6, "agent_run_finished", "code", role="manager", failureCode="provider_content_filtered"), event("s", 7, "turn_completed", "code", finalText=full),
        event("s", 8, "turn_started", "other", userMessage=u), event("s", 9, "agent_run_finished", "other", role="data", failureCode="provider_content_filtered"), event("s", 10, "turn_completed", "other", finalText=full),
        event("s", 11, "turn_started", "null", userMessage=u), event("s", 12, "turn_completed", "null", finalText=None),
        event("s", 13, "turn_started", "twice", userMessage=u), event("s", 14, "turn_completed", "twice", finalText=""), event("s", 15, "turn_completed", "twice", finalText=""),
        event("s", 16, "turn_started", None, userMessage=u), event("s", 17, "turn_completed", None, finalText=""), ("s", 18, None, None), ("s", 19, "turn_completed {", None),
    ]
    again = [rows[10], (rows[11][0], rows[11][1], json.dumps(rows[11][2]), None)]
    df = spark.createDataFrame(rows + again, SCHEMA)
    got = {r["turn_id"]: r["defect"] for r in P.defective_pairs(df).collect()}
    assert got == {"short": "truncated", "code": "refusal", "null": "empty"}
    assert P.defective_pairs(df.limit(0)).count() == 0


def test_shortened_versions_over_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        base = [" ".join(chr(97 + (i * 7 + j * j) % 26) * 2 for j in range(12)) + " and more words follow here." for i in range(26)]
        texts = ["First one. " + b for b in base] + ["Another. " + b[:29] + "," for b in base] + [b.replace("here.", "here. And then") for b in base] + ["It is 45.", "It is 45.25 now.", "- a: 1\n- b: 2", "- b: 25.", "x_y 1", "x_y 12."]
        df = spark.createDataFrame([(t,) for t in texts], "final_text string")
        got = {r["core"] for r in P.shortened_versions(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == {b[:29] for b in base} | {"It is 45."}


def test_length_limits(spark):
    rows = [("x" * 99 + "y",)] * 30 + [("x" * n,) for n in range(40, 200)] + [("x" * 149 + ".",)] * 50
    assert [r["n_chars"] for r in P.length_limits(spark.createDataFrame(rows, "final_text string")).collect()] == [100]
