"""Defective prompt and response pairs (problem 3).

Method: the sentences of all responses are sorted by text and the last sentence of each response is compared with its
neighbour, which begins with the whole of it if the response is a shortened version; lengths at which far more responses
break off than at the lengths around them are length limits; then copy, refusal and language rules are applied to each
pair.

Defined results for odd input: events delivered again count once; a turn without exactly one ``turn_started``
and one ``turn_completed`` is no pair; a null, empty, blank or sign-only answer is ``empty``; a null message has
no language and copies nothing; an empty table gives no rows; further columns are ignored.  Each pair has at
most one defect, in the order empty, truncated and refusal by failure code, copied, refusal, truncated,
wrong_language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.events import messages
from tidewell.llm.language import languages_of

#: Codes of the manager's run that settle a defect (fixed values of the event log).
TRUNCATED_CODE, FILTERED_CODE = "provider_output_truncated", "provider_content_filtered"
#: A length is a limit if so many times more unfinished answers have it than one and the mean of the lengths around it.
SPIKE_TIMES, SPIKE_REACH = 8, 4

_BLANK = "​‌‍⁠﻿­"
_EDGE = re.compile(rf"^[\s{_BLANK}]+|[\s{_BLANK}]+$")
_WORDLIKE = re.compile(r"[^\W_]")
_ITEM = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s+\S")
_VALUE = re.compile(r":\s*\S+$")
#: A bare fact, which needs no end mark: a name alone, or with a value.
_FACT = re.compile(r"[\w.-]+(?:[ :：=]+[-+]?[\d.,]+\s?%?)?")
_STOPS = ".!?。！？…｡؟"
_CLOSERS = "\"'”’»)]）】」』*_~`"
#: Words after which no answer ends.
_CONNECTORS = frozenset("and or the a an of to in on for with by that which because so as und oder der die das dass mit von für weil et ou le la les de des que pour avec parce y o el los las del para con porque".split())
#: What a sentence that declines says, by language; a sentence about a rejected hypothesis is none.
_DECLINES = re.compile(
    r"\b(?:i|assistant)\b.{0,30}\b(?:can['’]?t|cannot|can not|unable|not able|won['’]t be able|must decline|have to decline|decline to|refuse|have to pass|not allowed|not permitted)\b"
    r"|\bnot something i(?:['’]m| am)\b|\b(?:guidelines|policy|policies|rules)\b.{0,20}\b(?:do|does) not (?:permit|allow)|\bno comment\b|\bbeyond what i (?:may|can)\b|\bi(?:['’]d| would) rather not\b"
    r"|\bkann ich\b.{0,30}\bnicht\b.{0,20}\b(?:helfen|beantworten|antworten|bearbeiten)|\bdarf ich\b.{0,30}\bnicht\b|\bmuss (?:ich )?ablehnen\b|\bmöchte ich mich nicht\b|\bich kann\b.{0,30}\bnicht (?:helfen|beantworten|antworten)"
    r"|\bje ne peux pas\b|\bje préfère ne pas\b|\bimpossible de donner suite\b|\bdépasse ce que j['’]ai le droit|\bje ne suis pas (?:autorisé|en mesure)|\bje dois (?:refuser|décliner)"
    r"|\bno puedo (?:ayudar|responder|atender|continuar)|\bprefiero no\b|\bno me está permitido\b|\bfuera de lo que puedo\b|\bdebo (?:rechazar|declinar)"
    r"|\bnão posso (?:ajudar|responder)|\bprefiro não\b|\bnão me é permitido\b|не могу (?:помочь|ответить)|вынужден отказ|не вправе"
    r"|无法(?:协助|回答|处理|帮助|提供)|不能(?:继续)?(?:回答|协助|帮助)|超出了我.{0,10}范围|不便(?:发表|回答|评论)|拒绝回答|お答えできません|お手伝いできません|回答を控え|対応できません",
    re.I,
)
_NO_DECLINE = re.compile(r"hypothes|原假设|hipótesis|hypothès|null|reject|verw(?:orf|erf)|rechaz|rejet", re.I)
_REFERS = re.compile(r"^\W*(?:please\b|bitte\b|veuillez\b|consulte\b|por favor\b|请|adressez\b|i['’]m sorry|sorry\W*$|je suis désolé|lo siento|es tut mir leid|unfortunately|很?抱歉|对不起)", re.I)
_NOTE = re.compile(r"^[\s>⚠️!*_#-]*(?:\*\*[^*\n]{1,20}\*\*)?[\s>:⚠️*_#-]*")
_SENTENCES = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*|\n+")
#: Language names as they are asked for, with the words that ask.
_ASKED = [
    (code, re.compile(rf"(?:{asks})", re.I))
    for code, asks in {
        "en": r"\b(?:in|auf|en|em|into)\s+(?:english|englisch|anglais|inglés|inglês)\b|用英[文语語]|英语回答|英語で|по-английски",
        "de": r"\b(?:in|auf|en|em|into)\s+(?:german|deutsch|allemand|alemán|alemão)\b|用德[文语語]|德语回答|ドイツ語で|по-немецки",
        "fr": r"\b(?:in|auf|en|em|into)\s+(?:french|französisch|français|francés|francês)\b|用法[文语語]|法语回答|フランス語で|по-французски",
        "es": r"\b(?:in|auf|en|em|into)\s+(?:spanish|spanisch|espagnol|español|espanhol)\b|用西班牙[文语語]|スペイン語で|по-испански",
        "zh": r"\b(?:in|auf|en|em|into)\s+(?:chinese|chinesisch|chinois|chino|chinês)\b|用[中汉漢][文语語]|用华语|中国語で|по-китайски",
        "pt": r"\b(?:in|auf|en|em|into)\s+(?:portuguese|portugiesisch|portugais|portugués|português)\b|用葡萄牙[文语語]|ポルトガル語で",
        "ja": r"\b(?:in|auf|en|em|into)\s+(?:japanese|japanisch|japonais|japonés|japonês)\b|用日[文语語]|日本語で",
        "ru": r"\b(?:in|auf|en|em|into)\s+(?:russian|russisch|russe|ruso|russo)\b|用俄[文语語]|ロシア語で|по-русски",
    }.items()
]


def stripped(text: str) -> str:
    """Without white space and invisible signs at its ends."""
    return _EDGE.sub("", text)


def is_empty(answer: str | None) -> bool:
    return not answer or not _WORDLIKE.search(answer)


def is_unfinished(answer: str) -> bool:
    """Whether the text breaks off: an open code block, an item or sentence without its end."""
    s = stripped(answer)
    if _FACT.fullmatch(s):
        return s.lower() in _CONNECTORS
    if s.count("```") % 2:
        return True
    if s.endswith("```"):
        return False
    lines = s.split("\n")
    last = lines[-1].strip()
    bare = last.rstrip(_CLOSERS)
    if not bare or bare[-1] in _STOPS:
        return False
    if last.startswith("|"):
        return not last.endswith("|")
    if _ITEM.match(last):
        others = [x for x in lines[:-1] if _ITEM.match(x)]
        if others and sum(bool(_VALUE.search(x.strip())) for x in others) > len(others) / 2:
            return not _VALUE.search(last)
        return bare[-1] in ",;:，；：、—-(" or bare.split()[-1].lower() in _CONNECTORS
    if (s[0], s[-1]) in (("(", ")"), ("[", "]"), ("“", "”"), ('"', '"'), ("«", "»")) or s.startswith("--") and s.endswith("--"):
        return False
    return True


def is_refusal(answer: str) -> bool:
    """Whether every sentence declines or sends the user elsewhere, and one declines."""
    declined = False
    for s in _SENTENCES.split(stripped(answer)):
        s = _NOTE.sub("", s)
        if not _WORDLIKE.search(s):
            continue
        if _DECLINES.search(s) and not _NO_DECLINE.search(s):
            declined = True
        elif not _REFERS.search(s):
            return False
    return declined


def _plain(text: str) -> str:
    return re.sub(r"[\W_]+", "", text.casefold())


def is_copy(message: str, answer: str) -> bool:
    """Whether the answer is the message again, in whatever marks and spacing, once or more, or after a lead-in."""
    a, b = _plain(message), _plain(answer)
    if not a or len(b) < len(a):
        return False
    if len(b) % len(a) == 0 and b == a * (len(b) // len(a)):
        return True
    lead = len(b) - len(a)
    return b.endswith(a) and lead <= 30 and bool(re.match(r"[^:：\n]{1,40}[:：]", stripped(answer)))


def is_wrong_language(message: str, answer: str) -> bool:
    """Whether the answer as a whole is in a language neither used nor asked for in the message."""
    found = languages_of(answer)
    if not found:
        return False
    used = languages_of(message)
    asked = {code for code, pattern in _ASKED if pattern.search(message)}
    if not used and not asked:
        return False
    allowed = set(used) | asked
    return not any(x in allowed for x in found)


def defect_of(message: str | None, answer: str | None, truncated_code: bool, filtered_code: bool, shortened: bool, at_limit: bool) -> str | None:
    """The one defect of a pair, or None."""
    if is_empty(answer):
        return "empty"
    if truncated_code:
        return "truncated"
    if filtered_code:
        return "refusal"
    if message and is_copy(message, answer):
        return "copied"
    if is_refusal(answer):
        return "refusal"
    if shortened or is_unfinished(answer) or at_limit and stripped(answer)[-1] not in _STOPS + _CLOSERS and not _FACT.fullmatch(stripped(answer)):
        return "truncated"
    if message and is_wrong_language(message, answer):
        return "wrong_language"
    return None


def turn_pairs(events: DataFrame) -> DataFrame:
    """(session_id, turn_id, user_message, final_text, truncated_code, filtered_code) of every pair."""
    m = messages(events, ("turn_started", "turn_completed", "agent_run_finished")).where(F.col("turn_id").isNotNull())
    started, completed = F.col("type") == "turn_started", F.col("type") == "turn_completed"
    manager = (F.col("type") == "agent_run_finished") & (F.col("role") == "manager")
    m = m.where(started | completed | manager & F.col("failure_code").isin(TRUNCATED_CODE, FILTERED_CODE))
    text = F.when(started, F.struct("sequence", F.col("user_message").alias("text")))
    reply = F.when(completed, F.struct("sequence", F.col("final_text").alias("text")))
    grouped = m.groupBy("session_id", "turn_id").agg(
        F.min(F.when(started, F.col("sequence"))).alias("s0"), F.max(F.when(started, F.col("sequence"))).alias("s1"),
        F.min(F.when(completed, F.col("sequence"))).alias("e0"), F.max(F.when(completed, F.col("sequence"))).alias("e1"),
        F.max(text).alias("u"), F.max(reply).alias("f"),
        F.coalesce(F.max(manager & (F.col("failure_code") == TRUNCATED_CODE)), F.lit(False)).alias("truncated_code"),
        F.coalesce(F.max(manager & (F.col("failure_code") == FILTERED_CODE)), F.lit(False)).alias("filtered_code"),
    )
    one = grouped.where("s0 = s1 and e0 = e1")
    return one.select("session_id", "turn_id", F.col("u.text").alias("user_message"), F.col("f.text").alias("final_text"), "truncated_code", "filtered_code")


#: Where a response is cut into sentences, what a cut leaves at the end, and last sentences that may end anywhere.
_CUT, _REST, _ANYWHERE = r"(?<=[.!?])\s+|(?<=[。！？])\s*|\n+", r"[\s,;:，；：、(（\[…–—-]+$", r"^\s*(?:[-*+•]|\d+[.)])\s|^\||```|^[\w.-]+[ :：=]*[-+]?[\d.,]*\s?%?$"


def _sentences(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``sentences`` and ``core``: the last sentence without loose ends if it has no end mark, else null."""
    sentences = F.filter(F.transform(F.split("final_text", _CUT), lambda x: F.trim(x)), lambda x: x != "")
    rows = pairs.withColumn("sentences", F.array_distinct(sentences))
    last = F.try_element_at("sentences", F.lit(-1))
    core = F.regexp_replace(last, _REST, "")
    open_end = ~F.right(last, F.lit(1)).isin(*_STOPS, *_CLOSERS) & ~last.rlike(_ANYWHERE) & (core != "")
    return rows.withColumn("core", F.when(open_end | last.rlike(r"[0-9]\.$"), core))  # a point after a digit may stand in a number


def _goes_on(core: str, text: str) -> bool:
    """Whether the sentence begins with the whole core and goes on, after a point with a digit."""
    return len(text) > len(core) and text.startswith(core) and (core[-1] != "." or text[len(core)].isdigit())


def shortened_versions(pairs: DataFrame) -> DataFrame:
    """(core): the last sentences of answers that another sentence continues.

    Sentences are sorted across partitions; what continues a sentence is next to it.  Each partition compares neighbours
    as they stream by and reports its first and last sentence, so that the pairs at the edges of partitions are compared
    too (two sentences a partition).
    """
    rows = _sentences(pairs)
    every = rows.select(F.explode("sentences").alias("core"), F.lit(False).alias("asked")).unionByName(rows.where("core is not null").select("core", F.lit(True).alias("asked")))
    ordered = every.groupBy("core").agg(F.max("asked").alias("asked")).repartitionByRange("core").sortWithinPartitions("core")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyspark

        part = pyspark.TaskContext.get().partitionId()
        before, first, out = None, True, ([], [], [], [])

        def add(*row) -> None:  # noqa: ANN002
            for c, v in zip(out, row):
                c.append(v)

        for batch in batches:
            for text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if first:
                    add(text, asked, "first", part)
                    first = False
                elif before[1] and _goes_on(before[0], text):
                    add(before[0], True, "short", part)
                before = text, asked
        if before is not None:
            add(*before, "last", part)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())], ["core", "asked", "kind", "part"])

    seen = ordered.mapInArrow(run, "core string, asked boolean, kind string, part bigint")
    following = F.lead("core").over(Window.orderBy("part", F.col("kind") == "last"))  # two rows a partition
    edges = seen.where("kind <> 'short'").select("core", "asked", "kind", following.alias("next"))
    cut = edges.where("kind = 'last' and asked and startswith(next, core) and (core not like '%.' or substring(next, length(core) + 1, 1) rlike '[0-9]')").select("core")
    return seen.where("kind = 'short'").select("core").unionByName(cut)


def length_limits(pairs: DataFrame) -> DataFrame:
    """The lengths (``n_chars``) at which answers are cut: spikes among the answers that have no end mark.

    Counted over all answers; each length is compared with those up to ``SPIKE_REACH`` away, by a sum over
    shifted copies of the small table of lengths.
    """
    ends = F.expr(f"right(rtrim(final_text), 1) not in ({', '.join(repr(c) for c in '.!?。！？…`”)]')}) and not right(rtrim(final_text), 1) rlike '[0-9]'")
    lengths = pairs.where(ends).groupBy(F.length("final_text").alias("n_chars")).agg(F.count(F.lit(1)).alias("n"))
    shifts = F.array(*[F.lit(i) for i in range(-SPIKE_REACH, SPIKE_REACH + 1)])
    around = lengths.select(F.explode(shifts).alias("d"), "n_chars", "n").groupBy((F.col("n_chars") + F.col("d")).alias("n_chars"))
    around = around.agg(F.sum(F.when(F.col("d") == 0, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(F.col("d") != 0, F.col("n")).otherwise(0)).alias("near"))
    limit = F.col("n") > SPIKE_TIMES * (F.col("near") / (2 * SPIKE_REACH) + 1)
    return around.where(limit).select("n_chars")


def defective_pairs(events: DataFrame) -> DataFrame:
    """(session_id, turn_id, defect) of every defective pair."""
    from tidewell.runtime import materialise, spread

    pairs = materialise(turn_pairs(spread(events.select("session_id", "sequence", "payload_json"))), "pairs")
    # joined by a number; pairs that ask for nothing have one of their own, so no key gathers them
    short = shortened_versions(pairs).select(F.xxhash64("core").alias("key")).distinct().withColumn("found", F.lit(True))
    limits = length_limits(pairs).withColumn("at_limit", F.lit(True))
    asked = _sentences(spread(pairs)).withColumn("key", F.when(F.col("core").isNotNull(), F.xxhash64("core")).otherwise(F.xxhash64("session_id", "turn_id")))
    marked = asked.join(short, "key", "left").withColumn("shortened", F.col("found") & F.col("core").isNotNull()).withColumn("n_chars", F.length("final_text")).join(limits, "n_chars", "left")
    columns = ["session_id", "turn_id", "user_message", "final_text", "truncated_code", "filtered_code", "shortened", "at_limit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(i).to_pylist() for i in range(2, 8)]
            found = [defect_of(u, f, bool(t), bool(c), bool(s), bool(a)) for u, f, t, c, s, a in zip(*values)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["session_id", "turn_id", "defect"])

    return marked.select(*columns).mapInArrow(run, "session_id string, turn_id string, defect string").where("defect is not null")
