"""Passages of evaluation items in a training corpus (problem 7).

Method: a distributed positional inverted index.  The corpus is read and cut into words once, whatever the number of
items; its words are kept as numbers (``token_store``).  From them come the frequencies of the items' terms, and the
postings (term, document, position) of the rarest terms of every item, which are stored by term, hot terms split over
partitions (``postings``).  The lists are joined with the items' terms, moved by the term's place in the item and
intersected: a document in which enough terms of an item agree on a place is a candidate.  Candidates are verified
on the document's words there by an alignment that counts words changed, lost or added.

What tasks are sent has a fixed size: sets of terms and of documents are bit fields of ``BITS`` bits, whose false hits
the joins that follow remove.  Items are joined, never broadcast by hand, so their number and length have no limit.

Texts are cut into words without case, punctuation, mark-up and white space; a Chinese or Japanese character is a
word of its own, and a term is a word or, for such characters, ``GRAM`` of them in a row.

A leak is a span of at least ``SPAN`` words of the item (``SPAN_EAST`` characters) with at most one word in
``PER`` (one character in ``PER_EAST``) changed, lost or added.  Every such span holds a window of ``SPAN`` words with
no more changes than ``most_changes`` tells, each of which spoils one word (or one of several terms of characters that do
not overlap), so it keeps ``EXTRA + 1`` of the window's rarest terms if so many more are looked up: asking for
``EXTRA + 1`` of them in one place misses no leak.

Defined results for odd input: null, empty and blank texts hold no passage; repeated items are one item each by
``item_id``; an item shorter than a span leaks only as a whole; empty tables give no rows; texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.runtime import materialise, spread

SPAN, PER = 20, 7
SPAN_EAST, PER_EAST, GRAM = 40, 12, 4
#: Terms looked up beyond the ones that changes may spoil; so many more must then be found in one place.
EXTRA = 7
#: How far the places of one passage may drift apart by words lost or added, on top of the share of changes.
DRIFT = 8
#: Places (document position less item position) are intersected in overlapping stretches of twice this length; the
#: places of a window differ by its changes at most.
STRETCH = 8
#: Bits of the fields that stand for sets of terms and documents.
BITS = 1 << 22

_EAST = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_WORD = re.compile(f"[{_EAST}]|[^\\W_{_EAST}]+(?:_[^\\W_{_EAST}]+)*")
_PLAIN = re.compile("[a-z0-9]+(?:_[a-z0-9]+)*")
_IS_EAST = re.compile(f"[{_EAST}]")
_MARKUP = re.compile(r"<[^<>\n]{1,80}>|&(?:nbsp|amp|lt|gt|quot|#\d{1,5});")
_SIGNS = re.compile("[­​-‏⁠﻿*`~\\\\]")
_HYPHEN = re.compile(r"(?<=\w)-[ \t]*\r?\n[ \t]*(?=\w)")


def words(text: str | None) -> list[str]:
    """The words of a text in order: folded, without marks."""
    if not text:
        return []
    if "<" in text or "&" in text:
        text = _MARKUP.sub(" ", text)
    text = _SIGNS.sub("", text)
    if "-" in text:
        text = _HYPHEN.sub("", text)
    if text.isascii():
        return _PLAIN.findall(text.lower())
    return _WORD.findall(unicodedata.normalize("NFKC", text).casefold())


_numbers: dict[str, int] = {}


def numbers(of: list[str]) -> np.ndarray:
    """The words as numbers of 63 bits; the lowest bit tells Chinese and Japanese characters."""
    if len(_numbers) > 500_000:
        _numbers.clear()
    out = []
    for w in of:
        n = _numbers.get(w)
        if n is None:
            n = _numbers[w] = int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 2 << 1 | bool(_IS_EAST.match(w))
        out.append(n)
    return np.array(out, np.int64)


def terms(tokens: np.ndarray, owner: np.ndarray | None = None) -> np.ndarray:
    """The term that begins at each token, 0 where none does; ``owner`` numbers the texts of several, one after another."""
    east = (tokens & 1).astype(bool)
    out = np.where(east, 0, tokens)
    n = len(tokens) - GRAM + 1
    if n > 0 and east.any():
        whole = np.logical_and.reduce([east[i : i + n] for i in range(GRAM)])
        if owner is not None:
            whole &= owner[:n] == owner[GRAM - 1 :]
        gram = tokens[:n].astype(np.uint64)
        with np.errstate(over="ignore"):
            for i in range(1, GRAM):
                gram = gram * np.uint64(0x9E3779B97F4A7C15) + tokens[i : i + n].astype(np.uint64)
        out[:n] = np.where(whole, (gram >> np.uint64(1)).astype(np.int64) | 1, out[:n])
    return out


def token_store(texts: DataFrame, key: str) -> DataFrame:
    """(key, tokens) of every text that has a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [numbers(words(t)) for t in batch.column(1).to_pylist()]
            keep = [i for i, x in enumerate(found) if len(x)]
            offsets = np.cumsum([0, *(len(found[i]) for i in keep)]).astype(np.int32)
            flat = np.concatenate([found[i] for i in keep]) if keep else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [key, "tokens"])

    source = texts.select(F.col(key).cast("bigint").alias(key), "text").where(F.col(key).isNotNull() & (F.length("text") > 0))
    return spread(source).mapInArrow(run, f"{key} bigint, tokens array<bigint>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of a batch of the store in one array, the row of each, and its position in the row."""
    lists = batch.column(1)
    ends = lists.offsets.to_numpy()
    tokens = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    n = np.diff(ends)
    owner = np.repeat(np.arange(len(n)), n)
    return tokens, owner, np.arange(len(tokens)) - np.repeat(ends[:-1] - ends[0], n)


def bit_field(values: DataFrame, column: str) -> Broadcast:
    """The set of a column's values, a bit each; the driver gets no more than ``BITS`` numbers."""
    at = values.select(F.pmod(F.xxhash64(column), F.lit(BITS)).cast("int").alias("at")).distinct().toArrow()["at"].to_numpy()
    field = np.zeros(BITS, bool)
    field[at] = True
    return values.sparkSession.sparkContext.broadcast(np.packbits(field))


def _term_bits(item_terms: DataFrame) -> Broadcast:
    """The same of terms, which are numbers already."""
    at = item_terms.select(F.pmod(F.shiftright("term", 1), F.lit(BITS)).cast("int").alias("at")).distinct().toArrow()["at"].to_numpy()
    field = np.zeros(BITS, bool)
    field[at] = True
    return item_terms.sparkSession.sparkContext.broadcast(np.packbits(field))


def _has(field: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of the terms may be in the set."""
    return (found != 0) & field[(found >> 1) % BITS]


def frequencies(store: DataFrame, item_terms: DataFrame) -> DataFrame:
    """(term, n): how often the items' terms stand in the corpus; added up by each task before anything is sent."""
    wanted = _term_bits(item_terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.unpackbits(wanted.value).astype(bool)
        own: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array(list(own.values()), pa.int64())], ["term", "n"])

        for batch in batches:
            tokens, owner, _ = _flat(batch)
            found = terms(tokens, owner)
            for t, n in zip(*(x.tolist() for x in np.unique(found[_has(field, found)], return_counts=True))):
                own[t] += n
            if len(own) > 1_000_000:
                yield out()
                own.clear()
        yield out()

    return spread(store).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def postings(store: DataFrame, anchors: DataFrame) -> DataFrame:
    """(term, doc_id, pos): the stored index of the anchors' terms, by term; partitions of hot terms are split."""
    wanted = _term_bits(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.unpackbits(wanted.value).astype(bool)
        for batch in batches:
            tokens, owner, pos = _flat(batch)
            found = terms(tokens, owner)
            keep = np.flatnonzero(_has(field, found))
            yield pa.RecordBatch.from_arrays([pa.array(found[keep]), batch.column(0).take(pa.array(owner[keep])), pa.array(pos[keep].astype(np.int32))], ["term", "doc_id", "pos"])

    raw = spread(store).mapInArrow(run, "term bigint, doc_id bigint, pos int")
    return materialise(raw.hint("rebalance", "term").sortWithinPartitions("term", "doc_id", "pos"), "postings")


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, pos, term) of every item, from its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, owner, pos = _flat(batch)
            found = terms(tokens, owner)
            keep = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[keep])), pa.array(pos[keep].astype(np.int32)), pa.array(found[keep])], ["item_id", "pos", "term"])

    return items.mapInArrow(run, "item_id bigint, pos int, term bigint")


def most_changes(span: int, per: int, n_words: int) -> int:
    """The most changes that every window of ``span`` words of a leak may hold.

    A leak of ``length`` words has ``length // per`` changes; all windows hold those that lie in the words that are common
    to all windows."""
    if n_words <= span:
        return n_words // per
    return max(min(length // per, 2 * span - length) for length in range(span, min(2 * span, n_words + 1)))


def anchors_of(items: DataFrame, frequency: DataFrame) -> DataFrame:
    """(item_id, item_pos, term, kept): the rarest terms of every window of each item, and how many a leak keeps."""
    with_n = item_terms(items).join(frequency, "term", "left").groupBy("item_id").agg(F.collect_list(F.struct("pos", "term", F.coalesce("n", F.lit(0)).alias("n"))).alias("t"))
    rows = items.join(with_n, "item_id").select("item_id", "tokens", F.col("t.pos").alias("pos"), F.col("t.term").alias("term"), F.col("t.n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, tokens, pos, term, n in zip(*(batch.column(i).to_pylist() for i in range(5))):
                chosen, kept = rarest(sorted(zip(pos, term)), dict(zip(term, n)), len(tokens), is_east(tokens))
                out += [(item, p, t, kept) for p, t in chosen]
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32()))], ["item_id", "item_pos", "term", "kept"])

    return materialise(rows.mapInArrow(run, "item_id bigint, item_pos int, term bigint, kept int"), "anchors")


def candidates(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """(doc_id, item_id, stretches): where at least ``kept`` terms of the item agree on a place.

    The terms found in a stretch are bits of one number, by their position in the item modulo 64, which is exact for the
    terms of one window of the item."""
    hits = index.join(anchors, "term").select("doc_id", "item_id", F.expr("shiftleft(1L, item_pos % 64)").alias("bit"), "kept", F.floor((F.col("pos") - F.col("item_pos")) / STRETCH).alias("b"))
    each = hits.select("doc_id", "item_id", "bit", "kept", F.explode(F.array(F.col("b") - 1, F.col("b"))).alias("stretch"))
    found = each.groupBy("doc_id", "item_id", "stretch").agg(F.bit_count(F.bit_or("bit")).alias("n"), F.max("kept").alias("kept")).where("n >= kept")
    return found.groupBy("doc_id", "item_id").agg(F.sort_array(F.collect_list("stretch")).alias("stretches"))


def is_east(tokens: list[int]) -> bool:
    """Whether most of an item's words are Chinese or Japanese characters."""
    return sum(t & 1 for t in tokens) > len(tokens) / 2


def rarest(of: list[tuple[int, int]], frequency: dict[int, int], n_words: int, east: bool) -> tuple[set[tuple[int, int]], int]:
    """The (position, term) pairs to look up, and how many different terms of them every span keeps whatever the allowed changes."""
    span = min(SPAN_EAST if east else SPAN, n_words)
    changes = most_changes(span, PER_EAST if east else PER, n_words)
    chosen: set[tuple[int, int]] = set()
    kept = EXTRA + 1
    for start in range(0, n_words - span + 1):
        inside = [(p, t) for p, t in of if start <= p and p + (GRAM if t & 1 else 1) <= start + span]
        taken = _tiles(inside, frequency) if east else sorted(inside, key=lambda x: (frequency.get(x[1], 0), x[0]))
        names: dict[int, int] = {}
        for p, t in taken:
            names.setdefault(t, p)
            if not east and len(names) > changes + EXTRA:
                break
        chosen.update((p, t) for t, p in names.items())
        kept = min(kept, len(names) - changes)
    return chosen, max(kept, 1)


def _tiles(inside: list[tuple[int, int]], frequency: dict[int, int]) -> list[tuple[int, int]]:
    """As many terms as fit without sharing a word, laid from one of the first words on; the rarest of such rows."""
    best: list[tuple[int, int]] = []
    for skip in range(GRAM):
        row, free = [], inside[0][0] + skip if inside else 0
        for p, t in inside:
            if p >= free:
                row.append((p, t))
                free = p + (GRAM if t & 1 else 1)
        if (len(row), -sum(frequency.get(t, 0) for _, t in row)) > (len(best), -sum(frequency.get(t, 0) for _, t in best)):
            best = row
    return best


def may_hold(item: np.ndarray, window: np.ndarray, east: bool, place: int) -> bool:
    """Whether a window of the item has enough of its words where the document has the item from ``place`` of the window on,
    give or take a stretch."""
    span, per = min(SPAN_EAST if east else SPAN, len(item)), PER_EAST if east else PER
    changes = most_changes(span, per, len(item))
    off = np.arange(len(window))[None, :] - np.arange(len(item))[:, None] - place
    hit = ((item[:, None] == window[None, :]) & (off >= -changes) & (off <= 2 * STRETCH + changes)).any(1)
    inside = np.concatenate(([0], np.cumsum(hit)))
    return bool((inside[span:] - inside[:-span]).max() >= span - changes)


def aligned(item: list, doc: list, east: bool) -> tuple[int, int] | None:
    """The longest span of the item that the document's words hold, as (words of the item, changes); None if too short.

    Matching blocks of the two lists in order are joined while the changes between them stay within the allowed
    share; a span begins and ends with words that agree.
    """
    span, per = min(SPAN_EAST if east else SPAN, len(item)), PER_EAST if east else PER
    blocks = _blocks(item, doc)
    best = None
    for a in range(len(blocks)):
        i0, j0, n = blocks[a]
        changes = 0
        for b in range(a, len(blocks)):
            if b > a:
                i, j, n = blocks[b]
                pi, pj, pn = blocks[b - 1]
                changes += max(i - pi - pn, j - pj - pn)
            length = blocks[b][0] + blocks[b][2] - i0
            if changes > length / per + 1:
                if changes > len(item) / per + 1:
                    break
                continue
            if length >= span and changes * per <= length and (best is None or length > best[0]):
                best = (length, changes)
        # a span may also end with changed words: the same share counts them
    if best is None:
        best = _with_edges(blocks, item, span, per)
    return best


def _with_edges(blocks: list[tuple[int, int, int]], item: list, span: int, per: int) -> tuple[int, int] | None:
    """A span whose first or last words are changed ones."""
    for a in range(len(blocks)):
        changes = 0
        for b in range(a, len(blocks)):
            if b > a:
                changes += max(blocks[b][0] - blocks[b - 1][0] - blocks[b - 1][2], blocks[b][1] - blocks[b - 1][1] - blocks[b - 1][2])
            length = blocks[b][0] + blocks[b][2] - blocks[a][0]
            spare = span // per - changes
            if spare >= 0 and length + spare >= span and length + min(spare, len(item) - length) >= span:
                return span, changes + span - length
    return None


def _blocks(item: list, doc: list) -> list[tuple[int, int, int]]:
    """Blocks (item position, document position, words) of a longest common subsequence."""
    n, m = len(item), len(doc)
    grid = np.zeros((n + 1, m + 1), np.int32)
    number: dict = {}
    a, b = (np.array([number.setdefault(w, len(number)) for w in x], np.int32) for x in (item, doc))
    for i in range(n - 1, -1, -1):
        below = grid[i + 1]
        grid[i, :m] = np.maximum.accumulate(np.where(b == a[i], below[1:] + 1, below[:-1])[::-1])[::-1]
    table = grid.tolist()
    i = j = 0
    blocks: list[tuple[int, int, int]] = []
    while i < n and j < m:
        if item[i] == doc[j] and table[i][j] == table[i + 1][j + 1] + 1:
            if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
                blocks[-1] = (blocks[-1][0], blocks[-1][1], blocks[-1][2] + 1)
            else:
                blocks.append((i, j, 1))
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return _moved_together(blocks, item, doc)


def _moved_together(blocks: list[tuple[int, int, int]], item: list, doc: list) -> list[tuple[int, int, int]]:
    """The same words with as few gaps: a block takes the words before it from earlier blocks where the texts agree."""
    out: list[tuple[int, int, int]] = []
    for i, j, n in reversed(blocks):
        if out:  # what the block after it has taken
            n = min(n, out[-1][0] - i, out[-1][1] - j)
            if n <= 0:
                continue
        while i and j and item[i - 1] == doc[j - 1]:
            i, j, n = i - 1, j - 1, n + 1
        out.append((i, j, n))
    return out[::-1]


def verified(item: np.ndarray, stretches: list[int], starts: list[int], windows: list[np.ndarray]) -> tuple[int, int] | None:
    """The longest span of the item in one of the windows of a document, or in neighbouring ones put together."""
    east, best = bool((item & 1).sum() > len(item) / 2), None
    runs: list[list[np.ndarray]] = []
    end = -1
    for stretch, start, window in zip(stretches, starts, windows):
        if not may_hold(item, window, east, stretch * STRETCH - start):
            continue
        if start <= end and runs:
            runs[-1][0] = np.concatenate((runs[-1][0], window[max(end - start, 0) :]))
            runs[-1].append(window)
        else:
            runs.append([window, window])
        end = max(end, start + len(window))
    for joined, *own in runs:
        # a long run may hold the item more than once
        for w in [joined, *own] if len(own) > 4 else [joined]:
            if best and best[0] == len(item):
                return best
            found = aligned(item.tolist(), w.tolist(), east)
            if found and (best is None or found[0] > best[0]):
                best = found
    return best


def _arrays(lists: pa.ListArray) -> list[np.ndarray]:
    """The rows of a list column."""
    values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return [values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, shared_words, changes, whole) of every leak; ``whole`` if the span is the item."""
    store = materialise(token_store(documents, "doc_id"), "tokens")
    known = materialise(token_store(items.where("length(text) > 0").dropDuplicates(["item_id"]), "item_id"), "items")
    anchors = anchors_of(known, frequencies(store, item_terms(known)))
    found = materialise(candidates(postings(store, anchors), anchors), "candidates")
    wanted = bit_field(found, "doc_id")

    def of_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = np.unpackbits(wanted.value).astype(bool)
        for batch in batches:
            yield batch.filter(pa.array(field[batch.column(2).to_numpy()])).select(["doc_id", "tokens"])

    few = store.withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(BITS))).mapInArrow(of_candidates, "doc_id bigint, tokens array<bigint>")
    n = F.size("item")
    slack = F.lit(DRIFT) + F.floor(n / PER).cast("int")
    start = lambda r: F.greatest(r * STRETCH - slack, F.lit(0)).cast("int")
    length = lambda r: F.greatest((r * STRETCH + 2 * STRETCH + n + slack).cast("int") - start(r), F.lit(0))
    placed = found.join(known.select("item_id", F.col("tokens").alias("item")), "item_id").join(few, "doc_id")
    pieces = placed.select("doc_id", "item_id", "item", "stretches", F.transform("stretches", start).alias("starts"), F.transform("stretches", lambda r: F.slice("tokens", start(r) + 1, length(r))).alias("windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k in range(0, batch.num_rows, 500):  # so that few are held at once
                part = batch.slice(k, 500)
                nested = part.column(5)
                inner, at = _arrays(nested.values), nested.offsets.to_pylist()
                docs, ids, stretches, starts = (part.column(i).to_pylist() for i in (0, 1, 3, 4))
                for j, item in enumerate(_arrays(part.column(2))):
                    best = verified(item, stretches[j], starts[j], inner[at[j] : at[j + 1]])
                    if best:
                        rows.append((docs[j], ids[j], *best, best[0] == len(item)))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()))], ["doc_id", "item_id", "shared_words", "changes", "whole"])

    return pieces.mapInArrow(run, "doc_id bigint, item_id bigint, shared_words int, changes int, whole boolean")
