"""Encoding a corpus with a public byte-level BPE tokenizer (problem 6).

Method: prefix-sharing trie traversal.  The distinct words of a batch are visited in the depth-first order of
their trie.  Every trie node (a prefix) has one state, the last token of the prefix's encoding: it is the one
vocabulary token that ends the prefix and may stand after the last token of what precedes it.  The states of
a shared prefix are computed once; the encoding of a word follows its states back to the root.

Two tokens may stand side by side if encoding their joined bytes gives just these two tokens; an encoding is
right if all its neighbours may stand so.  The work is linear in the length of a word, also for words of many
thousand characters.

Defined results: null, empty text -> an empty list of ids.  The text of a special token is ordinary text.  Every
row comes out once; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from tidewell.runtime import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How this vocabulary's texts are cut into words (fixed value of the public tokenizer).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and neighbour pairs a worker remembers at most; beyond that it starts anew, which changes no result.
REMEMBERED = 300_000


class TrieEncoder:
    """Encodes sets of words over one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.neighbours: dict[tuple[int, int], bool] = {}
        self.suffixes: dict = {}
        for token, rank in ranks.items():  # reversed tokens as a trie: finds all tokens that end at a place
            at = self.suffixes
            for b in reversed(token):
                at = at.setdefault(b, {})
            at[-1] = rank

    def merge(self, text: bytes) -> list[int]:
        """Plain byte pair merging of a short text: the definition the rest is held against."""
        ranks, parts = self.ranks, [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _may_follow(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.neighbours.get(key)
        if known is None:
            if len(self.neighbours) > REMEMBERED:
                self.neighbours.clear()
            known = self.neighbours[key] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def _last(self, word: bytes, end: int, last: list[int], size: list[int]) -> int:
        """The last token of the encoding of ``word[:end]``, given those of all shorter prefixes."""
        at, found = self.suffixes, []
        for i in range(end - 1, -1, -1):
            at = at.get(word[i])
            if at is None:
                break
            if -1 in at:
                found.append((i, at[-1]))
        for i, token in reversed(found):
            if i == 0:
                if size[0] or self.merge(word[:end]) == [token]:
                    return token
            elif self._may_follow(last[i], token):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def encode_all(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """The ids of each word."""
        result: dict[str, tuple[int, ...]] = {}
        coded = sorted((w.encode("utf-8", "surrogatepass"), w) for w in words)
        path, last, begins, whole = b"", [-1], [0], [0]
        for raw, word in coded:
            rank = self.ranks.get(raw)
            shared, limit = 0, min(len(path), len(raw))
            if rank is None or len(raw) < 4:
                while shared < limit and path[shared] == raw[shared]:
                    shared += 1
                del last[shared + 1 :], begins[shared + 1 :]
                for end in range(shared + 1, len(raw) + 1):
                    token = self._last(raw, end, last, whole)
                    last.append(token)
                    begins.append(end - len(self.bytes_of[token]))
                path = raw
                ids, end = [], len(raw)
                while end:
                    ids.append(last[end])
                    end = begins[end]
                result[word] = tuple(reversed(ids))
            else:
                result[word] = (rank,)  # a word that is a token is that token
        return result


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file with one base64 token and its rank a line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}


_encoders: dict[str, tuple[TrieEncoder, dict]] = {}


def encode(documents: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids) of every row; no shuffle.  The vocabulary (a file of fixed size, below 1 MB) is read once and
    broadcast, so executors need no access to its path."""
    spark = documents.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(vocabulary))
    source = spread(documents.select(key, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        if vocabulary not in _encoders:
            _encoders[vocabulary] = (TrieEncoder(ranks.value), {})
        encoder, known = _encoders[vocabulary]
        cut = regex.compile(WORDS).findall
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [cut(t) if t else [] for t in part.column(1).to_pylist()]
                new = {w for t in texts for w in t if w not in known}
                if len(known) + len(new) > REMEMBERED:
                    known.clear()
                    new = {w for t in texts for w in t}
                known |= encoder.encode_all(new)
                offsets, ids = np.zeros(len(texts) + 1, np.int32), []
                for i, t in enumerate(texts):
                    for w in t:
                        ids += known[w]
                    offsets[i + 1] = len(ids)
                values = pa.array(np.array(ids, np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], [key, "ids"])
                if len(known) > REMEMBERED:
                    known.clear()

    out = source.select(key).schema.add("ids", ArrayType(IntegerType()))
    return source.mapInArrow(run, out)
