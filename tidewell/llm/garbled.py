"""Finding and restoring text that was decoded with the wrong encoding (problem 8).

Method: smoothed character n-gram models are trained in two rounds: on the distinct words of all records that show no
structural sign of wrong decoding, then on those of them that no chain makes much likelier in the first model or turns into a more frequent word.  Every
candidate chain (encode with the encoding that was wrongly used, decode with the right one, once or twice) is scored on
every suspicious piece of a text, and the likeliest is accepted if it beats the text as it is by the margin.

The margin is validated: a second model is trained without a fiftieth of the distinct words; on the sound ones of these every chain's gain
is a false one, and the same words garbled by each chain give the true gains.  The smallest margin of ``MARGINS`` that
accepts no more than ``FALSE_RATE`` of the held-out words is used (``validate``).

The model counts unigrams, bigrams and trigrams around every non-ASCII character, hashed into a table of a fixed size
(``TABLE`` entries), so what is broadcast does not grow with the corpus.  Collisions add 1 / ``TABLE`` to a probability
on average: they lift the least probable places from a logarithm of -18.4 to -15.2, far below ``USUAL``.

Defined results for odd input: null, empty and ASCII texts are clean; a text with U+FFFD, or with a C1 control
other than U+0085, is garbled; what no chain restores is kept as it is; line ends and white space are never
changed; every text is read whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.runtime import materialise, spread

#: Entries of the hashed table of counts.
TABLE = 1 << 22
#: Margins that are validated: how much likelier (natural logarithm) a chain has to make a piece, in all and for each
#: changed character a fifth of it; the share of sound held-out words that may be changed; one word in so many is held out.
MARGINS, FALSE_RATE, HELD_OUT = (3.0, 4.0, 5.0, 6.0, 8.0, 10.0), 0.001, 50
#: A piece is suspicious if the log-probability of one of its characters is below this.
USUAL = -9.0
#: The log-probability of a character that is expected at its place, and the share of all that it must have for it.
EXPECTED, COMMON = -4.5, 2e-4

#: What a chain that ends in an unlikely encoding has to be likelier by, or one of byte pairs.
UNLIKELY_COST, BYTE_PAIR_COST = 8.0, 12.0
#: Encodings texts are wrongly read in, and the ones they were written in.
SINGLE = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "koi8-r", "cp866", "iso8859-15", "iso8859-2", "cp1254", "cp1253")
DOUBLE = ("gbk", "big5", "cp932", "euc_kr", "euc_jp")
#: Chains that end in one of these need more: few texts are written in them, or two bytes are a character by chance.
UNLIKELY = {"mac_roman": UNLIKELY_COST, "cp437": UNLIKELY_COST, "cp850": UNLIKELY_COST} | dict.fromkeys(DOUBLE, BYTE_PAIR_COST)
CHAINS = (
    *[(e, "utf-8") for e in (*SINGLE, *DOUBLE)],
    *[(e, "cp1252") for e in ("cp437", "cp850", "mac_roman", "cp1250", "cp1251", "cp866", "koi8-r", "iso8859-2")],
    *[(e, t) for t in ("mac_roman", "cp437", "cp850") for e in ("cp1252", "latin-1", "cp1251", "cp1250")],
    *[(e, t) for t in ("cp1251", "koi8-r", "cp866") for e in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "koi8-r", "cp866", "cp1251") if e != t],
    *[(e, t) for t in DOUBLE for e in ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250")],
    ("gbk", "cp932"), ("cp932", "gbk"), ("gbk", "big5"), ("big5", "gbk"),
)

_C1 = re.compile("[\x80-\x84\x86-\x9f]")
_OTHER = re.compile("[^\x00-\x7f]")
_TWO = re.compile("[^\x00-\x7f]{2}")
_PIECES = re.compile(r"[^\n\r]+")
_SENTENCE = re.compile(r"\S(?:.*?[.!?](?=[ \t])|.*$)")
_BOXES = re.compile("[─-╿]")
#: Characters of East Asian scripts and their marks: pieces are cut where these begin or end.
_EAST = re.compile("[　-〿぀-ヿ㐀-䶿一-鿿가-힯＀-￯]+|[^　-〿぀-ヿ㐀-䶿一-鿿가-힯＀-￯]+")
_TOKEN = re.compile(r"\S*[^\x00-\x7f]\S*")
_RUN = re.compile(r"[^\x00-\x7f]+(?:[\x21-\x7e]?[^\x00-\x7f]+)*[\x40-\x7e]?")

#: What a sound text may hold; bytes that are UTF-8 by chance give other characters.
_WRITTEN = re.compile("[\x20-\x7e\xa0-ſ–-™€Ѐ-ӿ　-ヿ一-鿿！-～]*[\xa0-ſ–-™€Ѐ-ӿ　-ヿ一-鿿！-～][\x20-\x7e\xa0-ſ–-™€Ѐ-ӿ　-ヿ一-鿿！-～]*")

#: How a line is cut again and again as long as no chain fits the whole.
_CUTS = (_SENTENCE, _EAST, _TOKEN, _RUN)

_tables: dict[str, tuple[dict, dict]] = {}


def _table(encoding: str) -> dict[str, bytes]:
    """Character to byte of a one-byte encoding; bytes without a character stand for themselves, as decoders do that
    never fail."""
    if encoding not in _tables:
        forward = {}
        for b in range(256):
            try:
                c = bytes([b]).decode(encoding)
            except UnicodeDecodeError:
                c = chr(b)
            forward.setdefault(c, bytes([b]))
        _tables[encoding] = (forward, {ord(c): b[0] for c, b in forward.items()})
    return _tables[encoding][0]


def encode_as(text: str, encoding: str) -> bytes | None:
    """The bytes that a reader in ``encoding`` would have shown as ``text``; None if there are none."""
    if encoding in DOUBLE:
        try:
            return text.encode(encoding)
        except UnicodeEncodeError:
            return None
    table = _table(encoding)
    try:
        return b"".join([table[c] for c in text])
    except KeyError:
        return None


_ASCII_BYTES = bytes(range(128))


def decode_as(data: bytes, encoding: str) -> tuple[str, int] | None:
    """The text and the number of bytes lost; None unless, of UTF-8, three quarters of the high bytes decode."""
    try:
        return data.decode(encoding), 0
    except UnicodeDecodeError:
        if encoding != "utf-8":
            return None
        text = data.decode(encoding, "ignore")
        high, kept = len(data.translate(None, _ASCII_BYTES)), len(text.encode(encoding, "ignore").translate(None, _ASCII_BYTES))
        return (text, high - kept) if 0 < kept >= 0.75 * high else None


#: Where texts are cut into words; what stands before or after such a character counts as a word's edge.
_CUT_AFTER = "。！？；，、："
_WORDS = rf"[ \t\r\n]+|(?<=[{_CUT_AFTER}])"
_MASK = (1 << 64) - 1
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def _fold(c: str) -> str:
    """A neighbour as the model sees it."""
    return " " if c.isspace() or c in _CUT_AFTER else "0" if "0" <= c <= "9" else c.lower()[0]


def _index(kind: int, a: int, b: int, c: int) -> int:
    """The table's entry for a gram of up to three code points."""
    x = (a * _FACTORS[0] + b * _FACTORS[1] + c * _FACTORS[2] + kind * _FACTORS[3]) & _MASK
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & _MASK
    return (x ^ (x >> 32)) & (TABLE - 1)


def _indexes(kind: int, a: np.ndarray | int, b: np.ndarray | int, c: np.ndarray | int) -> np.ndarray:
    """``_index`` of many grams (uint64 arrays)."""
    u = np.uint64
    with np.errstate(over="ignore"):
        x = np.asarray(a, u) * u(_FACTORS[0]) + np.asarray(b, u) * u(_FACTORS[1]) + np.asarray(c, u) * u(_FACTORS[2]) + u(kind * _FACTORS[3] & _MASK)
        x = (x ^ (x >> u(29))) * u(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> u(32))) & u(TABLE - 1)).astype(np.int64)


_folded: dict[str, np.ndarray] = {}


def _tables_of_folds() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its form as a neighbour and as the character itself."""
    if not _folded:
        own = np.arange(0x110000, dtype=np.uint64)
        beside = own.copy()
        for i in range(0x10000):
            c = chr(i)
            beside[i], own[i] = ord(_fold(c)), ord(c.lower()[0])
        _folded["beside"], _folded["own"] = beside, own
    return _folded["beside"], _folded["own"]


def grams(text: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The positions of the non-ASCII characters and the table's entries for each: itself, it after its left neighbour, it
    before its right one, it between both, and the two neighbours.  Letters are folded to small ones."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(points > 127)
    beside, own = _tables_of_folds()
    padded = np.concatenate(([32], points, [32]))
    left, right, c = beside[padded[at]], beside[padded[at + 2]], own[points[at]]
    return at, [_indexes(0, c, 0, 0), _indexes(1, left, c, 0), _indexes(2, c, right, 0), _indexes(3, left, c, right), _indexes(4, left, right, 0)]


def _inside_word(text: str, at: np.ndarray) -> np.ndarray:
    """Whether the characters are signs or of an eastern script and stand between two Latin letters."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((points | 32) >= 97) & ((points | 32) <= 122)
    return letter[at] & letter[at + 2] & (points[at + 1] >= 0x2100)


class Model:
    """The probability of a non-ASCII character with its neighbours, interpolated from hashed counts.

    It is the share among all such places, not among those with the same neighbours: neighbours that only occur
    in garbled text must not make that text likely.  Between usual neighbours, a common character that stands there in a
    tenth of all cases is what is expected, however rare the place."""

    def __init__(self, counts: np.ndarray, total: float, expects: bool = True) -> None:
        """``expects``: whether what is usual at its place is expected there; garbled text must not train itself so."""
        self.counts = counts
        self.expects = expects
        self.total = 1.0 + total
        self.memo: dict[str, float] = {}
        self.done: dict[tuple, tuple] = {}

    def places(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The positions of the non-ASCII characters and the log-probability of each."""
        at, g = grams(text)
        if not len(at):
            return at, np.zeros(0)
        u, bl, br, t, c3 = (self.counts[x].astype(np.float64) for x in g)
        value = np.log((0.8 * t + 0.03 * np.minimum(bl, br) + 0.01 * (bl + br) + 0.001 * u) / self.total + 1e-8)
        if self.expects:
            usual = (t > 0.1 * (c3 + 3)) & (u > COMMON * self.total) & ~_inside_word(text, at)
            value = np.where(usual, np.maximum(value, EXPECTED), value)
        return at, value

    def char(self, near: str) -> float:
        """The log-probability of the middle one of three characters."""
        known = self.memo.get(near)
        if known is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            known = self.memo[near] = float(self.places(near)[1][int(near[0] > "\x7f")])
        return known

    def _each(self, text: str) -> list[float]:
        padded = f" {text} "
        return [self.char(padded[m.start() - 1 : m.start() + 2]) for m in _OTHER.finditer(padded)]

    def score(self, text: str) -> float:
        return sum(self._each(text)) if len(text) < 48 else float(self.places(text)[1].sum())

    def worst(self, text: str) -> float:
        return min(self._each(text), default=0.0) if len(text) < 48 else float(self.places(text)[1].min(initial=0.0))


def has_signs(text: str) -> bool:
    """Structural signs of wrong decoding: U+FFFD, C1 controls, or tokens whose bytes are valid UTF-8."""
    if text.isascii():
        return False
    if "�" in text or _C1.search(text):
        return True
    for m in _TOKEN.finditer(text):
        token = m.group()
        if not _TWO.search(token):  # no sequence of UTF-8 is shorter
            continue
        for e in ("cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "koi8-r"):
            data = encode_as(token, e)
            if data is not None:
                try:
                    if _WRITTEN.fullmatch(data.decode("utf-8")):
                        return True
                except UnicodeDecodeError:
                    pass
    return False


def distinct_words(documents: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): every word with a non-ASCII character and how often it stands in the texts, written to the shared folder."""
    word = F.explode(F.split(text, _WORDS)).alias("word")
    other = r"[^\x00-\x7f]"
    found = spread(documents.where(F.col(text).rlike(other)).select(text)).select(word).where(F.col("word").rlike(other))
    return materialise(found.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")


def mark_spoilt(words: DataFrame) -> DataFrame:
    """``words`` with ``spoilt``: whether a chain turns the word into another, of three letters at least, that stands in the
    texts twice as often.

    Digits and capital letters make no difference.  A garbled word is rarer than what it was; sound words that a chain
    turns into each other are next to unknown."""
    key = lambda c: F.translate(F.lower(c), "123456789", "000000000")
    totals = words.groupBy(key("word").alias("key")).agg(F.sum("n").alias("m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(w, c) for w in batch.column(0).to_pylist() for c, _, lost in _candidates(w) if not lost and sum(map(str.isalpha, c)) >= 3]
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["word", "candidate"])

    pairs = spread(words.select("word")).mapInArrow(run, "word string, candidate string").select("word", key("word").alias("own"), key("candidate").alias("key"))
    better = pairs.join(totals, "key").withColumnRenamed("m", "better").drop("key").join(totals, F.col("own") == F.col("key")).where("better >= 2 * m")
    return materialise(words.join(better.select("word").distinct().withColumn("spoilt", F.lit(True)), "word", "left").select("word", "n", F.coalesce("spoilt", F.lit(False)).alias("spoilt")), "words")


def _held_out(words: DataFrame, yes: bool) -> DataFrame:
    own = F.pmod(F.xxhash64("word"), F.lit(HELD_OUT)) == 0
    return words.where(own if yes else ~own)


def train(words: DataFrame) -> tuple[tuple[np.ndarray, float], tuple[np.ndarray, float]]:
    """The model's counts over the clean words and their number of characters, and the same without the held-out words.

    A first model counts all words without signs.  For the second, spoilt words and those words and their parts that a
    chain makes likelier by twice the least margin in the first, in which nothing is expected, are left out.
    """
    spark = words.sparkSession
    words = mark_spoilt(words)
    first = spark.sparkContext.broadcast(_count(words, None))
    kept, held = _count(_held_out(words, False), first), _count(_held_out(words, True), first)
    first.unpersist()
    return (kept[0] + held[0], kept[1] + held[1]), kept


def _count(words: DataFrame, first: Broadcast | None) -> tuple[np.ndarray, float]:
    """Each task adds up its own table and sends what is not zero, at most TABLE pairs, which are added by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = np.zeros(TABLE, np.int64), 0
        model = first and Model(*first.value, expects=False)
        for batch in batches:
            for word, n, spoilt in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if has_signs(word) or model and spoilt:
                    continue
                at, g = grams(word)
                if model:
                    left_out = doubtful(word, model)
                    keep = np.array([not any(a <= i < b for a, b in left_out) for i in at], bool)
                    at, g = at[keep], [x[keep] for x in g]
                for x in g:
                    np.add.at(own, x, n)
                total += n * len(at)
        where = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[where, -1]), pa.array(np.r_[own[where], total])], ["at", "n"])

    added = spread(words).mapInArrow(run, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = added["at"].to_numpy(), added["n"].to_numpy()
    counts = np.zeros(TABLE, np.int32)
    counts[at[at >= 0]] = np.minimum(n[at >= 0], 2**30 - 1)
    return counts, float(n[at < 0].sum())


def validate(words: DataFrame, model: Broadcast) -> tuple[float, dict[float, tuple[int, int, int, int]]]:
    """The margin to use, and for each margin: held-out sound words, those changed, words garbled on purpose, those restored.

    Held-out words with signs, or that a chain makes likelier by twice the least margin, are not taken for sound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*model.value)
        tally = {x: [0, 0, 0, 0] for x in MARGINS}
        for batch in batches:
            for word in batch.column(0).to_pylist():
                if has_signs(word) or doubtful(word, m):
                    continue
                spoilt = {got[0] for wrong, right in CHAINS if (data := encode_as(word, right)) and (got := decode_as(data, wrong)) and not got[1] and got[0] != word and not got[0].isascii()}
                for margin, t in tally.items():
                    t[0] += 1
                    t[1] += _best(" ", word, " ", m, margin) is not None
                    t[2] += len(spoilt)
                    t[3] += sum(bool(best := _best(" ", x, " ", m, margin)) and best[0] == word for x in spoilt)
        yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.float64()), *(pa.array([t[i] for t in tally.values()], pa.int64()) for i in range(4))], ["margin", "a", "b", "c", "d"])

    sums = spread(_held_out(words, True)).mapInArrow(run, "margin double, a bigint, b bigint, c bigint, d bigint").groupBy("margin").agg(*[F.sum(x).alias(x) for x in "abcd"]).collect()
    tally = {r["margin"]: (r["a"], r["b"], r["c"], r["d"]) for r in sums}
    fit = [m for m in MARGINS if m in tally and tally[m][1] <= FALSE_RATE * tally[m][0]]
    return (fit[0] if fit else MARGINS[-1]), tally


def _candidates(piece: str) -> Iterator[tuple[str, str, int]]:
    """(text, chain, bytes lost) of every chain that applies to the piece."""
    known: dict[str, bytes | None] = {}
    seen = {piece}
    used = {c for c in piece if c > "\x7f"}
    for wrong, right in CHAINS:
        if wrong not in known:
            known[wrong] = encode_as(piece, wrong) if wrong in DOUBLE or used <= _table(wrong).keys() else None
        data = known[wrong]
        if data is None:
            continue
        got = decode_as(data, right)
        if got and got[0] not in seen:
            seen.add(got[0])
            yield got[0], f"{wrong}>{right}", got[1]
            if right == "utf-8" and not got[0].isascii():
                again = encode_as(got[0], wrong)
                twice = again and decode_as(again, right)
                if twice and twice[0] not in seen:
                    seen.add(twice[0])
                    yield twice[0], f"{wrong}>{right}>{wrong}>{right}", twice[1] + got[1]


_EASTERN = re.compile("[぀-ヿ㐀-䶿一-鿿가-힯]")
_CYRILLIC, _MIXED = re.compile("[Ѐ-ӿ]{3,}"), re.compile("[Ѐ-ӿ][A-Za-zÀ-ɏ]|[A-Za-zÀ-ɏ][Ѐ-ӿ]")


def _is_mixture(text: str) -> bool:
    """Cyrillic and Latin letters in one word, or no Cyrillic word at all: nobody writes so."""
    return bool(_MIXED.search(text)) or any("Ѐ" <= c <= "ӿ" for c in text) and not _CYRILLIC.search(text)


def _best(left: str, piece: str, right: str, model: Model, margin: float) -> tuple[str, str, int] | None:
    """The accepted candidate of a piece that stands between two characters; it has to win by the margin."""
    own = model.score(left + piece + right)
    best, most = None, own
    for text, chain, lost in _candidates(piece):
        if "�" in text or _C1.search(text) or _is_mixture(text):
            continue
        if chain.rpartition(">")[2] in DOUBLE and not _EASTERN.search(text):
            continue
        if "──" in piece and "──" not in text:  # a drawn line; no encoding has a letter there that is doubled
            continue
        if len(_BOXES.findall(text)) > len(_BOXES.findall(piece)) + text.count("──"):
            continue
        s = model.score(left + text + right) - 8.0 * lost - UNLIKELY.get(chain.rpartition(">")[2], 0.0)
        if s > most:
            best, most = (text, chain, lost), s
    changed = sum(1 for c in piece if c > "\x7f" and not c.isspace())
    if best and changed and most - own > margin * max(1.0, 0.2 * changed):
        return best
    return None


def _spoils(chain: str, piece: str, model: Model) -> bool:
    """Whether the chain, accepted for a line, makes one of its sentences less likely: a sound one among garbled ones."""
    for m in _SENTENCE.finditer(piece):
        sentence = done = m.group()
        names = chain.split(">")
        for wrong, right in zip(names[::2], names[1::2]):
            data = encode_as(done, wrong)
            got = decode_as(data, right) if data is not None else None
            if got is None:
                break
            done = got[0]
        else:
            if model.score(done) < model.score(sentence) - MARGINS[1]:
                return True
    return False


def repair(text: str | None, model: Model, margin: float = MARGINS[1]) -> tuple[bool, str | None, str, bool]:
    """(garbled, restored text, chains used, whether it is wholly restored) of a text.

    Lines with a suspicious character are looked at; the line, its sentences, runs of one script within these and words are
    tried in turn, the larger pieces first.
    """
    if not text or text.isascii():
        return False, text, "", True
    at, value = model.places(text)
    return _repair(text, at[value < USUAL], model, margin)


def _repair(text: str, suspicious: np.ndarray, model: Model, margin: float) -> tuple[bool, str, str, bool]:
    """``repair``, given where the suspicious characters are."""
    chains: set[str] = set()
    lossy = False

    def fix(piece: str, level: int, left: str, right: str) -> tuple[str, bool, frozenset]:
        """(text, whether bytes are lost, chains) of a piece; remembered, as pieces recur."""
        if piece.isascii():
            return piece, False, frozenset()
        key = (left, piece, right, level)
        known = model.done.get(key)
        if known is None:
            known = _fix(piece, level, left, right)
            if len(model.done) > 100_000:
                model.done.clear()
            model.done[key] = known
        return known

    def _fix(piece: str, level: int, left: str, right: str) -> tuple[str, bool, frozenset]:
        if model.worst(left + piece + right) >= USUAL:
            return piece, False, frozenset()
        found = _best(left, piece, right, model, margin)
        if found and (level > 0 or not _spoils(found[1], piece, model)):
            return found[0], found[2] > 0, frozenset((found[1],))
        if level == len(_CUTS):
            return piece, False, frozenset()
        out, at, lost, used = [], 0, False, frozenset()
        for m in _CUTS[level].finditer(piece):
            i, j = m.span()
            part, gone, names = fix(m.group(), level + 1, piece[i - 1] if i else left, piece[j] if j < len(piece) else right)
            out += [piece[at:i], part]
            lost, used, at = lost or gone, used | names, j
        return "".join(out) + piece[at:], lost, used

    out, done = [], 0
    for i in suspicious.tolist():
        if i < done:
            continue
        start = max(text.rfind("\n", 0, i), text.rfind("\r", 0, i)) + 1
        ends = [e for e in (text.find("\n", i), text.find("\r", i)) if e >= 0]
        end = min(ends, default=len(text))
        line, gone, names = fix(text[start:end], 0, " ", " ")
        out += [text[done:start], line]
        chains |= names
        lossy, done = lossy or gone, end
    restored = "".join(out) + text[done:]
    left = "�" in restored or bool(_C1.search(restored))
    garbled = bool(chains) or "�" in text or bool(_C1.search(text))
    return garbled, restored, ",".join(sorted(chains)), not left and not lossy


def doubtful(text: str, model: Model) -> list[tuple[int, int]]:
    """The lines, sentences, script runs and words of the text that a chain makes likelier by twice the least margin.

    Lines and sentences are all scored, as garbled text that is usual here is not suspicious; their parts if suspicious."""
    out: list[tuple[int, int]] = []

    def look(at: int, end: int, level: int) -> None:
        piece = text[at:end]
        if piece.isascii():
            return
        left, right = text[at - 1] if at else " ", text[end] if end < len(text) else " "
        if level > 1 and model.worst(left + piece + right) >= USUAL:
            return
        if _best(left, piece, right, model, 2 * MARGINS[0]):
            out.append((at, end))
        elif level < len(_CUTS):
            for m in _CUTS[level].finditer(piece):
                look(at + m.start(), at + m.end(), level + 1)

    for m in _PIECES.finditer(text):
        look(*m.span(), 0)
    return out


def restore(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, restored, chains, whole) of the garbled documents."""
    spark = documents.sparkSession
    words = distinct_words(documents, text)
    trained, without = (spark.sparkContext.broadcast(x) for x in train(words))
    margin, _ = validate(words, without)
    source = spread(documents.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(key, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*trained.value)
        for batch in batches:
            keep, out = [], ([], [], [])
            texts = batch.column(1).to_pylist()
            # all texts of the batch are scored in one go
            at, value = model.places("\n".join(texts))
            bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
            bad = at[value < USUAL]
            part = np.searchsorted(bad, bounds)
            for i, t in enumerate(texts):
                own = bad[part[i] : part[i + 1]] - bounds[i]
                if not len(own) and "�" not in t and not _C1.search(t):
                    continue
                garbled, restored, chains, whole = _repair(t, own, model, margin)
                if garbled:
                    keep.append(i)
                    for c, v in zip(out, (restored, chains, whole)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.bool_())], [key, "restored", "chains", "whole"])

    schema = source.select(key).schema.add("restored", "string").add("chains", "string").add("whole", "boolean")
    return source.mapInArrow(run, schema)
