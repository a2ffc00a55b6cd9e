from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import tokens as K

tokenizers = pytest.importorskip("tokenizers")
pytestmark = pytest.mark.skipif(not Path(K.VOCABULARY).exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return K.TrieEncoder(K.read_ranks())


def encode(encoder, text):
    import regex

    words = regex.findall(K.WORDS, text)
    ids = encoder.encode_all(set(words))
    return [i for w in words for i in ids[w]]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(encoder, reference, text):
    assert encode(encoder, text) == reference(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abeinrst'ABET 012 \n_-.,", max_size=200))
def test_wordlike_text(encoder, reference, text):
    assert encode(encoder, text) == reference(text)


def test_prefix_states_agree_with_plain_merging(encoder):
    words = {"un", "unbelievable", "unbelievably", "believe", "x" * 500, "0" * 3000, "ab" * 400, "ö" * 50}
    got = encoder.encode_all(words)
    for w in words:
        assert list(got[w]) == encoder.merge(w.encode())


def test_rows(spark, reference):
    rows = [(1, "Hello world, isn't it?  <|endoftext|>\n", "x"), (2, None, "x"), (3, "", None), (4, "  \t\n", None), (5, "日本語 текст 🌾👍🏽" * 300, None), (6, "1" * 20000, None), (6, "again", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"], list(r["ids"])) for r in K.encode(df).collect())
    assert got == sorted((d, reference(t) if t else []) for d, t, _ in rows)
    assert K.encode(df.limit(0)).count() == 0
