import random

import numpy as np
import pytest

from tidewell.llm import garbled as G

SENTENCES = {
    "de": ["Die Übersicht zeigt {} Zeilen und ändert ihre Reihenfolge nicht.", "Öffnen Sie die Prüfansicht, falls {} läuft.", "Führen Sie {} über den Schlüssel zusammen.", "Größe und Länge wurden später geprüft, während {} schief blieb."],
    "fr": ["La médiane de {} était élevée après le début.", "Les élèves exigent {} relevés séparés à la fin.", "Une clé répétée multiplie les lignes où {} paraît bruitée."],
    "zh": ["运行线性回归之前，请先把{}标记为数值列。", "如果不考虑{}，效应会被高估。", "节点可以直接读取{}，不过先做快照会更快。"],
    "ru": ["После дня {} показатель вырос на станции.", "Предпросмотр показывает {} строк и не меняет порядок."],
    "en": ["The “{}” level isn’t old – it’s the code for café data at 5 °C.", "A plain sentence about {} rows with nothing special."],
}


def corpus(n=1500):
    r = random.Random(1)
    out = []
    for i in range(n):
        lang = r.choice(list(SENTENCES))
        out.append((i, " ".join(r.choice(SENTENCES[lang]).format(r.randrange(1000)) for _ in range(r.randrange(1, 5)))))
    return out


CHAINS = [("utf-8", "cp1252", "de"), ("utf-8", "latin-1", "fr"), ("utf-8", "cp437", "de"), ("utf-8", "mac_roman", "fr"), ("utf-8", "cp1251", "fr"), ("cp1252", "cp437", "de"), ("cp1252", "mac_roman", "de"), ("gbk", "latin-1", "zh"), ("cp1251", "latin-1", "ru"), ("utf-8", "cp850", "ru")]


def garble(text, right, wrong):
    data = text.encode(right)
    if wrong in G.SINGLE:
        back = {v: k for k, v in G._table(wrong).items()}
        return "".join(back[bytes([b])] for b in data)
    return data.decode(wrong)


@pytest.fixture(scope="module")
def found(spark):
    clean = corpus()
    bad = []
    for k, (right, wrong, lang) in enumerate(CHAINS):
        for j in range(4):
            text = SENTENCES[lang][j % len(SENTENCES[lang])].format(100 * k + j)
            bad.append((10_000 + 10 * k + j, clean[k][1] + "\n" + garble(text, right, wrong), clean[k][1] + "\n" + text))
    odd = [(20_000, None), (20_001, ""), (20_002, "a�b is lost"), (20_003, "plain ascii"), (20_004, "datasets\n├── x\n│   └── y"), (20_005, "Café with a combining mark"), (20_006, "nul\x85line"), (20_007, "über " * 20_000)]
    df = spark.createDataFrame([(*r, "clash") for r in clean + [(b[0], b[1]) for b in bad] + odd], "doc_id bigint, text string, whole string")
    return clean, bad, {r["doc_id"]: r for r in G.restore(df).collect()}


def test_garbled_texts_are_found_and_restored(found):
    clean, bad, got = found
    hit = [b for b in bad if b[0] in got]
    assert len(hit) >= 0.9 * len(bad)
    assert sum(got[b[0]]["restored"] == b[2] for b in hit) >= 0.85 * len(hit)


def test_clean_texts_are_left_alone(found):
    clean, _, got = found
    assert sum(c[0] in got for c in clean) <= 2


def test_odd_texts(found):
    _, _, got = found
    assert 20_002 in got and not got[20_002]["whole"]
    assert not [(i, got[i]["chains"], got[i]["restored"][:60]) for i in (20_000, 20_001, 20_003, 20_004, 20_005, 20_006, 20_007) if i in got]


def test_encodings_round_trip():
    for e in G.SINGLE:
        data = bytes(range(256))
        text = "".join({v: k for k, v in G._table(e).items()}[bytes([b])] for b in data if bytes([b]) in G._table(e).values())
        assert G.encode_as(text, e) == bytes(b for b in data if bytes([b]) in G._table(e).values())
    assert G.encode_as("中", "cp1252") is None and G.decode_as(b"\xff", "utf-8") is None


def test_empty_table(spark):
    assert G.restore(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert G.Model(np.zeros(G.TABLE, np.int32), 0.0).score("é") < 0


def test_garbled_texts_do_not_train_the_model(spark):
    right = "Nobody{}’s naïve estimate was {}, ½ of what the café’s staff say."
    clean = [t for _, t in corpus()] + [right.format(i, i) for i in range(100)]
    bad = [garble(right.format(i, i), "cp1252", "cp437") for i in range(100, 115)]
    df = spark.createDataFrame(list(enumerate(clean + bad)), "doc_id bigint, text string")
    assert not any(G.has_signs(t) for t in bad)
    got = {r["doc_id"]: r["restored"] for r in G.restore(df).collect()}
    assert [got.get(len(clean) + i) for i in range(15)] == [right.format(100 + i, 100 + i) for i in range(15)] and len(got) == 15


def test_words_are_counted_once_with_their_number(spark):
    rows = [(1, "café x café\nété。中文。"), (2, "café"), (3, None), (4, "")]
    got = {r["word"]: r["n"] for r in G.distinct_words(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {"café": 3, "été。": 1, "中文。": 1}


def test_scores_of_many_and_of_single_characters_agree():
    r = np.random.default_rng(1)
    m = G.Model(r.integers(0, 50, G.TABLE).astype(np.int32), 1e6)
    text = "Größe 12 – naïve, 中文。字 Привет \U0001f600é" * 3
    at, value = m.places(text)
    assert m._each(text) == pytest.approx(list(value)) and m.score(text) == pytest.approx(value.sum())
    assert all(G._index(3, 97, ord(text[i]), 98) == G._indexes(3, np.array([97]), np.array([ord(text[i])]), np.array([98]))[0] for i in at)


def test_the_margin_is_validated_on_held_out_words(spark):
    words = G.distinct_words(spark.createDataFrame([(i, f"é{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}è ü{i}ö") for i in range(3000)], "doc_id bigint, text string"))
    whole, without = G.train(words)
    assert whole[1] > without[1] > 0.9 * whole[1]
    margin, tally = G.validate(words, spark.sparkContext.broadcast(without))
    sound, changed, spoilt, restored = tally[margin]
    assert margin in G.MARGINS and sound > 20 and changed <= G.FALSE_RATE * sound and spoilt > sound and restored > 0


def test_a_sound_sentence_among_garbled_ones_is_kept(spark):
    clean = corpus()
    model = G.Model(*G.train(G.distinct_words(spark.createDataFrame(clean, "doc_id bigint, text string")))[0])
    sound = SENTENCES["ru"][0].format(5)
    bad = " ".join(SENTENCES["ru"][i % 2].format(i) for i in range(4))
    assert G.repair(garble(bad, "koi8-r", "cp1251") + " " + sound, model)[1] == bad + " " + sound
