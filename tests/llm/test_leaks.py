import random

from tidewell.llm import leaks as L

W = "arm average ledger trial ferry crew window offset bridge reopened kiln lamp wear matched pair level found coarse sparse uneven ward station plots gaps moved survey share profile rose tide lag hive mass reading speed".split()


def item(i):
    r = random.Random(i)
    return " ".join(r.choice(W) + (f" Name{r.randrange(9999)}" if k % 3 == 0 else f" {r.randrange(999)}") for k in range(15))


def brute(doc, it, east=False):
    """Whether some span of the item is in some part of the document within the allowed changes, by edit distance."""
    d, t = L.words(doc), L.words(it)
    span, per = (40, 12) if east else (20, 7)
    span = min(span, len(t))
    for i in range(len(t) - span + 1):
        row = [0] * (len(d) + 1)
        for n, a in enumerate(t[i:], 1):
            prev, row[0] = row[0], row[0] + 1
            for j in range(1, len(d) + 1):
                prev, row[j] = row[j], min(prev + (a != d[j - 1]), row[j] + 1, row[j - 1] + 1)
            if n >= span and min(row) * per <= n:
                return True
    return False


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, text string, doc_id string")
    return {(r["doc_id"], r["item_id"]) for r in L.leaks(d, i).collect()}


def test_words():
    assert L.words("<b>Ärm</b> A-\nverage, 64.47 **x_y** soft­hyphen！") == ["ärm", "average", "64", "47", "x_y", "softhyphen"]
    assert L.words("E组67.1") == ["e", "组", "67", "1"] and L.words(None) == []


def test_whole_partial_changed_and_similar(spark):
    items = [(i, item(i), None) for i in range(6)] + [(7, "E组阅读速度为六七十八棠浔镇的五百名织工只有四十七点五三在浔岚村八百船员分成四百组峤黎镇记下等候时间均值七点七九第七百天", None), (8, None, None), (9, "", None), (10, "short but whole text of few words", None)]
    t = [x[1] for x in items]
    w = t[1].split()
    changed = [x if k % 9 else "changed" for k, x in enumerate(w)]
    heavy = [x if k % 3 else "changed" for k, x in enumerate(w)]
    pad = "Nothing here matters much to anyone at all. " * 5
    docs = [
        (0, pad + t[0].upper().replace(" ", "\n") + pad), (1, pad + " ".join(changed) + pad), (2, pad + " ".join(heavy) + pad), (3, pad + " ".join(t[2].split()[5:27])), (4, " ".join(t[2].split()[5:20]) + pad),
        (5, "开头" + t[6].replace("八", "，八") + "结尾"), (6, "开头" + t[6][3:30] + "结尾"), (7, None), (8, ""), (9, t[3] + pad + t[4]), (10, pad + t[9] + pad), (11, pad * 200 + "**" + t[5].replace(" ", "** ", 3) + pad * 200),
    ]
    got = run(spark, [(*d, "clash") for d in docs], items)
    want = {(d, i) for d, text in docs for i, it, _ in items if text and it and brute(text, it, i == 7)}
    assert got == want and {(0, 0), (1, 1), (3, 2), (5, 7), (9, 3), (9, 4), (10, 10), (11, 5)} == got


def test_random_edits_agree_with_brute_force(spark):
    r = random.Random(3)
    items = [(i, item(i + 50), None) for i in range(8)]
    docs = []
    for d in range(60):
        w = items[r.randrange(8)][1].split()
        a = r.randrange(0, 12)
        w = w[a : a + r.randrange(14, 34)]
        for _ in range(r.randrange(0, 6)):
            k = r.randrange(len(w))
            w = r.choice([w[:k] + ["zzz"] + w[k:], w[:k] + w[k + 1 :], w[:k] + ["yyy"] + w[k + 1 :]])
        docs.append((d, "pad words before it " + " ".join(w) + " and some after it", None))
    got = run(spark, docs, items)
    want = {(d, i) for d, text, _ in docs for i, it, _ in items if brute(text, it)}
    assert len(want) > 15 and len(got ^ want) <= 2 and len(got & want) >= 0.95 * len(want)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "x y z", None)]) == set() and run(spark, [(1, "x", None)], []) == set()
