"""Decontamination against a sequential model."""

import re

from eventfold.llm import decontam

ITEM = "bigint"


def model_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def model(docs, items):
    out = []
    for d, text in docs:
        w = model_words(text)
        hit, ids = set(), set()
        for i, item in items:
            iw = model_words(item)
            for a in range(max(1, len(iw) - 9) if iw else 0):
                win = iw[a : a + 10]
                for s in range(len(w) - len(win) + 1):
                    if w[s : s + len(win)] == win:
                        hit.update(range(s, s + len(win)))
                        ids.add(str(i))
        out.append((d, len(w), len(hit), sorted(ids)))
    return sorted(out, key=repr)


LONG = "Alpha beta, the GAMMA delta of the epsilon zeta-eta theta iota kappa Ä lambda the mu"
ITEMS = [(1, LONG), (2, "short one"), (3, "Ünïcode9 x"), (4, None), (5, "..."), (1, LONG), (10, "the the the the the the the the the the the"), (6, "solo")]
DOCS = [
    (1, "x " + LONG.upper().replace("Ä", "Ä") + " y"), (2, None), (3, ""), (4, "short  ONE short one"), (4, "other short one text"), (5, "the " * 40),
    (6, "solo Solo so lo"), (6, "solo Solo so lo"), (None, "the ünïcode9.x"), (7, "Alpha beta the GAMMA delta of the epsilon zeta nothing"), (8, "w " * 50000 + LONG),
]


def items_df(spark, rows):
    return spark.createDataFrame([(i, t, "z") for i, t in rows], "item_id bigint, text string, doc_id string")


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in df.collect()), key=repr)


def test_against_model(spark, docs):
    assert got(decontam.contamination(docs(DOCS), items_df(spark, ITEMS))) == model(DOCS, ITEMS)


def test_blocks_give_the_same(spark, docs, monkeypatch):
    monkeypatch.setattr(decontam.blocks, "__defaults__", (10, 40))
    assert len(list(decontam.blocks(items_df(spark, ITEMS)))) > 2
    assert got(decontam.contamination(docs(DOCS), items_df(spark, ITEMS))) == model(DOCS, ITEMS)


def test_empty_tables(spark, docs):
    some = docs([(1, "a b"), (2, None)])
    assert got(decontam.contamination(some, items_df(spark, []))) == [(1, 2, 0, []), (2, 0, 0, [])]
    assert got(decontam.contamination(some.where("false"), items_df(spark, ITEMS))) == []


def test_proximity(spark, docs):
    item = "one two three four five six seven eight nine ten"
    rows = [(1, "one two x three four five six seven eight nine ten"), (2, item), (3, "ten nine eight seven six five four three two one"), (4, "one two three four five six seven eight nine")]
    _, found = decontam.matches(docs(rows), items_df(spark, [(9, item)]), slop=2)
    assert {(r.doc_id, r.phrase) for r in found.collect()} == {(1, False), (2, True), (3, False)}
