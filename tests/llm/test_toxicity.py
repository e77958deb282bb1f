"""The grammar on single clauses, and held-out quality of the learned score."""

from eventfold.llm import toxicity
from eventfold.llm.base import table

PLAIN = toxicity.Lexicon({"^chlla": 1.0})


def best(text):
    return max((s for _, _, s in toxicity.clauses(text, PLAIN)), default=0.0)


def test_grammar():
    assert best("nothing here") == best("") == 0
    assert best("the idiot") == 1
    assert best("you are an idiot") == 1.5
    assert best("you are not an idiot") == 0.75
    assert best("he said idiot") == 0.7
    assert best("he said. An idiot") == 1
    assert best("kill") == 0.3 < best("I will kill you") or best("kill you") == 0.3
    assert best("you I kill") == 1.5
    assert best("chllaente") == 1 and best("chlla") == 0


def test_spans_are_code_points():
    text = "Größe İ x. You IDIOT! fine"
    assert [text[a:b].strip() for a, b, _ in toxicity.clauses(text, PLAIN)] == ["You IDIOT"]


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    rows = [r for r in toxicity.op3(spark, sf).collect() if r.held_out and r.doc_id in labels]
    tp = sum(r.predicted and labels[r.doc_id] for r in rows)
    assert tp / sum(labels[r.doc_id] for r in rows) > 0.8
    assert tp / sum(r.predicted for r in rows) > 0.9


def test_odd_rows(spark, docs):
    rows = docs([(1, None), (2, ""), (None, "you idiot"), (3, "idiot " * 60000), (3, "idiot " * 60000)])
    labels = spark.createDataFrame([(1, 0, None), (2, 0, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = toxicity.score(rows, toxicity.fit(rows, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    none = rows.where("false")
    assert toxicity.score(none, toxicity.fit(none, labels)).collect() == []
