"""Co-training: exchange of labels, held-out quality, odd rows."""

import numpy as np

from eventfold.llm import cotrain
from eventfold.llm.base import table


def test_views_teach_each_other():
    """Few labels; the content view separates, the metadata view only knows what content does not say."""
    rng = np.random.default_rng(0)
    n = 2000
    y = rng.integers(0, 2, n)
    a = np.c_[6 * y + rng.normal(0, 1, n), rng.normal(0, 1, n)]
    b = np.c_[3 * y + rng.normal(0, 1, n), rng.normal(0, 1, (n, 30))]
    few = np.r_[np.flatnonzero(y == 0)[:10], np.flatnonzero(y == 1)[:10]]
    rest = np.setdiff1d(np.arange(n), few)

    def accuracy(rounds):
        models = cotrain.co_train((a[few], b[few]), y[few].astype(float), np.ones(len(few)), (a[rest], b[rest]), rounds)
        return np.mean((cotrain.log_odds(b[rest], models[1]) > 0) == y[rest])

    assert accuracy(8) > accuracy(0) + 0.05 and accuracy(8) > 0.9


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    quality = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    rows = [r for r in cotrain.op1(spark, sf).collect() if r.held_out and r.doc_id in quality]
    assert np.mean([r.predicted == quality[r.doc_id] for r in rows]) > 0.95
    good = [r for r in rows if quality[r.doc_id] == 1]
    assert np.mean([r.kept for r in good]) > 0.97


def test_odd_rows(spark, docs):
    rows = docs([(1, None), (2, ""), (None, "x"), (3, "a " * 60000), (3, "a " * 60000), (4, "plain words here")])
    for marks in ([], [(1, None, 0)], [(1, 0, 0)], [(1, 0, 0), (4, 1, 0)], [(1, 0, 0), (2, 0, 1), (4, 1, 0), (None, 1, 0)]):
        labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
        got = cotrain.score(rows, cotrain.fit(rows, labels)).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    none = rows.where("false")
    assert cotrain.score(none, cotrain.fit(none, labels)).collect() == []
