"""The network's gradients and look-up tables, and held-out accuracy."""

import numpy as np

from eventfold.llm import bytecnn
from eventfold.llm.base import table


def test_gradients():
    rng = np.random.default_rng(1)
    net = bytecnn.Network(["a", "b", "c"])
    for x in net.parameters():
        x += rng.normal(0, 0.1, x.shape).astype(np.float32)
    net.filters *= net.mask[:, None]
    rows, label = rng.integers(0, 256, (6, bytecnn.WINDOW), dtype=np.uint8), np.array([0, 1, 2, 0, 1, 2])
    for name in ("embed", "filters", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    grads, _ = net.step(rows, label)
    for x, g in zip(net.parameters(), grads):
        for k in np.argsort(-np.abs(g).ravel())[:4]:
            old, e = x.flat[k], 1e-5
            x.flat[k] = old + e
            up = net.step(rows, label)[1]
            x.flat[k] = old - e
            down = net.step(rows, label)[1]
            x.flat[k] = old
            assert abs((up - down) / (2 * e) - g.flat[k]) < 1e-3


def test_tables_equal_convolution():
    rng = np.random.default_rng(2)
    net = bytecnn.Network(["a", "b"])
    rows = rng.integers(0, 256, (40, bytecnn.WINDOW), dtype=np.uint8)
    pooled = np.maximum(net.responses(rows).max(1), 0)
    want = bytecnn.softmax(pooled @ net.out + net.out_bias)
    assert np.allclose(bytecnn.Reader(net).probabilities(rows), want, atol=1e-4)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    lang = {r.doc_id: r.lang for r in table(spark, sf, "documents").collect()}
    got = [r for r in bytecnn.op9(spark, sf).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.lang_pred != "und"]) > 0.97


def test_odd_rows(spark, docs):
    rows = docs([(1, None), (2, ""), (None, "123 !"), (3, "é"), (3, "word " * 50000), (4, "z" * 256)])
    got = bytecnn.identify(rows, bytecnn.fit(rows)).collect()
    assert {(r.doc_id, r.lang_pred) for r in got} == {(1, "und"), (2, "und"), (None, "und"), (3, "en"), (4, "en")}
    assert sum(r.n_windows for r in got if r.doc_id == 3) == 1 + 977
    assert all(0 <= r.score <= 1 for r in got)
    none = rows.where("false")
    assert bytecnn.fit(none) is None and bytecnn.identify(none, None).collect() == []
    assert {r.lang_pred for r in bytecnn.identify(rows, None).collect()} == {"und"}
