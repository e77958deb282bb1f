"""Whitening against a whole-number and numpy model."""

import numpy as np
import pytest

from eventfold.llm import whitening


def model(vectors, d):
    """Rows by position: (n, deviation, whitened list), explained, from the definition."""
    x = [[int(np.floor(256 * float(c))) for c in v] + [0] * (d - len(v)) for v in vectors]
    fit = np.array(sorted({tuple(v) for v in x}))
    n, s = len(fit), [int(t) for t in fit.sum(0)]
    off = fit - fit.mean(0)
    v = off.T @ off / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    deviation = [sum((n * a - t) ** 2 for a, t in zip(r, s)) for r in x]
    white = (np.array(x) - fit.mean(0)) @ u / np.sqrt(e)
    return n, deviation, white, e / np.trace(v)


def table(spark, vectors, ids=None, parts=5):
    rows = [(i if ids is None else ids[i], v, "x", 1, "k") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, x string, block int, key string").repartition(parts)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 6 * 7)  # seven rows of six numbers


def test_equals_model(spark, small_blocks):
    draw = np.random.default_rng(3)
    vectors = (draw.normal(size=(157, 6)) @ draw.normal(size=(6, 6))).tolist()
    vectors += vectors[:40] + [vectors[0]] * 100
    n, deviation, white, explained = model(vectors, 6)
    got = whitening.whiten(table(spark, vectors)).collect()
    assert len(got) == 4 * len(vectors) and {r.n for r in got} == {n} == {157}
    signs = {}
    for r in got:
        want = white[r.vec_id][r.component - 1]
        if abs(want) > 0.1:
            signs.setdefault(r.component, np.sign(want * r.whitened))
    for r in got:
        assert r.deviation == deviation[r.vec_id]
        assert r.whitened == pytest.approx(signs[r.component] * white[r.vec_id][r.component - 1], abs=1e-9)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9


def test_bad_vectors_short_vectors_and_repeated_ids(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0], None, [nan, 1.0], [1.0, None], [inf, 1.0], [0.5], [], [1.0, 2.0], [-0.25, 0.001]]
    got = whitening.whiten(table(spark, vectors, ids=[1, 2, 3, 4, 5, 6, 7, 1, None])).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i, c) for i in (1, 6, 7, 1, 0) for c in (1, 2))
    assert {r.n for r in got} == {4}
    by = {(r.vec_id, r.component): r for r in got}
    assert by[(7, 1)].deviation == (256 + 128 - 64) ** 2 + 512**2  # n * 0 - S with S = (320, 512)


def test_components_without_variance(spark):
    got = whitening.whiten(table(spark, [[float(i), 2.0 * i, 7.0] for i in range(5)])).collect()
    assert {r.component for r in got} == {1, 2, 3}
    assert all((r.whitened is None) == (r.component > 1) for r in got)
    assert all(r.identity_error < 1e-9 for r in got)
    got = whitening.whiten(table(spark, [[1.0, 2.0]] * 3)).collect()
    assert len(got) == 6 and all((r.whitened, r.explained, r.identity_error, r.n, r.deviation) == (None, None, None, 1, 0) for r in got)


def test_large_values_stay_exact(spark):
    vectors = [[1e15, 1.0], [-3e15, 2.0], [5.0, 1e30]]
    got = {r.vec_id: r.deviation for r in whitening.whiten(table(spark, vectors)).collect() if r.component == 1}
    assert got == {0: None, 1: None, 2: None}  # all beyond bigint
    vectors = [[3e5, 1.0], [-2e5, 2.0], [5.0, 1.0]]
    n, deviation, _, _ = model(vectors, 2)
    got = {r.vec_id: r.deviation for r in whitening.whiten(table(spark, vectors)).collect() if r.component == 1}
    assert got == dict(enumerate(deviation))


@pytest.mark.parametrize("vectors", [[], [[]], [None]])
def test_no_vectors(spark, vectors):
    got = whitening.whiten(table(spark, vectors))
    assert got.count() == 0
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_wide_vectors_use_several_column_blocks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_COLS", 4)
    draw = np.random.default_rng(5)
    vectors = draw.normal(size=(60, 11)).tolist()
    n, deviation, white, explained = model(vectors, 11)
    got = {(r.vec_id, r.component): r for r in whitening.whiten(table(spark, vectors)).collect()}
    assert len(got) == 240
    for (i, c), r in got.items():
        assert abs(r.whitened) == pytest.approx(abs(white[i][c - 1]), abs=1e-9)
        assert r.explained == pytest.approx(explained[c - 1], rel=1e-9)
