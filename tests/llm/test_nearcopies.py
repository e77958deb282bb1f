"""Near copies against brute force over all pairs of texts."""

import random

import numpy as np
import pytest

from eventfold.llm import nearcopies as N
from eventfold.llm.simhash import planes_of

DRAW = random.Random(23)


def prose(n):
    return ["".join(DRAW.choice("abcdefghijklmnop") for _ in range(DRAW.randrange(3, 9))) for _ in range(n)]


def edited(words, share):
    return [DRAW.choice("xyz") + w if DRAW.random() < share else w for w in words]


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (a.lower().split(), b.lower().split())]
    either = len(sets[0] | sets[1])
    return len(sets[0] & sets[1]) / either if either else 1.0


def brute(texts):
    """Groups of places of texts linked at the similarity."""
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= N.SIMILARITY:
                root[find(i)] = find(j)
    return sorted(sorted(j for j in range(len(texts)) if find(j) == i) for i in range(len(texts)) if find(i) == i)


def groups(found):
    by = {}
    for r in found.collect():
        by.setdefault(r.root, []).append(r.doc_id)
    return sorted(sorted(x) for x in by.values())


def corpus():
    texts = [" ".join(prose(DRAW.randrange(30, 300))) for _ in range(40)]
    for _ in range(90):
        base = DRAW.choice(texts[:12]).split()
        texts.append(" ".join(edited(base, DRAW.choice([0.005, 0.01, 0.02, 0.05, 0.2]))))
    return texts + [texts[0].upper(), texts[1], "", " \n", "one two", "one two", "one two three"]


@pytest.mark.parametrize("most", [256, 4])
def test_groups_equal_brute_force(spark, docs, monkeypatch, most):
    monkeypatch.setattr(N, "ALL_PAIRS", most)
    monkeypatch.setattr(N, "REST_PIECE", 3)
    texts = corpus()
    assert groups(N.near_groups(docs(list(enumerate(texts))))) == brute(texts)


def test_long_buckets_in_pieces(spark, docs, monkeypatch):
    """More copies of one text than a piece holds, each with edits of its own, still are one group."""
    monkeypatch.setattr(N, "ALL_PAIRS", 8)
    monkeypatch.setattr(N, "PIECE", 64)
    base = prose(400)
    texts = [" ".join(edited(base, 0.006)) for _ in range(300)] + [" ".join(prose(400)) for _ in range(20)]
    found = groups(N.near_groups(docs(list(enumerate(texts)))))
    assert len(found) == 21 and max(map(len, found)) == 300


@pytest.mark.parametrize("radius", [3, 6, 12, 20])
def test_bit_planes_give_hamming_distance(radius):
    draw = np.random.default_rng(radius)
    prints = draw.integers(0, 1 << 63, 500, dtype=np.uint64)
    prints[1::2] = prints[::2] ^ np.array([sum(1 << int(b) for b in draw.choice(64, draw.integers(0, 30), False)) for _ in range(250)], np.uint64)
    planes = planes_of(prints)
    for step in (1, 2, 64, 77, 499):
        want = np.flatnonzero(np.bitwise_count(prints[:-step] ^ prints[step:]) <= radius)
        assert N.within(planes, step, 500, radius).tolist() == want.tolist()


def test_nulls_repeats_and_empty_table(spark, docs):
    a, b = " ".join(prose(50)), " ".join(prose(50))
    found = N.near_groups(docs([(None, a), (None, b), (1, a), (1, a), (2, None), (3, "")])).collect()
    assert len(found) == 6
    roots = {}
    for r in found:
        roots.setdefault(r.root, []).append(r.doc_id)
    assert sorted(map(len, roots.values())) == [1, 2, 3]
    assert N.near_groups(docs([])).count() == 0


def test_groups_of_a_long_bucket_meet(spark):
    """Two groups joined to their leaders only, whose other members are near copies of each other."""
    texts = {i: " ".join(prose(60)) for i in range(1, 41)}
    texts[40] = texts[20] + " tail"
    keyed = spark.createDataFrame([(i, i, t) for i, t in texts.items()], "doc_id bigint, part bigint, text string")
    prints = {i: N.simhash(N.shingles(t.encode())) for i, t in texts.items()}
    members = spark.createDataFrame([(7, i, p - (1 << 64) if p >> 63 else p) for i, p in prints.items()], "key bigint, part bigint, fp bigint")
    links = spark.createDataFrame([(1, i) for i in range(2, 21)] + [(21, i) for i in range(22, 41)], "a bigint, b bigint")
    found = N._rest_links(members, links, keyed, keyed.selectExpr("part", "doc_id AS first"))
    assert {tuple(sorted(r)) for r in found.collect()} == {(20, 40)}
