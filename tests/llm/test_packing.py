"""Packing: a model of the rule on small counts, invariants on tables."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from eventfold.llm import packing
from eventfold.llm.base import table


def check(rows, capacities):
    bins = defaultdict(list)
    for r in rows:
        if r["length"]:
            bins[r["bin"]].append((r["offset"], r["length"], r["capacity"]))
    assert sorted(bins) == list(range(len(bins)))
    for own in bins.values():
        at = 0
        for offset, length, _ in sorted(own):
            assert offset == at
            at += length
        assert {c for _, _, c in own} == {min(c for c in capacities if c >= at)}
    return bins


def waste(counts, capacities):
    """Tokens of padding under the same rule, one piece at a time."""
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [b for b in bins if b[0] - b[1] >= length]
            if not fits:
                size = min((s for s in sorted(capacities) if s >= length), key=lambda s: ((s + 4) / (s // length * length), s))
                bins.append(fits_one := [size, 0])
                fits = [fits_one]
            min(fits, key=lambda b: b[0] - b[1])[1] += length
    return sum(min(c for c in capacities if c >= used) - used for _, used in bins)


@pytest.mark.parametrize("seed", range(30))
def test_rule_on_small_counts(seed):
    rng = random.Random(seed)
    capacities = (8, 16, 40)
    counts = {n: rng.randrange(1, 30) for n in rng.sample(range(1, 41), rng.randrange(1, 20))}
    plan = packing.best_fit(counts, capacities, 4)
    rows = []
    for n, k in counts.items():
        import numpy as np

        own = plan.place(np.full(k, n), np.arange(k))
        rows += [{"length": n, "bin": b, "capacity": c, "offset": o} for b, c, o in zip(*(x.tolist() for x in own))]
    bins = check(rows, capacities)
    padding = sum(own[0][2] - sum(x[1] for x in own) for own in bins.values())
    one = waste(counts, capacities)
    total = sum(n * k for n, k in counts.items())
    assert abs(padding - one) <= 0.1 * total  # equal rooms may be taken in another order


def test_sf(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = packing.pack(docs).collect()
    bins = check(rows, packing.CAPACITIES)
    tokens = defaultdict(int)
    for r in rows:
        tokens[r.doc_id] += r.length
    want = {r.doc_id: len(re.findall(r"[^\W\d_]+|\d+|[^\s\w]|_", r.text)) for r in docs.collect()}
    assert tokens == want
    assert sum(want.values()) / sum(b[0][2] for b in bins.values()) > 0.95


def test_odd_rows(spark, docs):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "w " * 9000), (3, "w " * 9000), (4, " \n")]
    got = packing.pack(docs(rows)).collect()
    check(got, packing.CAPACITIES)
    assert sum(r.length for r in got) == 18002 and sum(r.bin is None for r in got) == 3
    assert packing.pack(docs(rows).where("false")).collect() == []
    own = packing.pack(docs(rows), F.lit(7), (8,)).collect()
    assert len({r.bin for r in own}) == 6
