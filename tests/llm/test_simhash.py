"""SimHash fingerprints and components against a sequential model."""

import random

import numpy as np
import pytest
import xxhash

from eventfold.llm import simhash
from eventfold.llm.base import table


def model_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def model_components(rows):
    prints = [model_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(
        ((d, f"{prints[i]:016x}", min((x for x in groups[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)), key=repr
    )


def got(df):
    return sorted(((r.doc_id, f"{r.fp % 2**64:016x}", r.component_id) for r in df.collect()), key=repr)


def test_sf_against_model(spark):
    df = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got(simhash.near_duplicates(df)) == model_components(rows)


def test_odd_rows(spark, docs):
    rows = [(1, None), (2, ""), (None, " \n\t"), (4, "One"), (5, "one"), (6, "a b"), (7, "A b c d"), (8, "É é x"), (8, "É é x"), (9, "w " * 70000), (None, "alone here now")]
    assert got(simhash.near_duplicates(docs(rows))) == model_components(rows)


def test_empty(spark, docs):
    assert simhash.near_duplicates(docs([(1, "a")]).where("false")).collect() == []


@pytest.mark.parametrize("piece", [8, 1 << 14])
def test_long_buckets(spark, monkeypatch, piece):
    """Clusters around a few centres, with buckets far longer than a piece."""
    monkeypatch.setattr(simhash, "PIECE", piece)
    rng = random.Random(5)
    prints = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(40):
            x ^= (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            prints.add(x)
            prints.add(x ^ (1 << rng.randrange(64)) ^ 15 << rng.randrange(60))
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    keyed = [(0, 7, p) for p in signed]
    import pyarrow as pa

    cols = list(zip(*keyed))
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["choice", "key", "fp"])
    found = pa.Table.from_batches(list(simhash.over_buckets(2, piece, simhash._compare, simhash._LINK)(iter([batch]))), schema=simhash._LINK).to_pylist()
    pairs = {(r["a"], r["b"]) for r in found if r["piece"] < 0}
    pieces = {}
    for r in found:
        if r["piece"] >= 0:
            pieces.setdefault(r["piece"], []).append(r["a"])
    if piece == 8:
        assert len(pieces) > 2 and not pairs
    for i in pieces:
        for j in range(i + 1):
            rows = [(1, j, i, p, x) for p in {i, j} for x in pieces[p]]
            b = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=list("gijpf"))
            for out in simhash._piece_links(iter([b])):
                pairs |= set(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))
    u = {p: s for p, s in zip(signed, prints)}
    assert all((u[a] ^ u[b]).bit_count() <= 3 for a, b in pairs)

    def classes(edges):
        parent = {p: p for p in signed}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[find(a)] = find(b)
        return {frozenset(x for x in signed if find(x) == r) for r in map(find, signed)}

    want = [(a, b) for a in signed for b in signed if a < b and (u[a] ^ u[b]).bit_count() <= 3]
    assert classes(pairs) == classes(want)


def test_blocks_cover_every_pair():
    rng = random.Random(3)
    for blocks in (4, 5, 6, 7):
        masks = simhash.block_masks(blocks)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for k in rng.sample(range(64), 3):
                b ^= 1 << k
            assert any(a & m == b & m for m in masks)
    assert simhash.blocks_for(10**3) == 4 < simhash.blocks_for(10**8) < simhash.blocks_for(10**11)
