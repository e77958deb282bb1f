"""Line classes against a sequential model with a plain edit distance."""

import random

import numpy as np
import pytest

from eventfold.llm import linededup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def model(docs):
    """Kept text per document, for documents with different ids."""
    lines = []
    for d, text in docs:
        for k, x in enumerate((text or "").encode().split(b"\n")):
            if len(x) >= linededup.MIN_BYTES:
                lines.append(((d is not None, d or 0, k), x))
    lines.sort(key=lambda x: x[0])
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            if find(i) != find(j) and abs(len(lines[i][1]) - len(lines[j][1])) <= 2 and distance(lines[i][1], lines[j][1]) <= 2:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    gone = {lines[i][0] for i in range(len(lines)) if find(i) != i}
    out = []
    for d, text in docs:
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (d is not None, d or 0, k) not in gone)
        out.append((d, kept))
    return sorted(out, key=repr)


def mutate(rng, line, n):
    line = list(line)
    for _ in range(n):
        at = rng.randrange(len(line) + 1)
        kind = rng.randrange(3)
        if kind == 0:
            line.insert(at, rng.choice("abcxyz é"))
        elif line:
            at = min(at, len(line) - 1)
            line[at : at + 1] = [rng.choice("abcxyz")] if kind == 1 else []
    return "".join(line)


def some_docs(seed, n=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh ij") for _ in range(rng.randrange(38, 90))) for _ in range(25)]
    docs = [(i, "\n".join(mutate(rng, rng.choice(base), rng.randrange(4)) for _ in range(rng.randrange(1, 6)))) for i in range(n)]
    return [*docs, (n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, base[0] + "\n" + base[0]), (None, base[1]), (n + 4, "z" * 1500), (n + 5, "z" * 1501)]


def test_close_is_edit_distance():
    rng = random.Random(1)
    a = [mutate(rng, "the quick brown fox"[: rng.randrange(20)], 0).encode() for _ in range(800)]
    b = [mutate(rng, x.decode(), rng.randrange(5)).encode() for x in a]
    assert linededup.close(a, b).tolist() == [distance(x, y) <= 2 for x, y in zip(a, b)]


def test_probes_find_every_close_pair():
    rng = random.Random(2)
    plan = linededup.Probes()
    for _ in range(400):
        a = mutate(rng, "".join(rng.choice("ab") for _ in range(rng.randrange(40, 60))), 0).encode()
        b = mutate(rng, a.decode(), 2).encode()
        if distance(a, b) > 2:
            continue
        a, b = sorted((a, b), key=len)
        index = {(s, a[at : at + n]) for s, at, n, flag in plan[len(a)] if flag}
        assert index & {(s, b[at : at + n]) for s, at, n, _ in plan[len(b)]}
        assert linededup.sketches_near(*np.split(linededup.sketches([a, b]), 2))[0]


@pytest.mark.parametrize("small,piece,text_piece", [(32, 1 << 13, 1 << 11), (3, 1 << 13, 4), (3, 6, 4)])
def test_against_model(spark, docs, monkeypatch, small, piece, text_piece):
    monkeypatch.setattr(linededup, "SMALL", small)
    monkeypatch.setattr(linededup, "PIECE", piece)
    monkeypatch.setattr(linededup, "TEXT_PIECE", text_piece)
    rows = some_docs(7)
    got = linededup.without_repeats(docs(rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == model(rows)


def test_repeated_rows_and_empty(spark, docs):
    line = "a line that is long enough to be looked at, surely"
    got = linededup.without_repeats(docs([(1, line), (1, line), (2, line + "!")])).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, line), (1, line), (2, "")]
    assert linededup.without_repeats(docs([(1, "x")]).where("false")).collect() == []


def test_short_repeats_go_from_the_pipeline(spark, docs):
    from corpus_pipeline import line_dedup_stage

    long = "a line that is long enough to be looked at, surely"
    rows = [(1, "short line\n\n你好，世界，再见\nonce"), (2, "short line\n\n" + long + "\n你好，世界，再见\nshort lime"), (3, long + "!\nshort line"), (4, "x\nx\n \n ")]
    got = {r.doc_id: r.text for r in line_dedup_stage(spark, docs(rows), "").collect()}
    assert got == {1: rows[0][1], 2: "\n" + long + "\nshort lime", 3: "", 4: "x\n \n "}
