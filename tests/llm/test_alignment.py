"""Alignment and pair counts against a plain model that uses both tokenizers' own libraries."""

import hashlib
import os
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from eventfold.llm import alignment

FOLDER = alignment.TOKENIZERS
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def own():
    a = Tokenizer.from_file(os.path.join(FOLDER, alignment.A_FILE))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=os.path.join(FOLDER, alignment.B_FILE))


def plain(texts, own):
    """Digest rows of the contract, by place, straight from its words."""
    a, b = own
    back = {c: i for i, c in enumerate_bytes()}
    docs = []
    for text in texts:
        whole = (" " + text).encode() if text else b""
        ta = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in (a.encode(" " + text, add_special_tokens=False).ids if text else [])]
        tb = []
        for i in b.encode(text) if text else []:
            p = b.id_to_piece(i)
            tb.append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()))
        if b"".join(t for _, t in ta) != whole or b"".join(t for _, t in tb) != whole:
            ta, tb = [], []
        end_a, end_b = (np.cumsum([len(t) for _, t in x]).tolist() for x in (ta, tb))
        at_a, at_b = ({e: i for i, e in enumerate(ends)} for ends in (end_a, end_b))
        cuts = sorted(set(end_a) & set(end_b))
        links = [(ta[at_a[c]][0], tb[at_b[c]][0]) for c in cuts]
        groups, low_a, low_b = [], 0, 0
        for c in cuts:
            high_a, high_b = at_a[c] + 1, at_b[c] + 1
            groups.append("|".join(",".join(str(i) for i, _ in x) for x in (ta[low_a:high_a], tb[low_b:high_b])))
            low_a, low_b = high_a, high_b
        docs.append((len(ta), len(tb), links, groups))
    count = Counter(p for d in docs for p in d[2])
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [
        (na, nb, len(g), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for na, nb, links, g in docs
    ]


def enumerate_bytes():
    """(byte, printable character) of byte-level BPE."""
    n = 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            yield byte, chr(byte)
        else:
            yield byte, chr(256 + n)
            n += 1


def digest(rows):
    return [
        (r.n_a, r.n_b, len(r.counts), len(r.counts), sum(r.best), sum(r.counts), hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")
        for r in rows
    ]


ODD = [None, "", " ", "a", "▁ already marked", "<|endoftext|> <s> </s> <unk>", "naïve 中文 é😀 ‍", "x" * 3000, " " * 2000 + "y", "\n" * 700, "tab\there\r\nand  two", "a", "a", "It's 1234567 o'clock", "\x00\x01", "ﬁ ½"]


def test_equals_model(spark, docs, own):
    got = sorted(alignment.alignments(docs(list(enumerate(ODD)))).collect(), key=lambda r: r.doc_id)
    assert [(i, *d) for i, d in zip(range(len(ODD)), digest(got))] == [(i, *d) for i, d in enumerate(plain(ODD, own))]


def test_several_shards_and_blocks(spark, docs, own, monkeypatch):
    monkeypatch.setattr(alignment, "SHARD_KEYS", 50)
    monkeypatch.setattr(alignment, "BLOCK_KEYS", 100)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 2000)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(8).collect()]
    got = sorted(alignment.alignments(docs(list(enumerate(texts)))).collect(), key=lambda r: r.doc_id)
    assert digest(got) == plain(texts, own)


def test_query_equals_model(spark, own):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(texts, plain(texts.values(), own)))
    got = alignment.cross_tokenizer_alignment(spark, SF)
    assert got.columns == "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want


def test_null_and_repeated_ids_and_empty_table(spark, docs, own):
    got = alignment.alignments(docs([(None, "one two"), (1, "one two"), (1, "one two"), (2, None)])).collect()
    assert sorted(((r.doc_id or 0), tuple(r.counts)) for r in got) == [(0, (3, 3)), (1, (3, 3)), (1, (3, 3)), (2, ())]
    assert alignment.alignments(docs([])).count() == 0


def test_fast_encoder_equals_own_for_every_code_point(own):
    tok = alignment.tokenizers(FOLDER)
    assigned = lambda c: c >> 16 in (0, 1, 2, 3, 14) or c % 97 == 0  # noqa: E731  the other planes are private or empty
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and assigned(c)]
    for at in range(0, len(points), 20_000):
        texts = [f"a{x}b 1{x}2 {x}{x} !{x}!" for x in map(chr, points[at : at + 20_000])]
        assert [e.ids for e in own[0].encode_batch_fast(texts, add_special_tokens=False)] == [tok.encode_a(t) for t in texts]


def test_hash_is_minimal_perfect_and_verified():
    keys = np.random.default_rng(1).choice(1 << 31, 20_000, replace=False).astype(np.int64)
    shards = 3
    of = alignment._shard(keys, shards)
    rows = []
    for s in range(shards):
        sizes, bits, order = alignment.build(keys[of == s])
        rows.append((s, sizes, bits, order))
    lookup = alignment.Lookup(rows, shards)
    at = lookup.slots(keys)
    assert sorted(at.tolist()) == list(range(len(keys))) and (lookup.keys[at] == keys).all()
    others = np.setdiff1d(np.arange(50_000), keys)
    assert (lookup.slots(others) == -1).all()
    assert (alignment.Lookup(rows[1:2], shards).slots(keys[of != 1]) == -1).all()


def test_texts_are_encoded_once(spark, docs, monkeypatch):
    """However many blocks of pairs there are, the texts are encoded in one pass."""
    passes, plain_ids = [], alignment.token_ids
    monkeypatch.setattr(alignment, "SHARD_KEYS", 1)
    monkeypatch.setattr(alignment, "BLOCK_KEYS", 2)
    monkeypatch.setattr(alignment, "token_ids", lambda *x: passes.append(1) or plain_ids(*x))
    rows = alignment.alignments(docs([(1, "one two three four"), (2, "five six seven")]))
    plan = rows._jdf.queryExecution().toString()
    assert rows.count() == 2 and passes == [1] and "text" not in plan


def test_ids_are_kept_whole(spark, docs, own):
    """Written ids give back both encodings; nulls, empty texts and repeated rows keep their rows."""
    texts = [None, "", "a", "naïve 中文", "a"]
    rows = alignment.token_ids(docs(list(enumerate(texts))).selectExpr("doc_id AS key", "text"), FOLDER).collect()
    got = {r.key: [np.frombuffer(x, "<u2").tolist() for x in (r.a, r.b)] for r in rows}
    a, b = own
    assert got == {i: [a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)] if t else [[], []] for i, t in enumerate(texts)}
    assert alignment._width(1 << 16) == "<u2" and alignment._width((1 << 16) + 1) == "<u4"
