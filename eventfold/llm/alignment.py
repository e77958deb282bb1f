"""Alignment of two tokenizers by byte offsets, with corpus-wide counts of token pairs.

Each text is encoded by a byte-level BPE (A) and a SentencePiece model (B). Where a token
of A and a token of B end at the same byte, the text is cut: the tokens between two cuts
are a group, and the two that end there are a link. No token of either is empty, so each
group ends with exactly one link.

Texts are encoded once, which is most of the work: their ids are written as whole numbers of
two bytes (four for vocabularies beyond 65,536), and all that follows reads those. Counts of
pairs take two passes over the ids:

1. Tasks count the pairs of their texts. The distinct pairs get a minimal perfect hash: they
   are dealt to shards by a hash, and each shard is hashed in levels of bit arrays (a key
   stays where no other of its level falls on the same bit; the others go on). The slot of
   a key is the rank of its bit. Dense count vectors, one per shard and indexed by slot, are
   summed in a tree: in tasks, then by branch, then by shard. A key is kept per slot, so a
   lookup verifies what it finds.
2. The texts are aligned again, and each link looks up its pair's count and whether it is
   the highest of its B id.

What a task holds is bounded: lookups go by blocks of shards with about BLOCK_KEYS pairs,
collected and broadcast (13 bytes a pair and little more), and where the pairs need more
blocks than one, the ids pass once for each block. The highest counts are one number per
id of B, bounded by its vocabulary.

A is encoded with the merge ranks of its vocabulary by a faster library; long runs of white
space, which that one cannot take, by A's own. Both give the same ids (tested for every
code point and all given texts).

Defined cases: null and empty texts, and texts whose tokens do not spell space + text
byte for byte, have no tokens: no groups, no links. Repeated rows and null ids are rows of
their own and count each; other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventfold.llm.base import register, table, written

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: How byte-level BPE cuts a text before merging (fixed value of A's vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_KEYS, BLOCK_KEYS = 1 << 15, 1 << 21
#: Bits of a level for each key that is left.
ROOM = 2.0
BRANCHES = 16
SLICE_BYTES = 2 << 20
#: Pairs a task counts before it hands them on.
HELD_PAIRS = 1 << 20

_LONG_BLANK = re.compile(r"\s{500}")


# Tokens ---------------------------------------------------------------------------------


def _byte_of() -> dict[str, int]:
    """Byte-level BPE writes bytes as printable characters: themselves where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokenizers:
    """Both tokenizers, the bytes of each token and the decimal text of each id."""

    def __init__(self, folder: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(os.path.join(folder, A_FILE))
        self.own.encode_special_tokens = True
        byte, special = _byte_of(), set(self.own.get_added_tokens_decoder())
        ranks = {bytes(byte[c] for c in t): i for t, i in self.own.get_vocab().items() if i not in special}
        self.a_bytes = [b""] * self.own.get_vocab_size()
        for t, i in ranks.items():
            self.a_bytes[i] = t
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, B_FILE))
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.get_piece_size())]
        self.sizes = [np.array([len(t) for t in ts]) for ts in (self.a_bytes, self.b_bytes)]
        #: Texts of ids as groups are written: inside and at the end of a group, for A, then B.
        ids = [list(map(str, range(len(ts)))) for ts in (self.a_bytes, self.b_bytes)]
        self.words = np.array([x + sign for which, signs in ((0, ",|"), (1, ",;")) for sign in signs for x in ids[which]], object)

    def encode_a(self, text: str) -> list[int]:
        if _LONG_BLANK.search(text):
            return self.own.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return self.fast.encode_ordinary(text)


def _ids_of_b(folder: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, B_FILE)).get_piece_size()


@lru_cache(1)
def tokenizers(folder: str) -> Tokenizers:
    return Tokenizers(folder)


@dataclass
class Aligned:
    """Token ids and, for each cut, the places of the two tokens that end there."""

    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray

    def pairs(self, wide: int) -> np.ndarray:
        return self.a[self.cut_a] * wide + self.b[self.cut_b]

    def groups(self, words: np.ndarray, na: int, nb: int) -> str:
        """``a1,a2|b1;a3|b2,b3``: ids of A and of B, group by group."""
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.cut_a], last_b[self.cut_b] = 1, 1
        at_a, at_b = (2 * (np.cumsum(x) - x) + side for side, x in enumerate((last_a, last_b)))
        which = np.r_[self.a + na * last_a, 2 * na + self.b + nb * last_b]
        order = np.argsort(np.r_[at_a, at_b], kind="stable")
        return "".join(words[which[order]].tolist())[:-1]


_NONE = np.zeros(0, np.int64)


def encode(texts: list[str | None], tok: Tokenizers) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of A and of B for each text."""
    for text, b in zip(texts, tok.b.encode([x or "" for x in texts], num_threads=1)):
        if not text:
            yield _NONE, _NONE
            continue
        whole = " " + text
        a, raw = np.array(tok.encode_a(whole), np.int64), whole.encode()
        # merging bytes never changes them, so only their number can be wrong for A
        if b"".join(map(tok.b_bytes.__getitem__, b)) != raw or tok.sizes[0][a].sum() != len(raw):
            yield _NONE, _NONE
            continue
        yield a, np.array(b, np.int64)


def align(a: np.ndarray, b: np.ndarray, tok: Tokenizers) -> Aligned:
    """The alignment of a text, from its ids."""
    if not len(a):
        return Aligned(a, b, _NONE, _NONE)
    end_a, end_b = tok.sizes[0][a].cumsum(), tok.sizes[1][b].cumsum()
    place = np.zeros(end_a[-1] + 1, np.int32)
    place[end_b] = np.arange(1, len(b) + 1)
    at = place[end_a]
    cut_a = np.flatnonzero(at)
    return Aligned(a, b, cut_a, at[cut_a] - 1)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about SLICE_BYTES of ``column``; a longer value is one of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start)


def _width(ids: int) -> str:
    """How an id of a vocabulary of ``ids`` is stored."""
    return "<u2" if ids <= 1 << 16 else "<u4"


def token_ids(texts: DataFrame, folder: str) -> DataFrame:
    """Rows (key, a, b) of rows (key, text): the ids of both tokenizers as bytes; empty without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(folder)
        for part in (p for batch in batches for p in _slices(batch, "text")):
            both = zip(*encode(part.column(1).to_pylist(), tok))
            ids = [pa.array([x.astype(_width(len(of))).tobytes() for x in side], pa.binary()) for side, of in zip(both, (tok.a_bytes, tok.b_bytes))]
            yield pa.RecordBatch.from_arrays([part.column(0), *(ids or [pa.array([], pa.binary())] * 2)], names=["key", "a", "b"])

    return texts.select("key", "text").mapInArrow(run, T.StructType([texts.schema["key"], *[T.StructField(x, T.BinaryType()) for x in "ab"]]))


def _aligned(batch: pa.RecordBatch, tok: Tokenizers) -> list[Aligned]:
    """The alignment of each row of a batch with the columns ``a`` and ``b``."""
    sides = [
        [np.frombuffer(x, _width(len(of))).astype(np.int64) for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]
        for name, of in (("a", tok.a_bytes), ("b", tok.b_bytes))
    ]
    return [align(a, b, tok) for a, b in zip(*sides)]


# The hash -------------------------------------------------------------------------------


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of the keys, another one at each level (the finalizer of splitmix64)."""
    z = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (_mix(keys, -1) % np.uint64(shards)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """Bits of each level, all levels as bytes, and the keys by slot, of distinct keys."""
    sizes, levels, order = [], [], []
    while len(keys):
        size = 64 * int(np.ceil(ROOM * len(keys) / 64))
        at = (_mix(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        stays = alone[at]
        order.append(keys[stays][np.argsort(at[stays])])
        sizes.append(size)
        levels.append(np.packbits(alone, bitorder="little"))
        keys = keys[~stays]
    return sizes, b"".join(x.tobytes() for x in levels), np.concatenate([*order, np.zeros(0, np.int64)])


class Lookup:
    """Slots of keys in a run of shards, each given as (shard, sizes, bits, keys); verified."""

    def __init__(self, rows: list, shards: int):
        self.shards, self.keys = shards, np.concatenate([np.asarray(r[3], np.int64) for r in rows])
        depth = max(len(r[1]) for r in rows)
        self.size, self.base = np.zeros((depth, shards), np.int64), np.zeros((depth, shards), np.int64)
        at = 0
        for shard, sizes, _, _ in rows:
            for level, size in enumerate(sizes):
                self.size[level, shard], self.base[level, shard] = size, at
                at += size
        self.words = np.frombuffer(b"".join(bytes(r[2]) for r in rows), np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that these shards do not hold."""
        out, live, shard = np.full(len(keys), -1, np.int64), np.arange(len(keys)), _shard(keys, self.shards)
        for level in range(len(self.size)):
            live = live[self.size[level, shard[live]] > 0]
            if not len(live):
                break
            s = shard[live]
            at = self.base[level, s] + (_mix(keys[live], level) % self.size[level, s].astype(np.uint64)).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[live[hit]] = (self.before[at >> 6] + below)[hit]
            live = live[~hit]
        return np.where((out >= 0) & (self.keys[out] == keys), out, -1)


# Passes ---------------------------------------------------------------------------------


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts), len(found)).astype(np.int64)


def pair_counts(ids: DataFrame, folder: str) -> DataFrame:
    """Pass one: rows (key, n) of the pairs of each task; a key comes from many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizers(folder)
        wide, keys, counts = len(tok.b_bytes), [], []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(x[0]) for x in (keys, counts)], names=["key", "n"])
        for batch in batches:
            for part in _slices(batch, "a"):
                pairs = np.concatenate([_NONE, *[x.pairs(wide) for x in _aligned(part, tok)]])
                found, n = np.unique(pairs, return_counts=True)
                merged = _merged([*keys, found], [*counts, n])
                keys, counts = [merged[0]], [merged[1]]
                if len(merged[0]) > HELD_PAIRS:
                    yield out()
                    keys, counts = [], []
        if keys:
            yield out()

    return ids.select("a", "b").mapInArrow(run, "key bigint, n bigint")


def _hashed(keys: DataFrame, shards: int) -> DataFrame:
    """A row per shard: its levels and its keys by slot."""
    spread = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def shard_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_shard(k, shards)), batch.column(0)], names=["shard", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(shard, held):
            sizes, bits, order = build(np.concatenate(held))
            fields = [[shard], [sizes], [bits], [order]]
            return pa.RecordBatch.from_arrays([pa.array(f, t) for f, t in zip(fields, (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())))], names=["shard", "sizes", "bits", "keys"])

        last, held = None, []
        for batch in batches:
            s, k = (batch.column(i).to_numpy() for i in (0, 1))
            for part in np.split(np.arange(len(s)), np.flatnonzero(np.diff(s)) + 1):
                if not len(part):
                    continue
                if s[part[0]] != last and held:
                    yield made(last, held)
                    held = []
                last = s[part[0]]
                held.append(k[part])
        if held:
            yield made(last, held)

    dealt = keys.mapInArrow(shard_of, "shard bigint, key bigint").repartition(min(shards, spread), "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "shard bigint, sizes array<bigint>, bits binary, keys array<bigint>")


def _blocks(shards: int) -> Iterator[tuple[int, int]]:
    """Runs of shards with about BLOCK_KEYS keys."""
    step = max(1, BLOCK_KEYS // SHARD_KEYS)
    for low in range(0, shards, step):
        yield low, min(low + step, shards)


def _shared(index: DataFrame, low: int, high: int, shards: int, *more: str):
    """A block's rows, broadcast: its size is bounded by BLOCK_KEYS."""
    rows = index.where((F.col("shard") >= low) & (F.col("shard") < high)).orderBy("shard").collect()
    head = [(r["shard"], r["sizes"], bytes(r["bits"]), np.array(r["keys"], np.int64)) for r in rows]
    return index.sparkSession.sparkContext.broadcast((head, shards, *[np.array([v for r in rows for v in r[c]], np.int64) for c in more])) if rows else None


def _dense(counts: DataFrame, block) -> DataFrame:
    """Dense count vectors of a block's shards, one per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, shards = block.value[:2]
        lookup, total = Lookup(rows, shards), None
        for batch in batches:
            at, n = lookup.slots(batch.column(0).to_numpy()), batch.column(1).to_numpy()
            total = np.zeros(len(lookup.keys), np.int64) if total is None else total
            np.add.at(total, at[at >= 0], n[at >= 0])
        start, branch = 0, TaskContext.get().partitionId() % BRANCHES
        for shard, _, _, keys in rows if total is not None else []:
            part = total[start : start + len(keys)]
            start += len(keys)
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([branch]), pa.array([part], pa.list_(pa.int64()))], names=["shard", "branch", "counts"])

    return counts.mapInArrow(run, "shard bigint, branch bigint, counts array<bigint>")


def _summed(vectors: DataFrame, by: list[str]) -> DataFrame:
    """One vector per key: sums of sorted rows as they pass, one vector held at a time."""
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        out = lambda: pa.RecordBatch.from_arrays([*[pa.array([k]) for k in last], pa.array([total], pa.list_(pa.int64()))], names=[*by, "counts"])
        for batch in batches:
            keys, vector = list(zip(*[batch.column(i).to_pylist() for i in range(len(by))])), batch.column(len(by))
            for i, key in enumerate(keys):
                v = vector[i].values.to_numpy(zero_copy_only=False)
                if key != last:
                    if last is not None:
                        yield out()
                    last, total = key, np.zeros(len(v), np.int64)
                total += v
        if last is not None:
            yield out()

    dealt = vectors.select(*by, "counts").repartition(spread, *by).sortWithinPartitions(*by)
    return dealt.mapInArrow(run, ", ".join(f"{c} bigint" for c in by) + ", counts array<bigint>")


@dataclass
class PairIndex:
    """Written rows per shard (shard, sizes, bits, keys, counts), and the highest count of each B id."""

    rows: DataFrame
    shards: int
    best: np.ndarray

    @staticmethod
    def of(ids: DataFrame, folder: str, wide: int) -> PairIndex:
        spark = ids.sparkSession
        counts = written(pair_counts(ids, folder), "pair-counts")
        keys = written(counts.select("key").distinct(), "pair-keys")
        shards = max(1, -(-keys.count() // SHARD_KEYS))
        hashed = written(_hashed(keys, shards), "pair-hash")
        sums = None
        for low, high in _blocks(shards):
            block = _shared(hashed, low, high, shards)
            if block is not None:
                part = written(_summed(_summed(_dense(counts, block), ["shard", "branch"]), ["shard"]), "pair-sums")
                sums = part if sums is None else sums.union(part)
        best = np.zeros(wide, np.int64)
        if sums is None:
            empty = spark.createDataFrame([], T.StructType([*hashed.schema.fields, T.StructField("counts", T.ArrayType(T.LongType()))]))
            return PairIndex(empty, shards, best)
        rows = written(hashed.join(sums, "shard"), "pair-index")
        each = rows.select(F.explode(F.arrays_zip("keys", "counts")).alias("e")).groupBy((F.col("e.keys") % wide).alias("b"))
        for r in each.agg(F.max("e.counts").alias("n")).collect():  # at most the vocabulary of B
            best[r["b"]] = r["n"]
        return PairIndex(rows, shards, best)


def alignments(docs: DataFrame, text: str = "text", key: str = "doc_id", folder: str = TOKENIZERS) -> DataFrame:
    """Rows (key, n_a, n_b, groups, counts, best): the groups as text and, link by link, the pair's corpus-wide count and whether it is its B id's highest."""
    kind = docs.schema[key].dataType
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    wide = _ids_of_b(folder)
    ids = written(token_ids(texts, folder), "token-ids")
    index = PairIndex.of(ids, folder, wide)
    blocks = [b for low, high in _blocks(index.shards) if (b := _shared(index.rows, low, high, index.shards, "counts")) is not None]
    top = texts.sparkSession.sparkContext.broadcast(index.best)
    made = T.StructType().add(key, kind).add("n_a", "long").add("n_b", "long").add("groups", "string").add("counts", T.ArrayType(T.LongType())).add("best", T.ArrayType(T.BooleanType()))
    carried = T.StructType([*ids.schema.fields, T.StructField("counts", T.ArrayType(T.LongType()))])

    def counted(block, aligned: list[Aligned]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs and counts of a slice's links; zero for pairs of other blocks."""
        pairs = np.concatenate([_NONE, *[x.pairs(wide) for x in aligned]])
        if block is None:
            return pairs, np.zeros(len(pairs), np.int64)
        lookup, counts = _opened(block)
        at = lookup.slots(pairs)
        return pairs, np.where(at >= 0, counts[at], 0)

    def lists(values: np.ndarray, aligned: list[Aligned], kind: pa.DataType) -> pa.Array:
        ends = np.cumsum([0, *[len(x.cut_a) for x in aligned]])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))

    def earlier(part: pa.RecordBatch) -> np.ndarray:
        at = part.schema.get_field_index("counts")
        return 0 if at < 0 else part.column(at).flatten().to_numpy(zero_copy_only=False)

    def middle(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in (p for batch in batches for p in _slices(batch, "a")):
                aligned = _aligned(part, tokenizers(folder))
                counts = counted(block, aligned)[1] + earlier(part)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], lists(counts, aligned, pa.int64())], names=carried.names)

        return run

    def final(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tok = tokenizers(folder)
            na, nb = len(tok.a_bytes), len(tok.b_bytes)
            for part in (p for batch in batches for p in _slices(batch, "a")):
                aligned = _aligned(part, tok)
                pairs, counts = counted(block, aligned)
                counts = counts + earlier(part)
                groups = pa.array([x.groups(tok.words, na, nb) for x in aligned], pa.string())
                sizes = [pa.array([len(getattr(x, side)) for x in aligned], pa.int64()) for side in "ab"]
                best = counts == top.value[pairs % wide]
                yield pa.RecordBatch.from_arrays([part.column(0), *sizes, groups, lists(counts, aligned, pa.int64()), lists(best, aligned, pa.bool_())], names=made.names)

        return run

    for block in blocks[:-1]:
        ids = written(ids.mapInArrow(middle(block), carried), "pair-pass")
    return ids.mapInArrow(final(blocks[-1] if blocks else None), made)


_open: list = []


def _opened(block) -> tuple[Lookup, np.ndarray]:
    """A worker's lookup of a broadcast block, made once."""
    if not _open or _open[0] is not block.value:
        rows, shards, counts = block.value
        _open[:] = [block.value, Lookup(rows, shards), counts]
    return _open[1], _open[2]


@register("op11_cross_tokenizer_alignment")
def cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of every document's tokens."""
    rows = alignments(table(spark, sf_dir, "documents"))
    links = F.size("counts").cast("bigint")
    return rows.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "n_a", "n_b", links.alias("n_groups"), links.alias("n_links"),
        F.size(F.filter("best", lambda x: x)).cast("bigint").alias("n_best"), F.aggregate("counts", F.lit(0).cast("bigint"), lambda t, x: t + x).alias("count_sum"),
        F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"),
    )
