"""SimHash near-duplicates: fingerprints compared in vertical bit planes.

Words are runs without ASCII white space, after lower-casing A-Z; shingles are three words.
Candidates come from an exact pigeonhole: 64 bits are cut into ``b`` blocks, two
fingerprints within the radius agree on at least ``b - radius`` of them, so every choice of
that many blocks is one key. ``b`` grows with the number of different fingerprints and
keeps buckets small; every choice gives the same links.

Defined cases: a null text, an empty text and one without words have fingerprint zero and
link like any other. Texts of one or two words are one shingle. Repeated rows and equal
texts share a fingerprint. A null ``doc_id`` keeps its fingerprint; it never names a
component while another id is there. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.llm.base import register, table, texts_of, written
from eventfold.llm.buckets import Sets, deal, over_buckets, runs
from eventfold.llm.graph import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Mean bucket size aimed at when choosing the number of blocks.
BUCKET = 16
#: Rows of one comparison in a task; larger buckets are dealt out as pairs of such pieces.
PIECE = 1 << 14

_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("grp", pa.int64()), ("piece", pa.int64())])


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of one UTF-8 text, unsigned."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        words, n = [b" ".join(words)], 1
        spans = iter([(0, len(words[0]))])
    else:
        n = len(words) - SHINGLE + 1
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        spans = zip((ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist(), (ends[SHINGLE - 1 :] - 1).tolist())
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    while part := [digest(line[s:e], SEED) for s, e in itertools.islice(spans, 1 << 16)]:
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in texts_of(batch, "text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], names=["doc_id", "part", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, part, fp), one per document row.

    ``fp`` holds the bits as a signed bigint, ``part`` a hash of the text.
    """
    kind = dict(docs.dtypes)["doc_id"]
    keyed = docs.select("doc_id", F.xxhash64("text").alias("part"), "text")
    return keyed.mapInArrow(_fingerprints, f"doc_id {kind}, part bigint, fp bigint")


def block_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """One mask per choice of ``blocks - radius`` blocks out of ``blocks``."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in range(blocks)]
    return [sum(c) for c in itertools.combinations(one, blocks - radius)]


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """The fewest blocks whose keys are long enough for ``n`` fingerprints."""
    b = radius + 1
    while b < 16 and n >> (64 * (b - radius) // b) > BUCKET:
        b += 1
    return b


def planes_of(prints: np.ndarray) -> np.ndarray:
    """Bit planes (64, words): bit i of plane k is bit k of print i."""
    n = len(prints)
    bits = np.unpackbits(prints.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    room = np.zeros((64, -(-n // 64) * 64 + 64), np.uint8)
    room[:, :n] = bits.T
    return np.packbits(room, axis=1, bitorder="little").view(np.uint64)


def within(planes: np.ndarray, step: int, n: int, radius: int = RADIUS) -> np.ndarray:
    """Rows i for which prints i and i + step differ in at most ``radius`` (1 to 3) bits.

    Carry-save counters of two bits and a sticky overflow hold the distances of 64 rows a
    word. After every eight planes, words whose rows are all beyond the radius are left.
    """
    skip, shift = divmod(step, 64)
    words = np.arange(-(-max(n - step, 0) // 64))
    ones = np.zeros(len(words), np.uint64)
    twos, over = ones.copy(), ones.copy()
    for k in range(0, 64, 8):
        here = planes[k : k + 8]
        ahead = here[:, np.minimum(words + skip, here.shape[1] - 1)]
        if shift:
            beyond = here[:, np.minimum(words + skip + 1, here.shape[1] - 1)]
            ahead = (ahead >> np.uint64(shift)) | (beyond << np.uint64(64 - shift))
        for x in here[:, words] ^ ahead:
            carry = ones & x
            ones ^= x
            over |= twos & carry
            twos ^= carry
        if radius < 3:  # counts above the radius that the counters can still show
            over |= (twos & ones) if radius == 2 else twos
        alive = over != ~np.uint64(0)
        if not alive.any():
            return np.zeros(0, np.int64)
        if not alive.all():
            words, ones, twos, over = words[alive], ones[alive], twos[alive], over[alive]
    hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(hit)
    at = words[word] * 64 + bit
    return at[at < n - step]


def linked(prints: np.ndarray, group: np.ndarray, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all rows of equal ``group`` within the radius of each other.

    Rows come sorted by group. Every pair of a group is compared; of the links found, those
    that join nothing new are left out. With ``apart``, pairs of equal ``apart`` are not
    compared: another task has them.
    """
    n = len(prints)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    out_a, out_b = [], []
    for level in range(1, int(sizes.max(initial=1)).bit_length()):  # groups of 2^level rows and more, below twice that
        pick = (sizes >= 1 << level) & (sizes < 2 << level)
        if not pick.any():
            continue
        take = np.repeat(pick, sizes)
        fp, gr = np.ascontiguousarray(prints[take]), group[take]
        ap = None if apart is None else apart[take]
        planes, sets = planes_of(fp), Sets(len(fp))
        for step in range(1, int(sizes[pick].max())):
            i = within(planes, step, len(fp))
            i = i[gr[i] == gr[i + step]]
            if ap is not None:
                i = i[ap[i] != ap[i + step]]
            if len(i):
                a, b = sets.join(i, i + step)
                out_a.append(fp[a])
                out_b.append(fp[b])
    none = np.zeros(0, prints.dtype)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _compare(values: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = linked(np.ascontiguousarray(values[:, 0]).view(np.uint64), group)
    return a.view(np.int64), b.view(np.int64)


def _piece_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between two pieces of a long bucket, or within one."""
    def flush(key, part):
        own = key[1] == key[2]
        prints = np.ascontiguousarray(part[:, 4]).view(np.uint64)
        return linked(prints, np.zeros(len(part), np.int64), None if own else part[:, 3])

    last, held = None, []
    for key, part, _ in runs(batches, 3, 1 << 30):
        if key != last and held:
            a, b = flush(last, np.concatenate(held))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
            held = []
        last = key
        held.append(part)
    if held:
        a, b = flush(last, np.concatenate(held))
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def links(unique: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``unique.fp`` within the radius."""
    masks = block_masks(blocks_for(unique.count(), radius), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = unique.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed]))).select(
        F.col("pos").cast("bigint").alias("choice"), F.col("col").alias("key"), "fp"
    )
    found = written(
        keyed.repartition("choice", "key").sortWithinPartitions("choice", "key", "fp")
        .mapInArrow(over_buckets(2, PIECE, _compare, _LINK), "a bigint, b bigint, grp bigint, piece bigint"),
        "simhash-links",
    )
    long = found.where("piece >= 0").select("grp", "piece", F.col("a").alias("fp"))
    across = (
        deal(long).select("grp", "i", "j", "piece", "fp")
        .repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "piece", "fp")
        .mapInArrow(_piece_links, "a bigint, b bigint")
    )
    return found.where("piece < 0").select("a", "b").union(across)


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows (doc_id, part, fp, component_id, root), one per document row; ``root`` names the component by a fingerprint."""
    prints = written(fingerprints(docs), "simhash-prints")
    unique = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-unique")
    root = components(links(unique, radius), "simhash-components")
    member = root.join(unique, root.node == unique.fp).select("fp", "root", "first")
    named = member.join(member.groupBy("root").agg(F.min("first").alias("least")), "root").select("fp", "root", "least")
    names = unique.join(named, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return prints.join(names, "fp").select("doc_id", "part", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows (doc_id, part, fp, component_id), one per document row."""
    return near_groups(docs, radius).drop("root")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


@register("op4_simhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
