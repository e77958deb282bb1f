"""Near copies at a Jaccard similarity of word shingles, with SimHash compared in bit planes.

Three bits of 64, which suit near-identical texts, reach few of the pairs whose five-word
shingles are 0.8 alike: those differ in about ten bits. No exact pigeonhole of 64 bits
covers that, so buckets come from MinHash bands of the same shingle hashes, which find a
pair of similarity 0.8 with probability 0.998 at any table size. Inside a bucket, SimHash
fingerprints are compared in bit planes with carry-save counters, blocks beyond the radius
are abandoned, and pairs within it are verified by exact Jaccard of their shingle sets.

Equal texts are one row before any comparison. A bucket of more than ALL_PAIRS rows does
not compare all of them: each of its pieces compares its rows with the LEADERS rows nearest
the bitwise majority, and leaders of pieces with each other. The links found join the rows of
such a bucket to groups; rows outside its largest group are then held against every row of the
bucket. A pair of different groups has one of these rows, and other links cannot change the
groups, so none is lost: tasks get a piece of these rows and a piece of the bucket with their
shingle sets, and emit verified links only.

Words are runs without ASCII white space after lower-casing A-Z; a text of one to four
words is one shingle. Texts without words, null texts too, are alike. Repeated rows and
equal texts share a group; different texts of null or repeated ids are told apart by the
text's hash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.llm.base import texts_of, written
from eventfold.llm.buckets import runs
from eventfold.llm.graph import components
from eventfold.llm.simhash import planes_of

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 differs in 9.7 bits on average, with a deviation of 2.9.
RADIUS = 18
BANDS, ROWS = 16, 5
ALL_PAIRS, LEADERS = 32, 4
PIECE, REST_PIECE = 1 << 14, 1 << 11
SEED = 42

_COEFFICIENTS = np.frombuffer(b"".join(xxhash.xxh64_digest(bytes([i, i >> 8]), SEED) for i in range(2 * BANDS * ROWS)), "<u8").astype(np.uint64)
_TIMES, _PLUS = _COEFFICIENTS[: BANDS * ROWS] | np.uint64(1), _COEFFICIENTS[BANDS * ROWS :]
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64())])


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes of a text with how often each stands there: (2, n) uint64."""
    words = text.lower().split()
    if not words:
        return np.zeros((2, 0), np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    last = min(size, len(words)) - 1
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - last].tolist(), ends[last:].tolist())
    hashes = np.fromiter((digest(line[s:e], SEED) for s, e in spans), np.uint64, len(words) - last)
    return np.stack(np.unique(hashes, return_counts=True)).astype(np.uint64)


def simhash(found: np.ndarray) -> int:
    """The 64-bit fingerprint of shingle hashes and their counts."""
    hashes, counts = found
    votes, total = np.zeros(64, np.int64), int(counts.sum())
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += counts[at : at + (1 << 14)].astype(np.int64) @ bits
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0]) if total else 0


def bands(hashes: np.ndarray) -> np.ndarray:
    """Keys of the MinHash bands of distinct shingle hashes; one common key where there is none."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 1 << 12):
        mixed = hashes[at : at + (1 << 12), None] * _TIMES + _PLUS
        least = np.minimum(least, (mixed ^ (mixed >> np.uint64(29))).min(0))
    rows = np.ascontiguousarray(least).reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[i].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, part, fp, keys), one per document row."""
    for batch in batches:
        keys, prints = [], []
        for text in texts_of(batch, "text"):
            found = shingles(text)
            prints.append(simhash(found))
            keys.append(bands(found[0]))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(prints, np.uint64).view(np.int64)), lists], names=["doc_id", "part", "fp", "keys"])


def within(planes: np.ndarray, step: int, n: int, radius: int = RADIUS) -> np.ndarray:
    """Rows i for which prints i and i + step differ in at most ``radius`` bits.

    Carry-save counters, as many bits as the radius has, hold the distances of 64 rows a
    word; a sticky bit takes their overflow. After every eight planes, words whose rows are
    all beyond the radius are left.
    """
    skip, shift = divmod(step, 64)
    words = np.arange(-(-max(n - step, 0) // 64))
    width = radius.bit_length()
    counters, over = np.zeros((width, len(words)), np.uint64), np.zeros(len(words), np.uint64)
    for k in range(0, 64, 8):
        here = planes[k : k + 8]
        ahead = here[:, np.minimum(words + skip, here.shape[1] - 1)]
        if shift:
            beyond = here[:, np.minimum(words + skip + 1, here.shape[1] - 1)]
            ahead = (ahead >> np.uint64(shift)) | (beyond << np.uint64(64 - shift))
        for carry in here[:, words] ^ ahead:
            for bit in range(width):
                counters[bit], carry = counters[bit] ^ carry, counters[bit] & carry
            over |= carry
        # counters above the radius: from the highest bit down, the first that differs decides
        above, same = np.zeros_like(over), ~np.zeros_like(over)
        for bit in range(width - 1, -1, -1):
            if radius >> bit & 1:
                same &= counters[bit]
            else:
                above |= same & counters[bit]
                same &= ~counters[bit]
        over |= above
        alive = over != ~np.uint64(0)
        if not alive.any():
            return np.zeros(0, np.int64)
        if not alive.all():
            words, counters, over = words[alive], counters[:, alive], over[alive]
    hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(hit)
    at = words[word] * 64 + bit
    return at[at < n - step]


def small_links(rows: np.ndarray) -> np.ndarray:
    """All pairs within the radius of buckets of at most ALL_PAIRS rows (key, part, fp), sorted by key."""
    key, part = rows[:, 0], rows[:, 1]
    planes, out = planes_of(np.ascontiguousarray(rows[:, 2]).view(np.uint64)), [np.zeros((0, 3), np.int64)]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    for step in range(1, int(np.diff(np.r_[starts, len(rows)]).max(initial=1))):
        i = within(planes, step, len(rows))
        i = i[key[i] == key[i + step]]
        out.append(np.stack([part[i], part[i + step], np.full(len(i), 0)], 1))
    return np.concatenate(out)


def leader_links(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a piece's rows with its leaders, and the leaders' rows."""
    prints = np.ascontiguousarray(rows[:, 2]).view(np.uint64)
    bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    middle = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(rows), bitorder="little").view(np.uint64)[0]
    leaders = np.lexsort((rows[:, 1], np.bitwise_count(prints ^ middle)))[:LEADERS]
    out = []
    for i in leaders.tolist():
        near = np.flatnonzero((np.bitwise_count(prints ^ prints[i]) <= RADIUS) & (np.arange(len(rows)) != i))
        out.append(np.stack([np.full(len(near), rows[i, 1]), rows[near, 1], np.full(len(near), rows[i, 0])], 1))
    return np.concatenate(out), rows[leaders]


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a, b, key) of sorted rows (key, part, fp); key 0 for those of small buckets."""
    out = lambda x: pa.RecordBatch.from_arrays([pa.array(x[:, i]) for i in range(3)], schema=_LINK)
    small, held, last, leaders = [], 0, None, []

    def across():
        """Leaders of the pieces of a long bucket, with each other."""
        if len(leaders) > 1:
            top = np.concatenate(leaders)
            for i in range(len(top) - 1):
                near = i + 1 + np.flatnonzero(np.bitwise_count((top[i + 1 :, 2] ^ top[i, 2]).view(np.uint64)) <= RADIUS)
                yield np.stack([np.full(len(near), top[i, 1]), top[near, 1], np.full(len(near), top[i, 0])], 1)

    for key, part, _ in runs(batches, 1, PIECE):
        if key != last:
            for x in across():
                yield out(x)
            last, leaders = key, []
        if len(part) <= ALL_PAIRS and not leaders:
            small.append(part)
            held += len(part)
        elif len(part) > 1:
            found, top = leader_links(part)
            leaders.append(top)
            yield out(found)
        if held > PIECE:
            yield out(small_links(np.concatenate(small)))
            small, held = [], 0
    for x in across():
        yield out(x)
    if small:
        yield out(small_links(np.concatenate(small)))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with their shingle sets (a, b, sa, sb), those that are similar enough."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            either = len(x) + len(y) - both
            keep.append(both >= SIMILARITY * either)  # two texts without words are alike
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t)[0].tobytes() for t in texts_of(batch, "text")], pa.binary())], names=["part", "set"])


def verified(pairs: DataFrame, keyed: DataFrame, first: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts' shingle sets have the similarity."""
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("part")), keyed, first)
    one, two = (sets.select(F.col("part").alias(p), F.col("set").alias(s)) for p, s in (("a", "sa"), ("b", "sb")))
    return written(pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(_alike, "a bigint, b bigint"), "near-links")


def sets_of(parts: DataFrame, keyed: DataFrame, first: DataFrame) -> DataFrame:
    """Rows (part, set), written: shingle hashes of the texts in ``parts``.

    Sets are made of one row per text, the one with its smallest id, so that copies of a
    text do not meet in one task.
    """
    needed = parts.distinct().join(first, "part").select(F.col("part").alias("_p"), "first")
    found = keyed.join(needed, (F.col("part") == F.col("_p")) & F.col("doc_id").eqNullSafe(F.col("first"))).select("part", "text")
    return written(found.mapInArrow(_sets, "part bigint, set binary").dropDuplicates(["part"]), "near-sets")


def piece_links(alone: list[tuple[int, int, np.ndarray]], others: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links of rows (part, fp, set) with others: within the radius, of fit sizes, and verified."""
    out = []
    if not others:
        return out
    prints = np.array([x[1] for x in others], np.int64)
    sizes = np.array([len(x[2]) for x in others])
    for part, fp, own in alone:
        fit = (np.bitwise_count((prints ^ fp).view(np.uint64)) <= RADIUS) & (np.minimum(sizes, len(own)) >= SIMILARITY * np.maximum(sizes, len(own)))
        for k in np.flatnonzero(fit).tolist():
            other, _, theirs = others[k]
            both = len(np.intersect1d(own, theirs, assume_unique=True))
            if other != part and both >= SIMILARITY * (len(own) + len(theirs) - both):
                out.append((part, other))
    return out


def _piece_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (key, i, j, mine, part, fp, set) sorted by key, i and j."""

    def flush():
        got = piece_links([x[1:] for x in held if x[0]], [x[1:] for x in held if not x[0]])
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], names=["a", "b"])

    last, held = None, []
    for batch in batches:
        for *key, mine, part, fp, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != last and held:
                yield flush()
                held = []
            last = key
            held.append((mine, part, fp, np.frombuffer(found, np.uint64)))
    if held:
        yield flush()


def _apart(members: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of buckets (key, part, fp) that ``links`` do not join to the largest group of their bucket."""
    roots = components(links, "near-first-components")
    joined = members.join(roots, F.col("part") == F.col("node"), "left").withColumn("group", F.coalesce("root", "part"))
    sizes = joined.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "group"))["group"].alias("largest"))
    return joined.join(largest, "key").where(F.col("group") != F.col("largest")).select("key", "part", "fp")


def _rest_links(members: DataFrame, links: DataFrame, keyed: DataFrame, first: DataFrame) -> DataFrame:
    """Verified links of the rows of long buckets (key, part, fp) outside their bucket's largest group, with all of their buckets."""
    spread = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alone = written(_apart(members, links), "near-alone")
    pieces = alone.groupBy("key").agg(F.expr(f"(count(1) + {REST_PIECE} - 1) div {REST_PIECE}").alias("ni"))
    whole = members.join(pieces, "key").groupBy("key", "ni").agg(F.expr(f"(count(1) + {REST_PIECE} - 1) div {REST_PIECE}").alias("nj"))
    sets = sets_of(members.join(pieces, "key", "left_semi").select("part"), keyed, first)

    def dealt(rows: DataFrame, mine: bool) -> DataFrame:
        own, other = ("ni", "nj") if mine else ("nj", "ni")
        cut = rows.join(whole, "key").withColumn("_own", F.pmod(F.xxhash64("part"), F.col(own))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))
        i, j = ("_own", "_other") if mine else ("_other", "_own")
        return cut.select("key", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(mine).alias("mine"), "part", "fp")

    both = dealt(alone, True).union(dealt(members, False)).join(sets, "part").select("key", "i", "j", "mine", "part", "fp", "set")
    return written(both.repartition(spread, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_piece_tasks, "a bigint, b bigint"), "near-rest-links")


def near_groups(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, part, root), one per document row: ``part`` hashes the text, ``root`` names its group."""
    kind = dict(docs.dtypes)["doc_id"]
    keyed = docs.select("doc_id", F.xxhash64("text").alias("part"), "text")
    sketches = keyed.mapInArrow(_sketches, f"doc_id {kind}, part bigint, fp bigint, keys array<bigint>")
    one = written(sketches.groupBy("part").agg(F.min("doc_id").alias("first"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "near-sketches")
    first = one.select("part", "first")
    rows = one.select(F.explode("keys").alias("key"), "part", "fp")
    found = written(
        rows.repartition("key").sortWithinPartitions("key", "part").mapInArrow(_bucket_links, "a bigint, b bigint, key bigint"), "near-candidates"
    )
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    links = verified(written(found.select(*pair).where("a <> b").distinct(), "near-pairs"), keyed, first)
    long = found.where("key <> 0").select("key").distinct()
    if not long.isEmpty():
        links = links.union(_rest_links(written(rows.join(long, "key", "left_semi"), "near-long"), links, keyed, first))
    root = components(links, "near-components")
    return keyed.select("doc_id", "part").join(root, F.col("part") == F.col("node"), "left").select("doc_id", "part", F.coalesce("root", "part").alias("root"))
