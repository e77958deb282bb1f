"""Near-duplicate lines: a segment-partition edit join over all lines of all documents.

Lines are the parts between line feeds. Lines of at least MIN_BYTES bytes belong to a
class with all lines that a chain of links reaches; two lines are linked when their UTF-8
bytes are at most EDITS edits apart. Of each class only the first line stays: smallest
``doc_id`` (null first), then text hash, then line number. Shorter lines always stay in
the query, as its SQL has it; with ``short``, as in the pipeline, exact repeats of shorter
lines that are not blank go as well.

A line is cut into EDITS + 1 segments. A line within EDITS edits holds one of them
unchanged, at a place that is narrowed down by the two lengths, so each line probes a few
of its substrings for every length it may meet. Rows that share a segment are compared by
a sketch of byte counts first; texts are fetched only for lines that pass, and verified by
a bit-parallel automaton over the band of diagonals. Clusters longer than SMALL are
verified where they stand, and only links that join something new come out.

Defined cases: null text stays null, an empty text has one empty line, which stays. Equal
rows count as one document and get equal results. A document may end up with no line: its
text is then empty. The empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.llm.base import register, table, texts_of, written
from eventfold.llm.buckets import Sets, deal, over_buckets, runs
from eventfold.llm.graph import components

EDITS = 2
MIN_BYTES = 40
SMALL = 32
PIECE = 1 << 13
#: Lines of one piece when texts are compared in place.
TEXT_PIECE = 1 << 11
#: Bits of the fixed-size filter of wanted line hashes. A full filter only saves less.
FILTER_BITS = 1 << 25

_BIG = np.uint64(0x0F0F0F0F0F0F0F0F)
_SHIFTS = 4 * np.arange(16, dtype=np.uint64)


def segments(n: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """Start and length of the segments of a line of ``n`` bytes; the later ones are longer."""
    k = edits + 1
    short, longer = divmod(n, k)
    out, at = [], 0
    for i in range(k):
        size = short + (i >= k - longer)
        out.append((at, size))
        at += size
    return out


class Probes(dict):
    """For a line length: (seed, start, length, index flag) of the substrings to look up."""

    def __missing__(self, n: int):
        if len(self) > 20_000:
            self.clear()
        out = {}
        for length in range(max(n - EDITS, 1), n + 1):
            more = n - length
            for i, (p, size) in enumerate(segments(length)):
                seed = length * (EDITS + 1) + i
                left, right = i, EDITS - i
                for at in range(max(p - left, p + more - right, 0), min(p + left, p + more + right, n - size) + 1):
                    out[seed, at, size] = int(not more and at == p)
        self[n] = [(*k, v) for k, v in out.items()]
        return self[n]


def sketches(lines: list[bytes]) -> np.ndarray:
    """Sixteen counts modulo 16 of each line's bytes by their low bits, four bits each."""
    out = np.zeros(len(lines), np.uint64)
    at = 0
    while at < len(lines):
        stop, room = at, 1 << 22
        while stop < len(lines) and (stop == at or room > len(lines[stop])):
            room -= len(lines[stop])
            stop += 1
        low = np.frombuffer(b"".join(lines[at:stop]), np.uint8) & 15
        cell = np.repeat(np.arange(stop - at, dtype=np.int64) * 16, [len(x) for x in lines[at:stop]]) + low
        counts = (np.bincount(cell, minlength=16 * (stop - at)).reshape(-1, 16) & 15).astype(np.uint64)
        out[at:stop] = (counts << _SHIFTS).sum(1, dtype=np.uint64)
        at = stop
    return out.view(np.int64)


def sketches_near(a: np.ndarray, b: np.ndarray, edits: int = EDITS) -> np.ndarray:
    """False where byte counts alone show more than ``edits`` edits."""
    a, b = a.view(np.uint64), b.view(np.uint64)
    total = np.zeros(len(a), np.int64)
    for shift in (np.uint64(0), np.uint64(4)):
        x = ((a >> shift) & _BIG).view(np.uint8).reshape(-1, 8)
        y = ((b >> shift) & _BIG).view(np.uint8).reshape(-1, 8)
        apart = (x - y) & 15
        total += np.minimum(apart, 16 - apart).sum(1, dtype=np.int64)
    return total <= 2 * edits


def close(a: list[bytes], b: list[bytes], edits: int = EDITS) -> np.ndarray:
    """Whether each pair is within ``edits`` edits.

    Bit k of a pair's row e tells that with e edits the automaton can stand on diagonal
    k - edits after the bytes read so far. All pairs move on together, byte by byte.
    """
    out = np.zeros(len(a), bool)
    size = np.array([len(x) for x in b], np.int64)
    other = np.array([len(x) for x in a], np.int64)
    order = np.argsort(size, kind="stable")
    order = order[np.abs(size - other)[order] <= edits]
    at = 0
    while at < len(order):  # pieces of limited bytes
        room = max(1, (1 << 22) // max(int(size[order[at]]), 1))
        take = order[at : at + room]
        while len(take) > 1 and len(take) * int(size[take[-1]]) > 1 << 23:
            take = take[: len(take) // 2]
        at += len(take)
        n, m = int(size[take].max(initial=0)), int(other[take].max(initial=0))
        text = np.full((n, len(take)), 0xFE, np.uint8)  # neither filler occurs in UTF-8
        pattern = np.full((max(n, m) + 2 * edits + 1, len(take)), 0xFF, np.uint8)
        for i, k in enumerate(take.tolist()):
            text[: size[k], i] = np.frombuffer(b[k], np.uint8)
            pattern[edits : edits + other[k], i] = np.frombuffer(a[k], np.uint8)
        rows = [np.full(len(take), 1 << (edits + e), np.uint8) for e in range(edits + 1)]
        for e in range(1, edits + 1):
            rows[e] |= rows[e - 1]  # leading bytes of the pattern left out
        goal = (1 << (other[take] - size[take] + edits)).astype(np.uint8)
        done = size[take] == 0
        result = done & ((rows[edits] & goal) > 0)
        for j in range(n):
            same = np.zeros(len(take), np.uint8)
            for k in range(2 * edits + 1):
                same |= (pattern[j + k] == text[j]).astype(np.uint8) << np.uint8(k)
            before = rows[0]
            rows[0] = before & same
            for e in range(1, edits + 1):
                now = (rows[e] & same) | before | (before >> 1) | (rows[e - 1] << 1)
                before, rows[e] = rows[e], now
            result |= (size[take] == j + 1) & ((rows[edits] & goal) > 0)
        out[take] = result
    return out


def line_hash(line: bytes) -> int:
    return xxhash.xxh64_intdigest(line) - (1 << 63)


def long_lines(text: bytes) -> Iterator[tuple[int, bytes]]:
    return ((i, x) for i, x in enumerate(text.split(b"\n")) if len(x) >= MIN_BYTES)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("part"), "text")


def filled_lines(text: bytes) -> Iterator[tuple[int, bytes]]:
    return ((i, x) for i, x in enumerate(text.split(b"\n")) if len(x) >= MIN_BYTES or x.strip())


def occurrences(docs: DataFrame, short: bool = False) -> DataFrame:
    """Rows (doc_id, part, line, h, h2) of all lines long enough, or not blank with ``short``; two hashes name a line."""
    lines_of = filled_lines if short else long_lines
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            row, no, h, h2 = [], [], [], []
            for i, text in enumerate(texts_of(batch, "text")):
                for k, line in lines_of(text):
                    row.append(i)
                    no.append(k)
                    h.append(line_hash(line))
                    h2.append(xxhash.xxh64_intdigest(line, 1) - (1 << 63))
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), *(pa.array(x, pa.int64()) for x in (no, h, h2))],
                names=["doc_id", "part", "line", "h", "h2"],
            )

    return _keyed(docs).mapInArrow(run, f"doc_id {kind}, part bigint, line bigint, h bigint, h2 bigint")


def segment_rows(docs: DataFrame) -> DataFrame:
    """The substring index and its probes: rows (key, h, counts, indexed), each line once per task batch."""

    def run(batches):
        probes, digest = Probes(), xxhash.xxh64_intdigest
        for batch in batches:
            keys, flags, ids, fresh, times, seen = [], [], [], [], [], set()
            for text in texts_of(batch, "text"):
                for _, line in long_lines(text):
                    h = line_hash(line)
                    if h in seen:
                        continue
                    seen.add(h)
                    plan = probes[len(line)]
                    keys += [digest(line[at : at + size], seed) for seed, at, size, _ in plan]
                    flags += [x[3] for x in plan]
                    ids.append(h)
                    fresh.append(line)
                    times.append(len(plan))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), times)),
                    pa.array(np.repeat(sketches(fresh), times)), pa.array(np.array(flags, np.int64)),
                ],
                names=["key", "h", "counts", "indexed"],
            )

    return docs.select("text").mapInArrow(run, "key bigint, h bigint, counts bigint, indexed bigint")


_FOUND = pa.schema([(x, pa.int64()) for x in ("a", "b", "c", "grp", "piece")])


def _near(values: np.ndarray, group: np.ndarray, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of pairs that one sketch comparison cannot rule out, step by step along the sorted rows."""
    h, counts, indexed = np.ascontiguousarray(values[:, 0]), np.ascontiguousarray(values[:, 1]), values[:, 2] > 0
    rows = np.arange(len(h))
    out_a, out_b, step = [], [], 1
    while True:
        rows = rows[rows + step < len(h)]
        rows = rows[group[rows] == group[rows + step]]  # runs are sorted: what fails here fails for longer steps
        if not len(rows):
            break
        i = rows[(h[rows] != h[rows + step]) & (indexed[rows] | indexed[rows + step])]
        if apart is not None:
            i = i[apart[i] != apart[i + step]]
        i = i[sketches_near(counts[i], counts[i + step])]
        out_a.append(i)
        out_b.append(i + step)
        step += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _pairs_or_clusters(values: np.ndarray, group: np.ndarray, apart: np.ndarray | None = None) -> list[np.ndarray]:
    """Columns (a, b, c): pairs with c = 0, and members a of long clusters b with c = 1."""
    a, b = _near(values, group, apart)
    h = np.ascontiguousarray(values[:, 0])
    sets = Sets(len(h))
    sets.join(a, b)
    size = np.bincount(sets.root, minlength=len(h))
    few = size[sets.root[a]] <= SMALL
    x, y = h[a[few]], h[b[few]]
    pairs = np.unique(np.c_[np.minimum(x, y), np.maximum(x, y)].reshape(-1, 2), axis=0)
    member = np.flatnonzero(size[sets.root] > SMALL)
    name = h[sets.root[member]] ^ group[sets.root[member]]
    clusters = np.unique(np.c_[h[member], name].reshape(-1, 2), axis=0)
    kind = np.r_[np.zeros(len(pairs), np.int64), np.ones(len(clusters), np.int64)]
    return [*np.concatenate([pairs, clusters]).T, kind]


def _across_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same between two pieces of a long bucket, or within one. Columns: grp, i, j, piece, h, counts, indexed."""
    held, last = [], None

    def flush():
        part = np.concatenate(held)
        own = last[1] == last[2]
        cols = _pairs_or_clusters(part[:, 4:], np.full(len(part), last[0] + last[1] * 31 + last[2]), None if own else part[:, 3])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["a", "b", "c"])

    for key, part, _ in runs(batches, 3, 1 << 30):
        if key != last and held:
            yield flush()
            held = []
        last = key
        held.append(part)
    if held:
        yield flush()


def bit_filter(hashes: DataFrame, column: str) -> np.ndarray:
    """A bitmap of FILTER_BITS bits with one bit set per hash, put together from fixed blocks."""
    block = 1 << 18

    def pack(batches):
        bits = {}
        for batch in batches:
            at = batch.column(0).to_numpy()
            for k in np.unique(at // block).tolist():
                own = bits.setdefault(k, np.zeros(block, bool))
                own[at[at // block == k] % block] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int64()), pa.array([np.packbits(x).tobytes() for x in bits.values()], pa.binary())], names=["k", "bits"])

    places = hashes.select(F.pmod(column, F.lit(FILTER_BITS)).alias("at")).distinct()
    out = np.zeros((FILTER_BITS // block, block // 8), np.uint8)
    for k, bits in places.repartition(16, F.expr(f"at div {block}")).mapInArrow(pack, "k bigint, bits binary").collect():
        out[k] |= np.frombuffer(bits, np.uint8)
    return out.reshape(-1)


def texts_for(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (h, line) for the hashes in ``wanted.h``. Most other lines never leave their task."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted, "h"))

    def run(batches):
        bits = shared.value
        for batch in batches:
            got = {}
            for text in texts_of(batch, "text"):
                for _, line in long_lines(text):
                    h = line_hash(line)
                    at = h % FILTER_BITS
                    if bits[at >> 3] >> (7 - (at & 7)) & 1:
                        got[h] = line
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.binary())], names=["h", "line"])

    lines = docs.select("text").mapInArrow(run, "h bigint, line binary")
    return lines.join(wanted, "h", "left_semi").groupBy("h").agg(F.max("line").alias("line"))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = pa.array(close(batch.column(2).to_pylist(), batch.column(3).to_pylist()))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _verify_clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joining links between the pieces i and j of a cluster. Columns: grp, i, j, piece, h, line."""
    last, held = None, []

    def flush():
        piece, h, lines = np.array([x[0] for x in held]), np.array([x[1] for x in held], np.int64), [x[2] for x in held]
        counts = sketches(lines)
        sets, out, wait = Sets(len(h)), [], []

        def verify():
            i, j = (np.concatenate(x) for x in zip(*wait))
            far = sets.root[i] != sets.root[j]
            i, j = i[far], j[far]
            near = close([lines[k] for k in i], [lines[k] for k in j])
            a, b = sets.join(i[near], j[near])
            out.append(np.c_[h[a], h[b]].reshape(-1, 2))
            wait.clear()

        for step in range(1, len(h)):
            i = np.arange(len(h) - step)
            i = i[(h[i] != h[i + step]) & (sets.root[i] != sets.root[i + step])]
            if last[1] != last[2]:
                i = i[piece[i] != piece[i + step]]
            i = i[sketches_near(counts[i], counts[i + step])]
            if len(i):
                wait.append((i, i + step))
            if sum(len(x) for x, _ in wait) >= TEXT_PIECE:
                verify()
        if wait:
            verify()
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *out])
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        for *key, piece, h, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != last and held:
                yield flush()
                held = []
            last = key
            held.append((piece, h, line))
    if held:
        yield flush()


def _tasks(docs: DataFrame) -> int:
    """Tasks for work whose rows are few and small but costly: a given number is not merged by their size."""
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def line_links(docs: DataFrame) -> DataFrame:
    """Links (a, b) between line hashes whose chains make the classes."""
    keyed = segment_rows(docs).repartition("key").sortWithinPartitions("key", "h")
    found = written(keyed.mapInArrow(over_buckets(1, PIECE, _pairs_or_clusters, _FOUND), "a bigint, b bigint, c bigint, grp bigint, piece bigint"), "line-candidates")
    pieces = found.where("piece >= 0").select("grp", "piece", F.col("a").alias("h"), F.col("b").alias("counts"), F.col("c").alias("indexed"))
    across = deal(pieces).select("grp", "i", "j", "piece", "h", "counts", "indexed").repartition(_tasks(docs), "grp", "i", "j")
    more = across.sortWithinPartitions("grp", "i", "j", "h").mapInArrow(_across_pieces, "a bigint, b bigint, c bigint")
    all_ = written(found.where("piece < 0").select("a", "b", "c").union(more).distinct(), "line-pairs")
    pairs, members = all_.where("c = 0").select("a", "b"), all_.where("c = 1").select(F.col("a").alias("h"), F.col("b").alias("grp"))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h")).union(members.select("h")).distinct()
    lines = written(texts_for(docs, wanted), "line-texts")
    both = pairs.join(lines.toDF("a", "x"), "a").join(lines.toDF("b", "y"), "b").select("a", "b", "x", "y")
    close_pairs = both.mapInArrow(_verify, "a bigint, b bigint")
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    parted = members.join(sizes, "grp").select("grp", F.expr(f"pmod(xxhash64(h), (n + {TEXT_PIECE} - 1) div {TEXT_PIECE})").alias("piece"), "h")
    dealt = deal(parted).join(lines, "h").select("grp", "i", "j", "piece", "h", "line").repartition(_tasks(docs), "grp", "i", "j")
    cluster_pairs = dealt.sortWithinPartitions("grp", "i", "j", "h").mapInArrow(_verify_clusters, "a bigint, b bigint")
    return close_pairs.union(cluster_pairs)


def repeats(docs: DataFrame, short: bool = False) -> DataFrame:
    """Lines to leave out: (doc_id, part, line) and the class's first line (first_doc, first_line)."""
    seen = written(occurrences(docs, short), "line-occurrences")
    place = F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id", "part", "line")
    each = seen.groupBy("h", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    roots = components(line_links(docs), "line-classes").toDF("h", "root")
    named = each.join(roots, "h", "left").where("n > 1 or root is not null")
    named = written(named.select("h", "h2", "first", "root"), "line-repeats")
    firsts = named.where("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    classes = named.join(firsts, "root", "left").select("h", "h2", F.coalesce("least", "first").alias("first"))
    marked = seen.join(classes, ["h", "h2"])
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("part") == F.col("first.part")) & (F.col("line") == F.col("first.line"))
    return marked.where(~same).select(
        "doc_id", "part", "line", F.col("first.doc_id").alias("first_doc"), F.col("first.line").alias("first_line")
    ).distinct()


def without_repeats(docs: DataFrame, short: bool = False, into: str = "removed") -> DataFrame:
    """The documents with repeated lines left out, and ``into``: their numbers and first places.

    A column of the documents that has the name ``into`` gives way to it.
    """
    gone = repeats(docs, short).groupBy(F.col("doc_id").alias("_d"), F.col("part").alias("_p")).agg(
        F.array_sort(F.collect_list(F.struct("line", "first_doc", "first_line"))).alias("_gone")
    )
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"), F.xxhash64("text").alias("_part"))
    joined = keyed.join(gone, (F.col("_part") == F.col("_p")) & F.col("_id").eqNullSafe(F.col("_d")), "left")
    drop = F.transform("_gone", lambda x: x["line"])
    kept = F.filter(F.split("_text", "\n", -1), lambda x, i: ~F.array_contains(drop, i.cast("bigint")))
    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    columns = [c for c in docs.columns if c != into]
    return joined.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in columns], F.col("_gone").alias(into))


SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, line, i - 1 AS no FROM (
    SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) AS d, unnest(ls) WITH ORDINALITY AS t(line, i)
  WHERE strlen(line) >= {MIN_BYTES}
),
u AS (SELECT line, strlen(line) AS n, min(struct_pack(d := doc_id, l := no)) AS first FROM l GROUP BY line),
e AS (
  SELECT a.line AS x, b.line AS y FROM u AS a JOIN u AS b
    ON b.n BETWEEN a.n - {EDITS} AND a.n + {EDITS} AND a.line <> b.line
  WHERE levenshtein(a.line, b.line) <= {EDITS}
),
r AS (SELECT line AS x, line AS y FROM u UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT r.x AS line, min(u.first) AS first FROM r JOIN u ON u.line = r.y GROUP BY r.x),
g AS (
  SELECT l.doc_id, count(*) AS n, list(l.no) AS nos,
         string_agg(l.no || ':' || first.d || ':' || first.l, ',' ORDER BY l.no) AS removed
  FROM l JOIN c USING (line) WHERE NOT (l.doc_id = first.d AND l.no = first.l) GROUP BY l.doc_id
),
k AS (
  SELECT doc_id, n, removed, array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)),
         lambda x, i: NOT list_contains(coalesce(nos, []), i - 1)), chr(10)) AS kept
  FROM documents LEFT JOIN g USING (doc_id)
)
SELECT doc_id, CAST(CASE WHEN kept = '' THEN 0 ELSE len(string_split(kept, chr(10))) END AS BIGINT) AS n_kept,
       CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed, sha256(kept) AS text_sha256
FROM k
"""


@register("op6_line_dedup", SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those left out with the place of the line that stays, and the text's digest."""
    out = without_repeats(table(spark, sf_dir, "documents"))
    place = F.transform("removed", lambda x: F.concat_ws(":", x["line"], F.coalesce(x["first_doc"].cast("string"), F.lit("")), x["first_line"]))
    n = F.coalesce(F.size("removed"), F.lit(0))
    left = F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.size(F.split("text", "\n", -1)))
    return out.select(
        "doc_id", left.cast("bigint").alias("n_kept"), F.greatest(n, F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.array_join(place, ","), F.lit("")).alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )
