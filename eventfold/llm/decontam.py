"""Benchmark decontamination over a distributed positional inverted index.

Words are runs of ASCII letters, digits and non-ASCII characters after lower-casing A-Z. A
window is ten consecutive words of a benchmark item; an item of fewer words is one window.

The index holds, for the rarest terms of each window (its anchors), one posting per
occurrence in the documents: document, term, position and the term ids around it. Postings
meet the windows' anchors, each moves to the window start it implies, and the lists are
intersected by (document, window, start). What is left is compared word for word with the
ids around the rarest anchor. With ``slop``, windows whose words all lie within that many
extra positions, in any order, come back as proximity matches.

The benchmark is worked off in blocks of at most about BLOCK_WINDOWS windows, so what a
task holds does not grow with it; each block reads all documents.

Defined cases: a null or empty text has no words, an item without words has no window, and
neither matches. Repeated items and windows count once, repeated document rows each get
their own equal row. Equal ``doc_id`` with different texts are told apart by the text's
hash. A null ``item_id`` is listed as an empty id. Empty tables give no rows or no matches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.llm.base import register, table, texts_of, written

WINDOW = 10
ANCHORS = 2
BLOCK_WINDOWS = 100_000
#: Lower-cases A-Z and turns every ASCII byte outside words into a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def windows_of(item: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not item:
        return []
    return [tuple(item[i : i + size]) for i in range(max(1, len(item) - size + 1))]


class Block:
    """The windows of some items: term numbers, window rows, anchors. Bounded by the block size."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            for window in windows_of(words(text), size):
                owners.setdefault(window, set()).add(item)
        self.windows = sorted(owners)
        self.owners = [sorted(owners[w]) for w in self.windows]
        self.terms = {t: i for i, t in enumerate(sorted({t for w in self.windows for t in w}))}
        self.length = np.array([len(w) for w in self.windows], np.int64)
        self.ids = np.full((len(self.windows), size), -2, np.int32)
        for i, w in enumerate(self.windows):
            self.ids[i, : len(w)] = [self.terms[t] for t in w]

    def anchors(self, frequency: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Rows (term, window, rank, offset): the rarest places of each window that can occur."""
        out = []
        for i, n in enumerate(self.length.tolist()):
            often = frequency[self.ids[i, :n]]
            if often.min() > 0:
                for rank, at in enumerate(np.lexsort((np.arange(n), often))[:ANCHORS].tolist()):
                    out.append((int(self.ids[i, at]), i, rank, at))
        return out


def _keyed(docs: DataFrame) -> DataFrame:
    """The document columns in use, with a hash that tells equal ids with different texts apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("part"), "text")


def term_counts(docs: DataFrame, terms: dict[bytes, int]) -> np.ndarray:
    """Occurrences of each benchmark term in all documents, added up per task first."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        total = np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            for text in texts_of(batch, "text"):
                total += np.bincount([get(w, -1) + 1 for w in words(text)] or [0], minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(terms))), pa.array(total[1:])], names=["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect()
    out = np.zeros(len(terms), np.int64)
    for term, n in rows:
        out[term] = n
    return out


def postings(docs: DataFrame, block: Block, anchor_terms: list[int], reach: int) -> DataFrame:
    """The index: rows (doc_id, part, term, pos, around). Term -1 is a document's length in words."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((block.terms, anchor_terms))
    kind = dict(docs.dtypes)["doc_id"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, chosen = shared.value
        get = terms.get
        anchor = np.zeros(len(terms) + 1, bool)
        anchor[chosen] = True  # the last entry stands for words outside the vocabulary
        for batch in batches:
            row, term, pos, around = [], [], [], []
            for i, text in enumerate(texts_of(batch, "text")):
                ids = np.array([get(w, -1) for w in words(text)], np.int32)
                at = np.flatnonzero(anchor[ids])
                row.append(np.full(len(at) + 1, i))
                term += [[-1], ids[at]]
                pos += [[len(ids)], at]
                around.append(None)
                if len(at):
                    wide = np.full(len(ids) + 2 * reach, -1, np.int32)
                    wide[reach : reach + len(ids)] = ids
                    around += [x.tobytes() for x in wide[at[:, None] + np.arange(2 * reach + 1)]]
            take = pa.array(np.concatenate([np.zeros(0, np.int64), *row]).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take), batch.column(1).take(take),
                    pa.array(np.concatenate([np.zeros(0), *term]).astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(0), *pos]).astype(np.int64)), pa.array(around, pa.binary()),
                ],
                names=["doc_id", "part", "term", "pos", "around"],
            )

    return _keyed(docs).mapInArrow(index, f"doc_id {kind}, part bigint, term int, pos bigint, around binary")


def _verify(block: Block, reach: int, slop: int):
    """Compare candidates with the term ids around their rarest anchor."""
    ids, length = block.ids, block.length

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            around = np.frombuffer(b"".join(col["around"].to_pylist()), np.int32).reshape(batch.num_rows, -1)
            window, offset = col["window"].to_numpy(), col["offset"].to_numpy()
            want, n = ids[window], length[window]
            width = np.arange(want.shape[1])
            unused = width >= n[:, None]
            start = reach - offset
            have = np.take_along_axis(around, np.minimum(start[:, None] + width, 2 * reach), 1)
            phrase = ((have == want) | unused).all(1)
            near = np.zeros(len(phrase), bool)
            span = np.arange(want.shape[1] + slop)
            for back in range(len(span) if slop else 0):  # spans that hold the anchor
                at = reach - back + span
                here = np.where((span < n[:, None] + slop) & (at >= 0) & (at <= 2 * reach), around[:, np.clip(at, 0, 2 * reach)], -1)
                near |= ((want[:, :, None] == here[:, None, :]).any(2) | unused).all(1)
            keep = pa.array(phrase | near)
            yield pa.RecordBatch.from_arrays(
                [
                    col["doc_id"].filter(keep), col["part"].filter(keep), col["window"].filter(keep),
                    col["start"].filter(keep), pa.array(n).filter(keep), pa.array(phrase).filter(keep),
                ],
                names=["doc_id", "part", "window", "start", "n", "phrase"],
            )

    return check


def block_matches(docs: DataFrame, block: Block, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """Index of the documents for a block, and the matches found in it."""
    spark = docs.sparkSession
    reach = WINDOW - 1 + slop
    kind = dict(docs.dtypes)["doc_id"]
    anchors = block.anchors(term_counts(docs, block.terms)) if block.windows else []
    index = written(postings(docs, block, sorted({a[0] for a in anchors}), reach), "postings")
    small = spark.createDataFrame(
        [(*a, min(ANCHORS, int(block.length[a[1]]))) for a in anchors], "term int, window bigint, rank int, offset bigint, anchors int"
    )
    moved = index.where("term >= 0").join(F.broadcast(small), "term").select(
        "doc_id", "part", "window", (F.col("pos") - F.col("offset")).alias("start"), "rank", "anchors",
        F.when(F.col("rank") == 0, F.col("offset")).alias("offset"), F.when(F.col("rank") == 0, F.col("around")).alias("around"),
    )
    met = moved.groupBy("doc_id", "part", "window", "start").agg(
        F.max("offset").alias("offset"), F.max("around").alias("around"),
        F.count_distinct("rank").alias("n"), F.max("anchors").alias("of"),
    ).where("offset is not null" if slop else "n = of")
    owned = spark.createDataFrame([(i, x) for i, o in enumerate(block.owners) for x in o], "window bigint, item string")
    found = met.select("doc_id", "part", "window", "start", "offset", "around").mapInArrow(
        _verify(block, reach, slop), f"doc_id {kind}, part bigint, window bigint, start bigint, n bigint, phrase boolean"
    )
    return index, found.join(F.broadcast(owned), "window").select("doc_id", "part", "item", "start", "n", "phrase")


def blocks(items: DataFrame, size: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> Iterator[Block]:
    """The benchmark, block by block; one empty block where it has no rows."""
    listed = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"),
        # words are at least a byte and a separator long
        F.expr("octet_length(coalesce(text, '')) div 2 + 1").alias("room"),
    )
    total = listed.agg(F.sum("room")).first()[0] or 0
    n = -(-total // block_windows) or 1
    for i in range(n):
        rows = listed.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i).select("item", F.col("text").cast("binary")).collect()
        yield Block([(item, bytes(text)) for item, text in rows], size)


def matches(docs: DataFrame, items: DataFrame, slop: int = 0) -> tuple[DataFrame, DataFrame]:
    """Lengths (doc_id, part, n_words) of all document rows, and matches.

    A match has doc_id, part, item, start (in words), n (window length) and phrase: true for
    the exact phrase, false for a proximity match. Rows may repeat.
    """
    lengths = found = None
    for block in blocks(items):
        index, here = block_matches(docs, block, slop)
        lengths = index.where("term = -1").select("doc_id", "part", F.col("pos").alias("n_words")) if lengths is None else lengths
        found = here if found is None else found.union(here)
    return lengths, found


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document row: doc_id, part, n_words, n_hit, item ids with occurring windows."""
    lengths, found = matches(docs, items)
    exact = written(found.where("phrase").distinct(), "decontam-matches")
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("stop")))),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(x["stop"] - F.greatest(a["to"], x["start"]), F.lit(0).cast("bigint"))).alias("n"),
            F.greatest(a["to"], x["stop"]).alias("to"),
        ),
    )["n"]
    hits = exact.groupBy("doc_id", "part").agg(covered.alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    right = hits.select(F.col("doc_id").alias("d"), F.col("part").alias("p"), "n_hit", "items")
    return lengths.join(right, (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d")), "left").select(
        "doc_id", "part", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
),
g AS (
  SELECT rid, i, l, array_to_string(w[i:i + l - 1], ' ') AS g
  FROM d, (SELECT DISTINCT l FROM win) AS s, unnest(range(1, len(w) - l + 2)) AS t(i)
),
m AS (SELECT rid, i, l, item_id FROM g JOIN win USING (l, g)),
hit AS (SELECT rid, count(DISTINCT p) AS n FROM m, unnest(range(i, i + l)) AS u(p) GROUP BY rid),
it AS (
  SELECT rid, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""


@register("op7_benchmark_decontamination", SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of the benchmark."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
