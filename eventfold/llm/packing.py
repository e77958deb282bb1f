"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into pieces of at most the longest sequence. Only how many pieces there
are of each length decides the packing, so that small table, with at most one row per
length, goes to the driver, is packed there by variable-capacity best fit, and comes back
as intervals of ranks: the r-th piece of a length goes to a bin and offset that follow from
the interval. Ranks are given by Spark in two levels, so no length is one task.

The rule, longest pieces first: a piece goes into the open bin with the least room that
holds it. Where none does, a bin is opened whose size costs least per token, a size
counting ``size + OVERHEAD`` and the copies of this length it takes. In the end each bin
shrinks to the smallest permitted length that holds its contents.

Defined cases: null and empty texts, and others of no token, give one piece of length 0
without a bin. Repeated rows are packed each on its own. Ties between equal pieces are
broken by document id, text hash and piece number; equal rows are interchangeable. An empty
table gives no rows.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventfold.llm.base import register, table, written

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a sequence besides its length, in tokens.
OVERHEAD = 16
#: Ranks are counted per length in parts first: at least PARTS, and so many that a part of one length holds about PART_ROWS.
PARTS, PART_ROWS = 64, 1 << 20


def token_count(text: Column) -> Column:
    """Letter runs, digit runs and single other signs: the default length of a text."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]")).cast("bigint")


@dataclass
class Plan:
    """Intervals of ranks per length, and ranges of bins of one size."""

    length: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    each: np.ndarray
    bin: np.ndarray
    offset: np.ndarray
    from_bin: np.ndarray
    capacity: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bin, its final size and the offset of pieces given by length and rank."""
        wide = np.int64(1) << 44  # ranks below; lengths are at most the longest sequence
        at = np.searchsorted(self.length * wide + self.rank, length * wide + rank, side="right") - 1
        inner = rank - self.rank[at]
        own = self.bin[at] + inner // self.each[at]
        return own, self.capacity[np.searchsorted(self.from_bin, own, side="right") - 1], self.offset[at] + inner % self.each[at] * length


def best_fit(counts: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> Plan:
    """Pack ``counts[length]`` pieces of each length. Bins of equal history stay one range."""
    sizes = sorted(capacities)
    room: dict[int, list[tuple[int, int, int]]] = {}  # room left: ranges (first bin, bins, size)
    rooms: list[int] = []  # sorted keys of ``room``
    steps, bins = [], 0

    def put(left: int, first: int, n: int, size: int) -> None:
        if left not in room:
            room[left] = []
            bisect.insort(rooms, left)
        room[left].append((first, n, size))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, n, size = room[left].pop()
                if not room[left]:
                    del room[left], rooms[at]
                use = min(n, todo)
                fill = min(left // length, todo // use) if use == n else 1
                if use < n:
                    put(left, first + use, n - use, size)
                steps.append((length, rank, use * fill, fill, first, size - left))
                put(left - fill * length, first, use, size)
                rank, todo = rank + use * fill, todo - use * fill
                continue
            size = min((s for s in sizes if s >= length), key=lambda s: ((s + overhead) / (s // length * length), s))
            fill = size // length
            n, rest = divmod(todo, fill)
            if n:
                steps.append((length, rank, n * fill, fill, bins, 0))
                put(size - fill * length, bins, n, size)
                rank, bins = rank + n * fill, bins + n
            if rest:
                steps.append((length, rank, rest, rest, bins, 0))
                put(size - rest * length, bins, 1, size)
                bins += 1
            todo = 0
    ends = sorted((first, size - left) for left, ranges in room.items() for first, _, size in ranges)
    final = [(first, sizes[bisect.bisect_left(sizes, used)]) for first, used in ends]
    steps.sort()
    cols = [np.array(c, np.int64) for c in zip(*steps)] or [np.zeros(0, np.int64)] * 6
    return Plan(*cols, *([np.array(c, np.int64) for c in zip(*final)] or [np.zeros(0, np.int64)] * 2))


def pieces(docs: DataFrame, tokens: Column, longest: int) -> DataFrame:
    """Rows (doc_id, part, piece, start, length): documents cut every ``longest`` tokens."""
    sized = docs.select("doc_id", F.xxhash64("text").alias("part"), F.coalesce(tokens, F.lit(0)).cast("bigint").alias("n"))
    last = F.greatest(F.expr(f"(n - 1) div {longest}"), F.lit(0))
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    start = F.col("piece") * longest
    return cut.select("doc_id", "part", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(longest)).alias("length"))


def pack(docs: DataFrame, tokens: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """Rows (doc_id, piece, start, length, bin, capacity, offset), one per piece of each document row."""
    spark = docs.sparkSession
    tokens = token_count(F.col("text")) if tokens is None else tokens
    whole = written(pieces(docs, tokens, max(capacities)), "packing-pieces")
    counts = {int(r.length): int(r.n) for r in whole.where("length > 0").groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per length
    plan = best_fit(counts, capacities, overhead)
    spread = max(PARTS, -(-max(counts.values(), default=0) // PART_ROWS))
    cut = whole.withColumn("sub", F.pmod(F.xxhash64("doc_id", "part", "piece"), F.lit(spread)))
    parts = cut.where("length > 0").groupBy("length", "sub").agg(F.count(F.lit(1)).alias("n"))
    before = parts.select(
        "length", "sub", (F.sum("n").over(Window.partitionBy("length").orderBy("sub")) - F.col("n")).alias("before")
    )
    order = Window.partitionBy("length", "sub").orderBy("doc_id", "part", "piece")
    ranked = cut.withColumn("inner", F.row_number().over(order) - 1).join(before, ["length", "sub"], "left")
    shared = spark.sparkContext.broadcast(plan)
    kind = dict(docs.dtypes)["doc_id"]

    def place(batches):
        own = shared.value
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            some = length > 0
            out = np.zeros((3, len(length)), np.int64)
            if some.any():
                out[:, some] = own.place(length[some], rank[some])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], *(pa.array(x, mask=~some) for x in out)],
                names=["doc_id", "piece", "start", "length", "bin", "capacity", "offset"],
            )

    return ranked.select("doc_id", "piece", "start", "length", (F.col("inner") + F.coalesce("before", F.lit(0))).alias("rank")).mapInArrow(
        place, f"doc_id {kind}, piece bigint, start bigint, length bigint, bin bigint, capacity bigint, offset bigint"
    )


@register("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences for all documents."""
    return pack(table(spark, sf_dir, "documents"))
