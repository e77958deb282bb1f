"""Work inside buckets of a shuffled table, however long a bucket is.

Rows are 64-bit integers: key columns first. They arrive sorted by key, so a task reads
bucket by bucket. A bucket longer than a piece is not worked on where it is found: its
rows go on in numbered pieces, and each pair of pieces becomes a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Sets:
    """Union-find over row numbers; roots stay compressed for vector lookups."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Join pairs and return a subset of them that joins the same sets."""
        kept_a, kept_b = [], []
        while True:
            ra, rb = self.root[a], self.root[b]
            far = ra != rb
            if not far.any():
                return np.array(kept_a, np.int64), np.array(kept_b, np.int64)
            a, b, hi, lo = a[far], b[far], np.maximum(ra, rb)[far], np.minimum(ra, rb)[far]
            _, first = np.unique(hi, return_index=True)
            self.root[hi[first]] = lo[first]
            kept_a += a[first].tolist()
            kept_b += b[first].tolist()
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def number(*parts: int) -> int:
    """A signed 64-bit name for a key."""
    return xxhash.xxh64_intdigest(repr(parts)) - (1 << 63)


def runs(batches: Iterator[pa.RecordBatch], keys: int, piece: int) -> Iterator[tuple[tuple, np.ndarray, bool]]:
    """Rows of equal keys of a sorted stream, at most ``piece`` at once, and whether more may follow.

    Runs of one row come together, under an empty key: they cannot hold a pair.
    """
    last, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)], 1)
        change = (cols[1:, :keys] != cols[:-1, :keys]).any(1)
        starts = np.flatnonzero(np.r_[True, change])
        sizes = np.diff(np.r_[starts, len(cols)])
        parts = np.flatnonzero((sizes > 1) | (starts == 0) | (starts + sizes == len(cols)))
        for k in parts.tolist():
            part = cols[starts[k] : starts[k] + sizes[k]]
            key = tuple(part[0, :keys].tolist())
            if key != last:
                if last is not None and len(held) > 1:
                    yield last, held, False
                last, held = key, part
            else:
                held = np.concatenate([held, part])
            while len(held) > piece:
                yield last, held[:piece], True
                held = held[piece:]
    if last is not None and len(held):
        yield last, held, False


def over_buckets(keys: int, piece: int, compare: Callable, output: pa.Schema):
    """For mapInArrow: ``compare(values, group)`` over whole short buckets, ``group`` numbering them.

    It returns the columns of its output without the last two, ``grp`` and ``piece``. Long
    buckets come out as rows with ``piece`` >= 0, their values in the first columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows, long_key, at = 0, None, -1

        def batch(columns, grp, no):
            n = len(columns[0])
            whole = [*columns, *[np.zeros(n, np.int64)] * (len(output) - 2 - len(columns)), np.full(n, grp, np.int64), np.full(n, no, np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(whole, output, strict=True)], schema=output)

        def flush():
            part = np.concatenate(held)
            group = np.cumsum(np.r_[0, (part[1:, :keys] != part[:-1, :keys]).any(1)])
            return batch(compare(part[:, keys:], group), 0, -1)

        for key, part, more in runs(batches, keys, piece):
            if more or key == long_key:
                at = at + 1 if key == long_key else 0
                long_key = key
                yield batch(list(part[:, keys:].T), number(*key), at)
                continue
            if len(part) > 1:
                held.append(part)
                rows += len(part)
            if rows >= piece:
                yield flush()
                held, rows = [], 0
        if held:
            yield flush()

    return run


def deal(pieces: DataFrame) -> DataFrame:
    """Rows of long buckets, once for each pair (i, j) of pieces that theirs belongs to."""
    count = pieces.groupBy("grp").agg((F.max("piece") + 1).alias("n"))
    each = pieces.join(count, "grp").withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return each.select(F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), *pieces.columns)
