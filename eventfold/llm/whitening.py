"""Whitening of embeddings with MLlib block matrices.

Entries become whole numbers, ``floor(256 * c)``. The model is fitted on each distinct
vector once: its centred rows are cut into row blocks of a distributed block matrix B, the
scatter is B'B, and its eigenvectors come from a local decomposition of that d x d matrix.
A second block matrix of all rows, multiplied by the whitening matrix, projects them.

The blocks are made where the rows lie: a task turns its rows into blocks of about
BLOCK_BYTES, numbered from the tasks' counts, so indexing needs no shuffle. The middle
dimension of B'B is split, so its products are summed by many tasks and none reads all
blocks. Through the driver go one count per task, the sums, the d x d scatter and MLlib's
block numbers, one for each BLOCK_BYTES of centred rows.

Defined cases: rows whose vector is null or holds a null, NaN or infinite entry give no
row. Shorter vectors are padded with zeros to the longest one. Values of x beyond bigint
saturate; a deviation beyond bigint is null. Repeated rows and ids, null ids too, are rows
of their own; other columns, whatever they are named, are ignored. A component without
variance (below TINY times the largest) has a null ``whitened``; without any variance
``explained`` and ``identity_error`` are null too. A table without vectors, or with empty
ones only, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventfold.llm.base import register, rows_batch, table, written

SCALE = 256
COMPONENTS = 4
BLOCK_BYTES, BLOCK_COLS = 8 << 20, 1024
#: Least variance of a component, as a part of the largest, that counts as one.
TINY = 1e-12

_LONG = 1 << 63
_BLOCKS = T.StructType().add("at", T.StructType().add("_1", "long").add("_2", "long")).add("m", MatrixUDT())


@dataclass(frozen=True)
class Whitening:
    """A fitted model: ``vectors`` has one unit column per component, by falling ``values``."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def kept(self) -> int:
        """Components that have a variance."""
        return int((self.values > TINY * max(self.values.max(initial=0), 0)).sum())

    def matrix(self) -> np.ndarray:
        return self.vectors[:, : self.kept] / np.sqrt(self.values[: self.kept])


def scaled(rows: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """Rows (key, x) with whole-number vectors of one length, written, and that length."""
    sound = F.col(vector).isNotNull() & F.forall(vector, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    rows = rows.where(sound)
    d = rows.agg(F.max(F.size(vector))).first()[0] or 0
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint"))
    padded = F.concat(x, F.array_repeat(F.lit(0).cast("bigint"), F.lit(d) - F.size(vector)))
    return written(rows.select(F.col(key).alias("key"), padded.alias("x")), "whiten-rows"), d


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _exact(x: np.ndarray, factor: int) -> np.ndarray:
    """The same whole numbers, as Python's where a sum of ``factor`` of them may pass int64."""
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    return x if top * factor < _LONG // 4 else x.astype(object)


def sums_of(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, d)
            total = _exact(x, len(x)).sum(0)
            yield rows_batch(out, [[*range(d), d], [*map(str, total.tolist()), str(len(x))]])

    out = pa.schema([("i", pa.int32()), ("s", pa.string())])
    found = fit.select("x").mapInArrow(part, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    by = {r.i: int(r.s) for r in found.collect()}  # d + 1 rows
    return by.get(d, 0), [by.get(i, 0) for i in range(d)]


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task in batches of ``rows``, the last one shorter."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            held.append(part)
            n += part.num_rows
            batch = batch.slice(part.num_rows)
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


@dataclass(frozen=True)
class Blocks:
    """How the rows of a written table are cut into numbered row blocks of its tasks."""

    rows: DataFrame
    size: int
    first: dict[int, int]  # by task: its first block
    total: int

    @staticmethod
    def of(rows: DataFrame, d: int) -> Blocks:
        size = max(1, BLOCK_BYTES // (8 * d))
        counts = rows.groupBy(F.spark_partition_id().alias("p")).count().orderBy("p").collect()
        first, at = {}, 0
        for r in counts:
            first[r["p"]] = at
            at += -(-r["count"] // size)
        return Blocks(rows, size, first, at)

    def map(self, fn, schema) -> DataFrame:
        """``fn(block number, rows of the block)`` gives the batches of each block."""
        first, size = self.first, self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            no = first.get(TaskContext.get().partitionId(), 0)
            for k, chunk in enumerate(_chunks(batches, size)):
                yield from fn(no + k, chunk)

        return self.rows.mapInArrow(run, schema)


def _dense(block: tuple[int, int], x: np.ndarray) -> pa.RecordBatch:
    """A row that holds a dense MLlib matrix."""
    one = lambda v, t: pa.array([v], t)
    at = pa.StructArray.from_arrays([one(block[0], pa.int64()), one(block[1], pa.int64())], ["_1", "_2"])
    names = ["type", "numRows", "numCols", "colPtrs", "rowIndices", "values", "isTransposed"]
    empty = one(None, pa.list_(pa.int32()))
    values = pa.ListArray.from_arrays(pa.array([0, x.size], pa.int32()), pa.array(x.ravel(order="F")))
    fields = [one(1, pa.int8()), one(x.shape[0], pa.int32()), one(x.shape[1], pa.int32()), empty, empty, values, one(False, pa.bool_())]
    return pa.RecordBatch.from_arrays([at, pa.StructArray.from_arrays(fields, names)], names=["at", "m"])


def centred(blocks: Blocks, n: int, sums: list[int]) -> BlockMatrix:
    """The block matrix of ``x - S / n``."""
    d, mean = len(sums), np.array([s / n for s in sums])

    def dense(no: int, chunk: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = _matrix(chunk, d) - mean
        for c in range(0, d, BLOCK_COLS):
            yield _dense((no, c // BLOCK_COLS), x[:, c : c + BLOCK_COLS])

    found = blocks.map(dense, _BLOCKS)
    made = callMLlibFunc("createBlockMatrix", found, blocks.size, BLOCK_COLS, blocks.total * blocks.size, d)
    return BlockMatrix(made, blocks.size, BLOCK_COLS)


def _inner(b: BlockMatrix, blocks: Blocks) -> np.ndarray:
    """B'B, its middle dimension split among tasks."""
    spread = int(blocks.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = b._java_matrix_wrapper._java_model  # the Python class has no argument for the split
    made = b.transpose()._java_matrix_wrapper._java_model.multiply(of, max(1, min(blocks.total, spread)))
    return BlockMatrix(made, b.colsPerBlock, b.colsPerBlock).toLocalMatrix().toArray()


def _times(b: BlockMatrix, p: np.ndarray, spark: SparkSession) -> BlockMatrix:
    parts = [((c // BLOCK_COLS, 0), p[c : c + BLOCK_COLS]) for c in range(0, len(p), BLOCK_COLS)]
    local = spark.sparkContext.parallelize([(at, DenseMatrix(*x.shape, x.ravel(order="F").tolist())) for at, x in parts], len(parts))
    return b.multiply(BlockMatrix(local, BLOCK_COLS, BLOCK_COLS, *p.shape))


def fit(distinct: DataFrame, d: int) -> tuple[Whitening, float | None]:
    """The model of a written table of distinct vectors, and how far their whitened covariance is from the identity."""
    n, sums = sums_of(distinct, d)
    blocks = Blocks.of(distinct, d)
    b = centred(blocks, n, sums)
    v = _inner(b, blocks) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values)[:COMPONENTS]
    model = Whitening(n, tuple(sums), values[order], vectors[:, order], float(np.trace(v)))
    if not model.kept:
        return model, None
    white = _inner(_times(b, model.matrix(), distinct.sparkSession), blocks) / n
    return model, float(np.abs(white - np.eye(model.kept)).max())


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per sound vector and component: the key, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    spark = rows.sparkSession
    kind = rows.schema[key].dataType
    result = T.StructType().add(key, kind).add("component", "integer").add("n", "long").add("deviation", "long").add("whitened", "double").add("explained", "double").add("identity_error", "double")
    x, d = scaled(rows, key, vector)
    if not d:
        return spark.createDataFrame([], result)
    model, error = fit(written(x.select("x").distinct(), "whiten-distinct"), d)
    blocks = Blocks.of(x, d)
    n, sums = model.n, model.sums

    def about(no: int, chunk: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The keys and deviations of a block."""
        values, wide = _matrix(chunk, d), _exact(np.array([max(map(abs, sums))], object), 1)
        top = n * max(abs(int(values.max())), abs(int(values.min()))) + abs(int(wide[0]))
        if d * top * top >= _LONG:
            values = values.astype(object)
        off = n * values - np.array(sums, values.dtype)
        total = [v if v < _LONG else None for v in (off * off).sum(1).tolist()]
        whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        yield pa.RecordBatch.from_arrays([pa.array([no]), whole(chunk.column(0)), whole(pa.array(total, pa.int64()))], names=["block", "keys", "off"])

    held = T.StructType().add("block", "long").add("keys", T.ArrayType(kind)).add("off", T.ArrayType(T.LongType()))
    each = blocks.map(about, held)
    count, kept = min(COMPONENTS, d), model.kept
    explained = [float(e / model.trace) if model.trace > 0 else None for e in model.values]
    if kept:
        made = _times(centred(blocks, n, list(sums)), model.matrix(), spark)
        white = callMLlibFunc("getMatrixBlocks", made._java_matrix_wrapper._java_model).toDF("at", "m")
        each = each.join(white.select(F.col("at._1").cast("bigint").alias("block"), "m"), "block").select("keys", "off", "m")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                keys, off = (row.column(row.schema.get_field_index(c)).flatten() for c in ("keys", "off"))
                rows_in = len(keys)
                if kept:
                    m = row.column(row.schema.get_field_index("m"))
                    flip = m.field("isTransposed")[0].as_py()
                    w = m.field("values").flatten().to_numpy(zero_copy_only=False).reshape((rows_in, kept), order="C" if flip else "F")
                for c in range(count):
                    column = pa.array(w[:, c]) if c < kept else pa.nulls(rows_in, pa.float64())
                    same = lambda v, t: pa.array([v], t).take(pa.array(np.zeros(rows_in, np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [keys, same(c + 1, pa.int32()), same(n, pa.int64()), off, column, same(explained[c], pa.float64()), same(error, pa.float64())],
                        names=result.names,
                    )

    return each.mapInArrow(spread, result)


@register("op12_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
