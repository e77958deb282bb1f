"""User folds as (initial, step, combine), run in two levels over any key.

A fold is defined over accumulators, rows of whole numbers: ``initial`` is the neutral one,
``step`` turns records into accumulators of their own, and ``combine`` joins an earlier
accumulator with a later one. ``combine`` must be associative, not commutative. Then the
records of a key may be cut anywhere: blocks are combined on their own, one row per block
carries the result over, and no key has to fit a task. A state machine is such a fold:
a record is a map from each state to the next, and maps compose.

The same definition drives the stateful processor of the streaming form, see
``eventfold.streaming.compose``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventfold.plans.hot import BLOCK_ROWS, split
from eventfold.session import written

ACC = "array<bigint>"


@dataclass(frozen=True)
class FoldSpec:
    """A fold. ``step`` and ``combine`` take and return int64 arrays with one row per record.

    ``inputs`` are the bigint columns that ``step`` reads, in its order, as expressions over
    the records. ``outputs`` name columns of the result as expressions over the accumulator,
    a bigint array that starts at 1.
    """

    name: str
    initial: tuple[int, ...]
    inputs: Mapping[str, Column]
    step: Callable[[np.ndarray], np.ndarray]
    combine: Callable[[np.ndarray, np.ndarray], np.ndarray]
    outputs: Callable[[Column], Mapping[str, Column]]

    def bare(self) -> FoldSpec:
        """What tasks need: the definition without its column expressions."""
        return replace(self, inputs={}, outputs=None)

    @property
    def identity(self) -> np.ndarray:
        return np.array([self.initial], np.int64)

    def reduce(self, accs: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """One accumulator per segment; ``segment`` numbers neighbouring rows, increasing."""
        while len(accs) > 1:
            starts = np.r_[True, segment[1:] != segment[:-1]]
            inside = np.arange(len(accs)) - np.maximum.accumulate(np.where(starts, np.arange(len(accs)), 0))
            first = np.flatnonzero(inside % 2 == 0)
            pair = first[(first + 1 < len(accs)) & ~np.r_[starts, True][first + 1]]
            if not len(pair):
                break
            accs[pair] = self.combine(accs[pair], accs[pair + 1])
            accs, segment = accs[first], segment[first]
        return accs

    def scan(self, accs: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Each row's accumulator of its segment up to and including it."""
        starts = np.r_[True, segment[1:] != segment[:-1]] if len(accs) else np.zeros(0, bool)
        inside = np.arange(len(accs)) - np.maximum.accumulate(np.where(starts, np.arange(len(accs)), 0))
        reach = 1
        while (inside >= reach).any():
            late = np.flatnonzero(inside >= reach)
            accs[late] = self.combine(accs[late - reach], accs[late])
            reach *= 2
        return accs


def _runs(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Numbers of the runs of equal keys, the first ``keys`` columns. Null equals null."""
    change = np.zeros(max(batch.num_rows - 1, 0), bool)
    for i in range(keys):
        codes = pc.fill_null(pc.dictionary_encode(batch.column(i)).indices, -1).to_numpy(zero_copy_only=False)
        change |= codes[1:] != codes[:-1]
    return np.cumsum(np.r_[False, change])


def _key(batch: pa.RecordBatch, row: int, keys: int) -> tuple:
    return tuple(batch.column(i)[row].as_py() for i in range(keys))


def _numbers(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns]
    return np.stack(cols, 1).astype(np.int64) if cols else np.zeros((batch.num_rows, 0), np.int64)


def _accs(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).copy()


def _lists(accs: np.ndarray) -> pa.Array:
    width = accs.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, accs.size + 1, width, dtype=np.int32)), pa.array(accs.ravel()))


def _combined(rows: DataFrame, spec: FoldSpec, keys: Sequence[str], elements: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """One row (keys, acc) per key of rows sorted by key (their first columns), streamed with one accumulator held."""
    n, names, spec = len(keys), [*keys, "acc"], spec.bare()
    schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField("acc", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            segment, accs = _runs(batch, n), elements(batch)
            if last == _key(batch, 0, n):
                accs[:1] = spec.combine(held, accs[:1])
            elif last is not None:
                yield pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(last, kinds)], _lists(held)], names=names)
            first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            whole = spec.reduce(accs, segment)
            last, held, kinds = _key(batch, batch.num_rows - 1, n), whole[-1:].copy(), [batch.column(i).type for i in range(n)]
            if len(first) > 1:
                at = pa.array(first[:-1])
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(at) for i in range(n)], _lists(whole[:-1])], names=names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([*[pa.array([v], t) for v, t in zip(last, kinds)], _lists(held)], names=names)

    return rows.mapInArrow(run, schema)


def _prepared(rows: DataFrame, spec: FoldSpec, key: str, order: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    kept = list(dict.fromkeys([key, *order, *more]))
    clash = sorted(({*spec.inputs} | {"acc", "before", "block"}) & {*kept})
    if clash:
        raise ValueError(f"columns {clash} are the fold's own")
    return rows.select(*kept, *[c.cast("bigint").alias(name) for name, c in spec.inputs.items()])


def _steps(spec: FoldSpec) -> Callable[[pa.RecordBatch], np.ndarray]:
    names, step = list(spec.inputs), spec.step
    return lambda batch: step(_numbers(batch, names))


def fold(rows: DataFrame, spec: FoldSpec, key: str, order: Sequence[str], *, find_hot: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per key: the key and the fold's outputs after its last record along ``order``.

    ``order`` columns must place the records of a key uniquely. Narrow columns are written
    once; ordinary keys shuffle once, keys with more than ``block_rows`` records are combined
    block by block first. Without ``find_hot`` nothing is written and no key is cut.
    """
    slim, steps = _prepared(rows, spec, key, order), _steps(spec)
    cold, hot = split(written(slim, spec.name), key, order, block_rows) if find_hot else (slim, None)
    done = _combined(cold.repartition(key).sortWithinPartitions(key, *order), spec, [key], steps)
    if hot is not None:
        blocks = _block_accs(hot, spec, key, order, steps)
        whole = blocks.repartition(key).sortWithinPartitions(key, "block")
        width = len(spec.initial)
        done = done.unionByName(_combined(whole, spec, [key], lambda batch: _accs(batch.column(2), width)))
    return done.select(key, *[c.alias(n) for n, c in spec.outputs(F.col("acc")).items()])


def _block_accs(hot: DataFrame, spec: FoldSpec, key: str, order: Sequence[str], steps) -> DataFrame:
    dealt = hot.repartition(key, "block").sortWithinPartitions(key, "block", *order)
    return _combined(_by_key_columns(dealt, [key, "block"]), spec, [key, "block"], steps)


def scan(
    rows: DataFrame, spec: FoldSpec, key: str, order: Sequence[str], *, keep: Sequence[str] = (), find_hot: bool = True, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Every record with its ``keep`` columns and the accumulators ``before`` and after it (``acc``).

    Hot keys take two passes: one row per block, a running combination over these rows, and
    the records again, each block entering with what came before it.
    """
    slim, steps = _prepared(rows, spec, key, order, keep), _steps(spec)
    cold, hot = split(written(slim, spec.name), key, order, block_rows) if find_hot else (slim, None)
    columns = [c for c in slim.columns if c not in spec.inputs]
    kept = [slim.schema[c] for c in columns]
    acc = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("before", "acc")]

    def over(part: DataFrame, keys: Sequence[str], elements=steps, entering: bool = False) -> DataFrame:
        n, bare = len(keys), spec.bare()
        extra = [part.schema["block"]] if "block" in part.columns and "block" not in columns else []
        names = [f.name for f in [*kept, *extra]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, held = None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                segment, accs = _runs(batch, n), elements(batch)
                start = np.r_[True, segment[1:] != segment[:-1]]
                before = np.repeat(bare.identity, len(accs), 0)
                if entering:
                    come = _accs(batch.column(batch.schema.get_field_index("entering")), len(bare.initial))
                    before[start] = come[start]
                if last == _key(batch, 0, n):
                    before[:1] = held
                accs[start] = bare.combine(before[start], accs[start])
                accs = bare.scan(accs, segment)
                late = np.flatnonzero(~start)
                before[late] = accs[late - 1]
                last, held = _key(batch, batch.num_rows - 1, n), accs[-1:].copy()
                whole = [batch.column(batch.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*whole, _lists(before), _lists(accs)], names=[*names, "before", "acc"])

        return part.mapInArrow(run, T.StructType([*kept, *extra, *acc]))

    done = over(_by_key_columns(cold.repartition(key).sortWithinPartitions(key, *order), [key]), [key])
    if hot is None:
        return done
    blocks = _block_accs(hot, spec, key, order, steps)
    plain = blocks.select(key, "block", "acc").repartition(key).sortWithinPartitions(key, "block")
    entering = _running_blocks(plain, spec, key)
    joined = hot.join(entering, [F.col(key).eqNullSafe(F.col("_k")), F.col("block") == F.col("_b")]).drop("_k", "_b")
    dealt = joined.repartition(key, "block").sortWithinPartitions(key, "block", *order)
    return done.unionByName(over(_by_key_columns(dealt, [key, "block"]), [key, "block"], entering=True).drop("block"))


def _by_key_columns(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows with the key columns in front."""
    return rows.select(*keys, *[c for c in rows.columns if c not in keys])


def _running_blocks(blocks: DataFrame, spec: FoldSpec, key: str) -> DataFrame:
    """Rows (_k, _b, entering): what came before each block of a key."""
    spec = spec.bare()
    schema = T.StructType([T.StructField("_k", blocks.schema[key].dataType), T.StructField("_b", T.LongType()), T.StructField("entering", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            segment, accs = _runs(batch, 1), _accs(batch.column(2), len(spec.initial))
            start = np.r_[True, segment[1:] != segment[:-1]]
            before = np.repeat(spec.identity, len(accs), 0)
            if last == _key(batch, 0, 1):
                before[:1] = held
            accs[start] = spec.combine(before[start], accs[start])
            accs = spec.scan(accs, segment)
            late = np.flatnonzero(~start)
            before[late] = accs[late - 1]
            last, held = _key(batch, batch.num_rows - 1, 1), accs[-1:].copy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(before)], names=schema.names)

    return blocks.mapInArrow(run, schema)
