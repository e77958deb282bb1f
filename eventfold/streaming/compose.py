"""User folds on streams: the definition of ``plans.compose`` compiled to a stateful processor.

The state is one accumulator per key. Rows come as pandas batches; each batch is stepped and
combined in whole arrays, so no row passes through Python on its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from eventfold.plans.compose import ACC, FoldSpec


class ComposeProcessor(StatefulProcessor):
    """Folds the rows of a key in the order of ``order`` within a micro-batch, after those of earlier ones."""

    def __init__(self, spec: FoldSpec, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]):
        self.names, self.initial, self.keys, self.order, self.keep = list(spec.inputs), spec.initial, list(keys), list(order), list(keep)
        self.bare = spec.bare()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle.getValueState("acc", f"acc {ACC}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = np.array([self.store.get()[0] if self.store.exists() else self.initial], np.int64)
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable", ignore_index=True)
        accs = self.bare.step(batch[self.names].to_numpy(np.int64))
        accs[:1] = self.bare.combine(held, accs[:1])
        accs = self.bare.scan(accs, np.zeros(len(accs), np.int64))
        before = np.concatenate([held, accs[:-1]])
        self.store.update((accs[-1].tolist(),))
        out = batch[self.keep].copy()
        for i, k in enumerate(self.keys):
            out.insert(i, k, key[i])
        out["before"], out["acc"] = before.tolist(), accs.tolist()
        yield out

    def close(self) -> None:
        pass


def scan_stream(rows: DataFrame, spec: FoldSpec, key: str, order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The streaming form of ``plans.compose.scan``: every record with the accumulators before and after it.

    Micro-batches are folded one after another, so records must arrive in order between
    batches; within one, ``order`` sorts them.
    """
    kept = list(dict.fromkeys([*order, *keep]))
    slim = rows.select(key, *kept, *[c.cast("bigint").alias(n) for n, c in spec.inputs.items()])
    lists = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("before", "acc")]
    schema = T.StructType([slim.schema[key], *[slim.schema[c] for c in kept], *lists])
    return slim.where(F.col(key).isNotNull()).groupBy(key).transformWithStateInPandas(
        ComposeProcessor(spec, [key], order, kept), schema, "Append", "None"
    )
