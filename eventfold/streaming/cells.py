"""Stateful processors over buckets of orders: the fold, the fold over several topics, the guard.

With one order a key, Spark's Python runner spends several trips to the JVM and an Arrow batch of
its own on each order. Here the key is a bucket of orders, dealt by hash. The state of a bucket lies in
cells, small maps from order to its state; a batch reads and writes the cells of its orders only, so
calls follow the cells touched and what is rewritten does not grow with the bucket. Rows of a
bucket come as pandas batches, are sorted and stepped in one loop, and leave in batches.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from eventfold.lifecycle import ORDER_LIFECYCLE, Lifecycle

#: Keys of the store. Like the number of shuffle partitions it is fixed for the life of a checkpoint.
BUCKETS = 1024
#: Parts of a bucket's state.
CELLS = 64
#: Rows that leave at once, and that wait in one value.
ROWS = 10_000
#: A service that does not take a record, in ``marks``; others have 1 or 0 for their handler's success.
NOT_MINE = "-"


def bucket_of(order_id: Column) -> list[Column]:
    """``bucket`` and ``cell`` of an order."""
    h = F.xxhash64(order_id)
    return [
        F.pmod(h, F.lit(BUCKETS)).cast("int").alias("bucket"),
        F.pmod(F.shiftright(h, 32), F.lit(CELLS)).cast("int").alias("cell"),
    ]


class CellProcessor(StatefulProcessor):
    """State of the orders of a bucket, in cells. Subclasses step the rows."""

    #: Columns of an input row behind the bucket, of the output, and by which rows are sorted.
    columns: Sequence[str]
    output: Sequence[str]
    order: Sequence[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "cell int", "orders binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._run(pd.concat([pdf[list(self.columns)] for pdf in rows], ignore_index=True))

    def _run(self, batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        at = np.lexsort([batch[c].to_numpy() for c in reversed(self.order)])
        batch, held = batch.take(at), {}
        for cell in batch["cell"].unique().tolist():
            stored = self.cells.getValue((cell,))
            held[cell] = pickle.loads(stored[0]) if stored else {}
        out: list[tuple] = []
        for row in zip(*[batch[c].tolist() for c in self.columns]):
            self._step(row, held, out)
            if len(out) >= ROWS:
                yield pd.DataFrame(out, columns=list(self.output))
                out.clear()
        if out:
            yield pd.DataFrame(out, columns=list(self.output))
        for cell, orders in held.items():
            live = {o: state for o, state in orders.items() if state}
            if live:
                self.cells.updateValue((cell,), (pickle.dumps(live, pickle.HIGHEST_PROTOCOL),))
            else:
                self.cells.removeKey((cell,))

    def _step(self, row: tuple, held: dict, out: list[tuple]) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


#: Numbers are never null here; those of an absent fold are those beside a null state.
FOLD_ROWS = (
    "group_id string, order_id string, partition int, offset bigint, is_tombstone boolean, sequence bigint, "
    "prev_sequence bigint, prev_state string, redelivery boolean, seq_gap boolean, illegal boolean, handler_ok boolean, "
    "last_sequence bigint, state string, last_event_id string, handled_count bigint"
)


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


class FoldCells(CellProcessor):
    """Folds the orders of a bucket for every group. ``marks`` has a character per service."""

    columns = ("cell", "order_id", "partition", "offset", "is_tombstone", "sequence", "event_type", "event_id", "marks")
    output = _names(FOLD_ROWS)
    order = ("offset",)

    def __init__(self, groups: Sequence[str], guarded: bool = True, lifecycle: Lifecycle = ORDER_LIFECYCLE):
        self.groups, self.guarded = list(groups), guarded
        self.before = {event: before for event, before, _ in lifecycle.steps}
        self.leads_to = {event: state for event, _, state in lifecycle.steps}

    def _step(self, row, held, out):
        cell, order_id, partition, offset, stone, sequence, event, event_id, marks = row
        folds = held[cell].setdefault(order_id, {})
        for group, mark in zip(self.groups, marks):
            if mark == NOT_MINE:
                continue
            old = folds.get(group)
            prev_seq, prev_state = (old[0], old[1]) if old else (0, None)
            ok = mark == "1"
            if stone:
                folds.pop(group, None)
                again, gap, illegal, new = False, False, False, None
            else:
                again = old is not None and sequence <= prev_seq
                gap = not again and sequence != prev_seq + 1
                illegal = not again and self.before[event] != prev_state
                new = old
                if ok:
                    count = (old[3] if old else 0) + 1
                    if old is None or not self.guarded or sequence > prev_seq:
                        new = (sequence, self.leads_to[event], event_id, count)
                    else:
                        new = (old[0], old[1], old[2], count)
                    folds[group] = new
            out.append(
                (group, order_id, partition, offset, stone, sequence, prev_seq, prev_state, again, gap, illegal, ok, *(new or (0, None, None, 0)))
            )


class MergedFoldCells(FoldCells):
    """The fold over several topics: rows wait in keyed state until the watermark has passed them.

    Rows of an order come from several topics in any order. They are drained by event-time
    timers, sorted by (arrival, topic rank, offset), so a delete and an event meet in the
    order of the log whichever is read first. Rows wait in chunks sorted by arrival; an index of
    their first arrivals says which ones a drain reads, and what it leaves of them goes back.
    """

    order = ("arrival", "topic_rank", "offset")
    waits = (*FoldCells.columns, "arrival", "topic_rank")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getMapState("waiting", "number bigint", "rows binary")
        #: next number, time of the timer that stands, and the first arrival of each chunk
        self.index = handle.getValueState("index", "index binary")

    def _known(self) -> tuple[int, int | None, dict[int, int]]:
        held = self.index.get()
        return pickle.loads(held[0]) if held else (0, None, {})

    def _keep(self, number: int, wake: int | None, first: dict[int, int]) -> None:
        if first:
            soonest = -(-min(first.values()) // 1000)
            if wake is None or soonest < wake:
                self.handle.registerTimer(soonest)
                wake = soonest
            self.index.update((pickle.dumps((number, wake, first)),))
        else:
            self.index.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        number, wake, first = self._known()
        for pdf in rows:
            chunk = pdf[list(self.waits)].sort_values("arrival", kind="stable")
            first[number] = int(chunk["arrival"].iloc[0])
            self.waiting.updateValue((number,), (pickle.dumps(chunk, pickle.HIGHEST_PROTOCOL),))
            number += 1
        self._keep(number, wake, first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        number, _, first = self._known()
        now = []
        for at in sorted(n for n, arrival in first.items() if arrival <= passed):
            chunk = pickle.loads(self.waiting.getValue((at,))[0])
            cut = int(np.searchsorted(chunk["arrival"].to_numpy(), passed, side="right"))
            now.append(chunk.iloc[:cut])
            if cut < len(chunk):
                left = chunk.iloc[cut:]
                first[at] = int(left["arrival"].iloc[0])
                self.waiting.updateValue((at,), (pickle.dumps(left, pickle.HIGHEST_PROTOCOL),))
            else:
                del first[at]
                self.waiting.removeKey((at,))
        if now:
            yield from self._run(pd.concat(now, ignore_index=True))
        self._keep(number, None, first)


#: A sequence of 0 is none.
GUARD_ROWS = (
    "cmd_id bigint, kind string, order_id string, event_type string, status int, sequence bigint, "
    "state_before string, state_after string"
)


class GuardCells(CellProcessor):
    """The transition guard for any lifecycle: one (state, last sequence, born) per order."""

    columns = ("cell", "order_id", "cmd_id", "kind", "event_type", "force", "payload_ok", "publish_ok")
    output = _names(GUARD_ROWS)
    order = ("cmd_id",)

    def __init__(self, lifecycle: Lifecycle = ORDER_LIFECYCLE):
        self.before = {event: before for event, before, _ in lifecycle.steps}
        self.leads_to = {event: state for event, _, state in lifecycle.steps}
        self.first = next(state for _, before, state in lifecycle.steps if before is None)

    def _step(self, row, held, out):
        cell, order_id, cmd_id, kind, event_type, force, payload_ok, publish_ok = row
        state, last, born = held[cell].get(order_id) or (None, 0, False)
        was, sequence = state, 0
        if kind == "create":
            if born:
                status = 409
            elif not payload_ok:
                status = 422
            elif publish_ok:
                status, sequence, state, last, born = 201, 1, self.first, 1, True
            else:
                status = 502
        elif state is None:
            status = 404
        elif kind == "delete":
            status = 204 if publish_ok else 502
            state = None if publish_ok else state
        elif not payload_ok:
            status = 422
        else:
            legal = self.before.get(event_type) == state
            if not legal and not force:
                status = 409
            else:
                last += 1
                sequence, status = last, 200 if publish_ok else 502
                if publish_ok and legal:
                    state = self.leads_to[event_type]
        if born:
            held[cell][order_id] = (state, last, born)
        out.append((cmd_id, kind, order_id, event_type, status, sequence, was, state))
