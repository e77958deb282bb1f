"""Stateful processors for the retry lane, and for the fold with one order a key.

The jobs run the fold and the guard over buckets of orders, see ``cells``; the forms here say what
one order does. Rows of a key arrive unordered within a micro-batch and are sorted by offset
first; the trigger options bound that sort.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from eventfold.lifecycle import ORDER_LIFECYCLE, Lifecycle

FOLD_OUTPUT = (
    "group_id string, order_id string, partition int, offset bigint, is_tombstone boolean, sequence bigint, "
    "prev_sequence bigint, prev_state string, redelivery boolean, seq_gap boolean, illegal boolean, handler_ok boolean, "
    "last_sequence bigint, state string, last_event_id string, handled_count bigint"
)
_FOLD_STATE = "folds map<string,struct<last_sequence:bigint,state:string,last_event_id:string,handled_count:bigint>>"


_FOLD_FIELDS = ("last_sequence", "state", "last_event_id", "handled_count")


def _values(struct, fields) -> tuple:
    """A struct stored inside a map, where it arrives as a dict, as a tuple."""
    return tuple(struct[f] for f in fields)


class FoldProcessor(StatefulProcessor):
    """Folds one order for every group.

    Input rows: ``offset, partition, is_tombstone, sequence, event_type, event_id`` and
    ``seen``, an array of (group_id, handler_ok) for the groups that take the record. All
    groups share one state value, so a record crosses the shuffle once.
    """

    def __init__(self, guarded: bool = True, lifecycle: Lifecycle = ORDER_LIFECYCLE):
        self.guarded = guarded
        self.before = {event: before for event, before, _ in lifecycle.steps}
        self.leads_to = {event: state for event, _, state in lifecycle.steps}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.store = handle.getValueState("folds", _FOLD_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.store.get()
        folds = {g: _values(v, _FOLD_FIELDS) for g, v in (held[0] or {}).items()} if held else {}
        for r in sorted(rows, key=lambda r: r.offset):
            for seen in r.seen:
                yield self._step(key[0], r, seen["group_id"], seen["handler_ok"], folds)
        if folds:
            self.store.update((folds,))
        elif held:
            self.store.clear()

    def _step(self, order_id, r, group, ok, folds):
        old = folds.get(group)
        prev_seq, prev_state = (old[0], old[1]) if old else (None, None)
        if r.is_tombstone:
            folds.pop(group, None)
            flags, new = (False, False, False), None
        else:
            again = old is not None and r.sequence <= prev_seq
            gap = not again and r.sequence != (prev_seq or 0) + 1
            illegal = not again and self.before[r.event_type] != prev_state
            flags, new = (again, gap, illegal), old
            if ok:
                count = (old[3] if old else 0) + 1
                if old is None or not self.guarded or r.sequence > prev_seq:
                    new = (r.sequence, self.leads_to[r.event_type], r.event_id, count)
                else:
                    new = (old[0], old[1], old[2], count)
                folds[group] = new
        return Row(
            group_id=group, order_id=order_id, partition=r.partition, offset=r.offset, is_tombstone=r.is_tombstone,
            sequence=r.sequence, prev_sequence=prev_seq, prev_state=prev_state, redelivery=flags[0], seq_gap=flags[1],
            illegal=flags[2], handler_ok=bool(ok), last_sequence=new[0] if new else None, state=new[1] if new else None,
            last_event_id=new[2] if new else None, handled_count=new[3] if new else 0,
        )

    def close(self) -> None:
        pass


_WAITING = (
    "arrival bigint, topic_rank int, partition int, offset bigint, is_tombstone boolean, sequence bigint, event_type string, "
    "event_id string, groups array<string>, oks array<boolean>"
)


class MergedFoldProcessor(FoldProcessor):
    """The fold over several topics: rows wait in keyed state until the watermark has passed them.

    Rows of an order come from several topics in any order. They are drained by event-time
    timers, sorted by (arrival, topic rank, offset), so a delete and an event meet in the
    order of the log whichever is read first. An order holds at most its rows of the
    watermark's delay. Every call to the store is a trip to the JVM, so a batch of an order
    is one append and one timer, at its first row; a drain sets the next one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        come = [
            (r.arrival, r.topic_rank, r.partition, r.offset, r.is_tombstone, r.sequence, r.event_type, r.event_id, [x["group_id"] for x in r.seen], [bool(x["handler_ok"]) for x in r.seen])
            for r in rows
        ]
        if come:
            self.waiting.appendList(come)
            self._wake(min(r[0] for r in come))
        return iter(())

    def _wake(self, arrival: int) -> None:
        self.handle.registerTimer(-(-arrival // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [Row(*_WAITING_FIELDS)(*tuple(r)) for r in self.waiting.get()]
        now, later = [r for r in held if r.arrival <= passed], [r for r in held if r.arrival > passed]
        if now:
            stored = self.store.get()
            folds = {g: _values(v, _FOLD_FIELDS) for g, v in (stored[0] or {}).items()} if stored else {}
            for r in sorted(now, key=lambda r: (r.arrival, r.topic_rank, r.offset)):
                for group, ok in zip(r.groups, r.oks):
                    yield self._step(key[0], r, group, ok, folds)
            if folds:
                self.store.update((folds,))
            elif stored:
                self.store.clear()
            if later:
                self.waiting.put([tuple(r) for r in later])
                self._wake(min(r.arrival for r in later))
            else:
                self.waiting.clear()


_WAITING_FIELDS = [f.split()[0] for f in _WAITING.split(", ")]


#: A waiting record as it crosses to Python: times as numbers, headers as two lists.
RELEASE_ROWS = (
    "topic string, partition int, offset bigint, micros bigint, key binary, value binary, names array<string>, "
    "texts array<binary>, due_ms bigint, released_ms bigint"
)
_LANE_FIELDS = [f.split()[0] for f in RELEASE_ROWS.split(", ")][:-1]
#: Waiting records in one value of the state, once their release times are known.
PIECE = 1024


class ReleaseProcessor(StatefulProcessor):
    """A lane of waiting records: first in, first out, each held until it is due.

    Keyed by the lane's partition, and by attempt where every attempt has a lane of its own.
    A record's gate is the latest due time up to it, so it never falls along the lane and says
    alone when the record leaves. Records are put into the state as they come, batch by batch; only their
    offsets and due times are held together, for the gates. Then each batch is read once: what
    is due leaves, the rest goes back in pieces of neighbouring gates, and an index of the
    pieces' first gates says which ones a release reads. One timer stands at the first gate; it fires without
    new records. ``at_ms`` judges the lane as of that moment instead, without timers.
    """

    def __init__(self, at_ms: int | None = None):
        self.at_ms = at_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: next number, gate of the lane's last record, first gate of each piece
        self.index = handle.getValueState("index", "index binary")
        self.pieces = handle.getMapState("pieces", "number bigint", "records binary")

    def _known(self) -> tuple[int, int | None, dict[int, int]]:
        held = self.index.get()
        return pickle.loads(held[0]) if held else (0, None, {})

    def _put(self, number: int, rows: pd.DataFrame) -> None:
        self.pieces.updateValue((number,), (pickle.dumps(rows, pickle.HIGHEST_PROTOCOL),))

    def _take(self, number: int) -> pd.DataFrame:
        rows = pickle.loads(self.pieces.getValue((number,))[0])
        self.pieces.removeKey((number,))
        return rows

    def _keep(self, number: int, last: int | None, first: dict[int, int]) -> None:
        self.index.update((pickle.dumps((number, last, first)),))
        if first and self.at_ms is None:
            self.handle.registerTimer(min(first.values()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.at_ms or timerValues.getCurrentProcessingTimeInMs()
        number, last, first = self._known()
        came, offsets, due = [], [], []
        for pdf in rows:
            self._put(number, pdf[_LANE_FIELDS])
            came.append(number)
            offsets.append(pdf["offset"].to_numpy(np.int64))
            due.append(pdf["due_ms"].to_numpy(np.int64))
            number += 1
        at = np.argsort(np.concatenate(offsets), kind="stable")
        gates = np.empty(len(at), np.int64)
        gates[at] = np.maximum.accumulate(np.concatenate(due)[at])
        if last is not None:
            gates = np.maximum(gates, last)
        last, seen = int(gates.max()), 0
        # what waited before stands before these
        yield from self._release(first, now)
        for n, part in zip(came, offsets):
            mine = gates[seen:seen + len(part)]
            seen += len(part)
            chunk = self._take(n).assign(gate=mine).sort_values(["gate", "offset"], ignore_index=True)
            cut = int(np.searchsorted(chunk["gate"].to_numpy(), now, side="right"))
            if cut:
                yield chunk.iloc[:cut][_LANE_FIELDS].assign(released_ms=now)
            for start in range(cut, len(chunk), PIECE):
                piece = chunk.iloc[start:start + PIECE]
                self._put(number, piece)
                first[number] = int(piece["gate"].iloc[0])
                number += 1
        self._keep(number, last, first)

    def _release(self, first: dict[int, int], now: int) -> Iterator[pd.DataFrame]:
        for n in sorted(n for n, gate in first.items() if gate <= now):
            piece = self._take(n)
            cut = int(np.searchsorted(piece["gate"].to_numpy(), now, side="right"))
            yield piece.iloc[:cut][_LANE_FIELDS].assign(released_ms=now)
            if cut < len(piece):
                left = piece.iloc[cut:]
                self._put(n, left)
                first[n] = int(left["gate"].iloc[0])
            else:
                del first[n]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, last, first = self._known()
        yield from self._release(first, timerValues.getCurrentProcessingTimeInMs())
        self._keep(number, last, first)

    def close(self) -> None:
        pass
