"""Guarded state over a log or a command list, for any lifecycle, by composing maps of states.

An event moves an order only from a state it may follow; anything else, such as a forced
step, leaves the state alone. So an event is a small map from state to state, and a run of
events is their composition. Besides the state, the maps carry what it depends on from
where an order came: the place of the creation it began with and its highest sequence.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.lifecycle import ORDER_LIFECYCLE, Lifecycle
from eventfold.operators.commands import check_advances
from eventfold.plans.compose import FoldSpec, scan
from eventfold.plans.hot import BLOCK_ROWS

#: Bits of a place that hold the offset; the partition stands above them.
OFFSET_BITS = 48


def place(partition: Column, offset: Column) -> Column:
    """A record's place in its topic as one number."""
    return F.shiftleft(partition.cast("bigint"), OFFSET_BITS) + offset


def _steps(lifecycle: Lifecycle) -> tuple[list[str], np.ndarray]:
    """Event types, and for each the next state from every state; state 0 is no order."""
    events = list(dict.fromkeys(lifecycle.event_types))
    states = [None, *lifecycle.states]
    to = np.tile(np.arange(len(states)), (len(events), 1))
    for event, before, after in lifecycle.steps:
        to[events.index(event), states.index(before)] = states.index(after)
    return events, to


def event_fold(lifecycle: Lifecycle = ORDER_LIFECYCLE, *, event_type: str = "event_type", stone: str = "is_tombstone", at: Column | None = None) -> FoldSpec:
    """The guard over log records: ``state``, ``last_sequence`` and ``created_at``, the place of the creation.

    Records: ``event_type``, ``sequence``, a tombstone flag, and ``partition``/``offset`` or the
    place ``at``. An order without a creation, and one that was deleted, has a null state. The
    highest sequence counts every event while the order exists, forced ones too.
    """
    events, to = _steps(lifecycle)
    n = to.shape[1]
    code = F.when(F.col(stone), F.lit(-1)).otherwise(F.coalesce(F.array_position(F.array(*[F.lit(e) for e in events]), F.col(event_type)), F.lit(0)))
    # accumulator: next state | place of the creation (-1: the one before) | highest sequence | a tombstone seen; by entering state
    inputs = {"f_code": code, "f_sequence": F.coalesce("sequence", F.lit(0)), "f_place": place(F.col("partition"), F.col("offset")) if at is None else at}

    def step(rows: np.ndarray) -> np.ndarray:
        code, sequence, where = rows.T
        table = np.concatenate([np.zeros((1, n), np.int64), np.arange(n)[None], to])  # tombstone, unknown, events
        nxt = table[code + 1]
        born = (nxt > 0) & (np.arange(n) == 0)
        out = np.zeros((len(rows), 3 * n + 1), np.int64)
        out[:, :n] = nxt
        out[:, n : 2 * n] = np.where(born, where[:, None], -1)
        out[:, 2 * n : 3 * n] = np.where((nxt > 0) & (code > 0)[:, None], sequence[:, None], 0)
        out[:, 3 * n] = code == -1
        return out

    def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mid = a[:, :n]
        after = lambda k: np.take_along_axis(b[:, k * n : (k + 1) * n], mid, 1)
        gone = b[:, 3 * n :] > 0
        born, top = after(1), after(2)
        return np.concatenate(
            [after(0), np.where(born >= 0, born, a[:, n : 2 * n]), np.where(gone, top, np.maximum(a[:, 2 * n : 3 * n], top)), np.maximum(a[:, 3 * n :], b[:, 3 * n :])], 1
        )

    def outputs(acc: Column) -> dict[str, Column]:
        state = F.element_at(acc, 1)
        name = F.get(F.array(F.lit(None).cast("string"), *[F.lit(s) for s in lifecycle.states]), state.cast("int"))
        alive = state > 0
        return {"state": name, "last_sequence": F.when(alive, F.element_at(acc, 2 * n + 1)), "created_at": F.when(alive, F.element_at(acc, n + 1))}

    return FoldSpec("guarded-state", (*range(n), *[-1] * n, *[0] * n, 0), inputs, step, combine, outputs)


def command_fold(lifecycle: Lifecycle = ORDER_LIFECYCLE) -> FoldSpec:
    """The guard over commands. States: 0 never created, 1 deleted, then those of the lifecycle."""
    events, to = _steps(lifecycle)
    n = len(lifecycle.states) + 2
    first = 2 + lifecycle.states.index(next(s for _, before, s in lifecycle.steps if before is None))
    kinds = ["create", "advance", "delete"]
    flags = [F.coalesce(F.col(c), F.lit(False)).cast("bigint") for c in ("payload_ok", "publish_ok", "force")]
    inputs = {
        "f_kind": F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")),
        "f_event": F.coalesce(F.array_position(F.array(*[F.lit(e) for e in events]), F.col("event_type")), F.lit(0)),
        **dict(zip(("f_payload", "f_publish", "f_force"), flags)),
    }
    # legal[e, s] and next[e, s] with e = 0 for unknown event types
    legal, nxt = np.zeros((len(events) + 1, n), bool), np.tile(np.arange(n), (len(events) + 1, 1))
    for e in range(len(events)):
        for s in range(1, to.shape[1]):
            if to[e, s] != s or (events[e], lifecycle.states[s - 1], lifecycle.states[s - 1]) in lifecycle.steps:
                legal[e + 1, s + 1], nxt[e + 1, s + 1] = True, to[e, s] + 1

    def step(rows: np.ndarray) -> np.ndarray:
        kind, event, payload, publish, force = rows.T[:, :, None]
        state = np.arange(n)[None]
        ok, done, alive = payload > 0, publish > 0, state > 1
        create = (kind == 1) & (state == 0) & ok & done
        delete = (kind == 3) & alive & done
        may = legal[event[:, 0]]
        takes = (kind == 2) & alive & ok & ((force > 0) | may)
        after = np.where(create, first, np.where(delete, 1, np.where(takes & may & done, nxt[event[:, 0]], state)))
        return np.concatenate([after, (create | takes).astype(np.int64)], 1)

    def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mid = a[:, :n]
        return np.concatenate([np.take_along_axis(b[:, :n], mid, 1), a[:, n:] + np.take_along_axis(b[:, n:], mid, 1)], 1)

    def outputs(acc: Column) -> dict[str, Column]:
        at = F.element_at(acc, 1).cast("int")
        name = F.get(F.array(*[F.lit(None).cast("string")] * 2, *[F.lit(s) for s in lifecycle.states]), at)
        return {"state": name, "last_sequence": F.element_at(acc, n + 1), "known": at > 0}

    return FoldSpec("guard-commands", (*range(n), *[0] * n), inputs, step, combine, outputs)


def guard_any(commands: DataFrame, lifecycle: Lifecycle, *, find_hot: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The batch guard for any lifecycle, branching ones as well: the columns of the streaming guard.

    Rules as in ``commands.guard``: an existing order cannot be created again, unknown and
    deleted orders are 404, then the payload, then the step, then the publish.
    """
    commands, spec = check_advances(commands, lifecycle), command_fold(lifecycle)
    keep = ["cmd_id", "kind", "event_type", "payload_ok", "publish_ok", "force"]
    each = scan(commands, spec, "order_id", ["cmd_id"], keep=keep, find_hot=find_hot, block_rows=block_rows)
    before, after = spec.outputs(F.col("before")), spec.outputs(F.col("acc"))
    took = after["last_sequence"] > before["last_sequence"]
    is_ = lambda k: F.col("kind") == k
    ok, done = F.coalesce("payload_ok", F.lit(False)), F.coalesce("publish_ok", F.lit(False))
    status = (
        F.when(is_("create"), F.when(before["known"], 409).when(~ok, 422).when(done, 201).otherwise(502))
        .when(before["state"].isNull(), 404)
        .when(is_("delete"), F.when(done, 204).otherwise(502))
        .when(~ok, 422)
        .when(~took, 409)
        .otherwise(F.when(done, 200).otherwise(502))
    )
    return each.select(
        "cmd_id", "kind", "order_id", "event_type", status.alias("status"), F.when(took, after["last_sequence"]).alias("sequence"),
        before["state"].alias("state_before"), after["state"].alias("state_after"),
    )
