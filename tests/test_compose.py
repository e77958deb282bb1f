"""Composable folds against a walk through the rows, in batch, for hot keys, and as a stream."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventfold.lifecycle import ORDER_LIFECYCLE, Lifecycle
from eventfold.operators import commands as O
from eventfold.operators import guarded as G
from eventfold.plans.compose import FoldSpec, fold, scan
from eventfold.streaming.compose import scan_stream
from eventfold.streaming.jobs import guard_stream, run_once

#: An order may be cancelled before it ships, and come back after it was delivered.
BRANCHING = Lifecycle(
    (
        ("ORDER_CREATED", None, "CREATED"), ("PACKED", "CREATED", "PACKED"), ("CANCELLED", "CREATED", "CANCELLED"),
        ("CANCELLED", "PACKED", "CANCELLED"), ("SHIPPED", "PACKED", "SHIPPED"), ("DELIVERED", "SHIPPED", "DELIVERED"),
        ("RETURNED", "DELIVERED", "RETURNED"), ("SHIPPED", "RETURNED", "SHIPPED"),
    )
)
EVENTS = "order_id string, partition int, offset bigint, sequence bigint, event_type string, is_tombstone boolean"


def events(seed, n, keys, lifecycle):
    draw = random.Random(seed)
    names = list(dict.fromkeys(lifecycle.event_types))
    rows = []
    for i in range(n):
        key = None if draw.random() < 0.02 else f"k{min(draw.randrange(keys), draw.randrange(keys))}"
        stone = draw.random() < 0.05
        rows.append((key, 1, i, None if stone else draw.randint(1, 6), None if stone else draw.choice([*names, "ODD"]), stone))
    return rows


def walk(rows, lifecycle):
    """(key, offset) -> (state, last sequence, place of the creation) after each row, one at a time."""
    legal = {(e, before): after for e, before, after in lifecycle.steps}
    held, out = {}, {}
    for key, part, off, seq, event, stone in sorted(rows, key=lambda r: r[2]):
        state, last, born = held.get(key, (None, None, None))
        if stone:
            state, last, born = None, None, None
        elif (event, state) in legal:
            born = (part << 48) + off if state is None else born
            state, last = legal[(event, state)], max(seq, last or 0)
        elif state is not None and event != "ODD":
            last = max(last, seq)
        held[key] = out[(key, off)] = (state, last, born)
    return held, out


@pytest.mark.parametrize("lifecycle", [ORDER_LIFECYCLE, BRANCHING], ids=["line", "branching"])
@pytest.mark.parametrize("block_rows", [1 << 20, 40], ids=["cold", "hot"])
def test_batch_equals_walk(spark, lifecycle, block_rows):
    rows = events(5, 900, 12, lifecycle)
    held, each = walk(rows, lifecycle)
    table = spark.createDataFrame(rows, EVENTS).repartition(6)
    spec = G.event_fold(lifecycle)
    got = fold(table, spec, "order_id", ["offset"], block_rows=block_rows).collect()
    assert {r.order_id: (r.state, r.last_sequence, r.created_at) for r in got} == held and len(got) == len(held)
    steps = scan(table, spec, "order_id", ["offset"], block_rows=block_rows)
    after = steps.select("order_id", "offset", *[c.alias(n) for n, c in spec.outputs(F.col("acc")).items()]).collect()
    assert {(r.order_id, r.offset): tuple(r)[2:] for r in after} == each and len(after) == len(rows)


def test_stream_equals_batch_on_a_branching_lifecycle(spark, tmp_path):
    rows = [r for r in events(9, 600, 10, BRANCHING) if r[0] is not None]
    path = str(tmp_path / "log")
    for part in (rows[:250], rows[250:251], rows[251:]):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(path)
    spec = G.event_fold(BRANCHING)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)
    run_once(scan_stream(stream, spec, "order_id", ["offset"]), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    mine = {(r.order_id, r.offset): (r.before, r.acc) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = scan(spark.read.parquet(path), spec, "order_id", ["offset"], block_rows=50).collect()
    assert mine == {(r.order_id, r.offset): (r.before, r.acc) for r in batch}


def test_empty_tables(spark):
    spec, none = G.event_fold(), spark.createDataFrame([], EVENTS)
    assert fold(none, spec, "order_id", ["offset"]).count() == 0 and scan(none, spec, "order_id", ["offset"]).count() == 0


def test_other_folds_work_the_same(spark):
    """A fold that is not a state machine: rows seen, and the last value minus the first."""
    spec = FoldSpec(
        "drift", (0, 0, 0), {"f_v": F.col("v")},
        lambda rows: np.concatenate([np.ones_like(rows), rows, rows], 1),
        lambda a, b: np.stack([a[:, 0] + b[:, 0], np.where(a[:, 0] > 0, a[:, 1], b[:, 1]), np.where(b[:, 0] > 0, b[:, 2], a[:, 2])], 1),
        lambda acc: {"n": F.element_at(acc, 1), "drift": F.element_at(acc, 3) - F.element_at(acc, 2)},
    )
    rows = [(i % 3, i, (i * 37) % 101) for i in range(200)]
    got = fold(spark.createDataFrame(rows, "key int, at int, v int"), spec, "key", ["at"], block_rows=30).collect()
    want = {k: [v for x, _, v in rows if x == k] for k in range(3)}
    assert {r.key: (r.n, r.drift) for r in got} == {k: (len(v), v[-1] - v[0]) for k, v in want.items()}


def test_a_fold_names_its_clashes(spark):
    with pytest.raises(ValueError, match="block"):
        fold(spark.createDataFrame([], f"{EVENTS}, block int"), G.event_fold(), "order_id", ["offset", "block"])


COMMANDS = "cmd_id bigint, kind string, order_id string, event_type string, force boolean, publish_ok boolean, payload_ok boolean, payload_reason string"


def commands(seed, lifecycle):
    draw = random.Random(seed)
    names = list(dict.fromkeys(lifecycle.event_types))
    kinds = ["create", "advance", "advance", "advance", "advance", "delete"]
    return [
        (i, kind := draw.choice(kinds), f"o{draw.randrange(9)}", draw.choice(names[1:]) if kind == "advance" else None, draw.random() < 0.2, draw.random() < 0.9, draw.random() < 0.9, "bad")
        for i in range(700)
    ]


@pytest.mark.parametrize("block_rows", [1 << 20, 30])
def test_branching_batch_guard_equals_stream_guard(spark, tmp_path, block_rows):
    table = spark.createDataFrame(commands(3, ORDER_LIFECYCLE), COMMANDS)
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    table.coalesce(1).write.parquet(path)
    run_once(guard_stream(spark.readStream.schema(COMMANDS).parquet(path)), out, str(tmp_path / "ckpt"))
    by_id = lambda df: {r.cmd_id: r.asDict() for r in df.collect()}
    mine = by_id(G.guard_any(table, ORDER_LIFECYCLE, block_rows=block_rows))
    assert mine == by_id(spark.read.parquet(out))
    line = by_id(O.guard(table).select(*next(iter(mine.values()))))
    known = {i for i, r in line.items() if not (r["kind"] == "create" and mine[i]["status"] == 409)}
    assert {i: line[i] for i in known} == {i: mine[i] for i in known}


def test_branching_guard_takes_every_branch(spark):
    steps = ["PACKED", "CANCELLED", "SHIPPED"]
    rows = [(1, "create", "a", None, False, True, True, None), *[(2 + i, "advance", "a", e, False, True, True, None) for i, e in enumerate(steps)]]
    got = sorted(G.guard_any(spark.createDataFrame(rows, COMMANDS), BRANCHING).collect(), key=lambda r: r.cmd_id)
    assert [(r.status, r.sequence, r.state_after) for r in got] == [(201, 1, "CREATED"), (200, 2, "PACKED"), (200, 3, "CANCELLED"), (409, None, "CANCELLED")]
