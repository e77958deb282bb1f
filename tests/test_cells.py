"""Buckets of orders against one order a key, and how often they call the state store."""

import random
from types import SimpleNamespace as N

import pandas as pd

from eventfold.streaming import cells as C
from eventfold.streaming import processors as P
from helpers import TYPES, sequential_guard


class Store:
    """Map and value states in memory that count the calls; also the handle."""

    def __init__(self):
        self.values, self.calls, self.timers, self.made = {}, 0, [], {}

    def getMapState(self, name, *_):
        return self.made.setdefault(name, Store())

    getValueState = getMapState

    def getValue(self, key):
        self.calls += 1
        return self.values.get(key)

    def updateValue(self, key, value):
        self.calls += 1
        self.values[key] = value

    def removeKey(self, key):
        self.calls += 1
        self.values.pop(key, None)

    def get(self):
        return self.values.get(())

    def update(self, value):
        self.values[()] = value

    def clear(self):
        self.values.clear()

    def registerTimer(self, at):
        self.timers.append(at)


def events(n, orders, seed):
    """Rows of many orders in one bucket, two groups, with repeats, gaps, failures and deletes."""
    r, out = random.Random(seed), []
    for i in range(n):
        stone = r.random() < 0.1
        out.append(
            dict(cell=(o := r.randrange(orders)) % 7, order_id=f"o{o}", partition=0, offset=i, is_tombstone=stone, sequence=0 if stone else r.randint(1, 4),
                 event_type=None if stone else r.choice(TYPES), event_id=f"e{i}", marks="".join(r.choice("-0" if stone else "-01") for _ in "ab"),
                 arrival=1000 * r.randrange(n), topic_rank=r.randint(1, 2))
        )
    r.shuffle(out)
    return out


def expected(rows, order, guarded=True):
    """The fold with one order a key, all rows of it at once."""
    out = []
    for o in {r["order_id"] for r in rows}:
        p, folds = P.FoldProcessor(guarded), {}
        for r in sorted((r for r in rows if r["order_id"] == o), key=order):
            for group, mark in zip("ab", r["marks"]):
                if mark != "-":
                    out.append(p._step(o, N(**r), group, mark == "1", folds).asDict())
    return {(r["group_id"], r["offset"]): r for r in out}


def shown(frames):
    out = {}
    for r in pd.concat(frames).astype(object).to_dict("records"):
        if r["prev_state"] is None:
            r["prev_sequence"] = None
        if r["state"] is None:
            r["last_sequence"] = None
        out[(r["group_id"], r["offset"])] = r
    return out


def test_buckets_fold_like_single_orders_and_call_per_cell():
    for guarded in (True, False):
        p, store, rows = C.FoldCells(["a", "b"], guarded), Store(), events(4000, 300, 3)
        p.init(store)
        frames = []
        for half in ([r for r in rows if r["offset"] < 2000], [r for r in rows if r["offset"] >= 2000]):
            before = p.cells.calls
            frames += list(p.handleInputRows((0,), iter([pd.DataFrame(half[:700]), pd.DataFrame(half[700:])]), None))
            assert p.cells.calls - before <= 14  # seven cells, read and written once, whatever the orders
        assert shown(frames) == expected(rows, lambda r: r["offset"], guarded)


def test_rows_wait_in_chunks_and_drain_in_the_merged_order():
    p, store, rows = C.MergedFoldCells(["a", "b"]), Store(), events(3000, 200, 5)
    p.init(store)
    for i in range(0, 3000, 1000):
        assert list(p.handleInputRows((0,), iter([pd.DataFrame(rows[i:i + 1000])]), None)) == []
    assert p.waiting.calls == 3 and store.timers == sorted(store.timers, reverse=True)
    frames = []
    for ms in (700, 1500, 10_000):
        frames += list(p.handleExpiredTimer((0,), N(getCurrentWatermarkInMs=lambda ms=ms: ms), None))
        seen = pd.concat(frames)["offset"]
        arrived = {r["offset"] for r in rows if r["arrival"] <= ms * 1000 and r["marks"] != "--"}
        assert set(seen) == arrived
    assert shown(frames) == expected(rows, lambda r: (r["arrival"], r["topic_rank"], r["offset"]))
    assert not p.waiting.values and not p.index.values


def test_guard_of_a_bucket_equals_the_sequential_one():
    r = random.Random(9)
    commands = [
        dict(cmd_id=i, cell=(o := r.randrange(60)) % 3, order_id=f"o{o}", kind=r.choice(["create", "advance", "advance", "advance", "delete"]), event_type=r.choice(TYPES),
             force=r.random() < 0.1, payload_ok=r.random() < 0.9, publish_ok=r.random() < 0.9)
        for i in range(3000)
    ]
    p = C.GuardCells()
    p.init(Store())
    out = []
    for i in range(0, 3000, 1500):
        out += list(p.handleInputRows((0,), iter([pd.DataFrame(commands[i:i + 1500]).sample(frac=1, random_state=1)]), None))
    assert p.cells.calls <= 12
    got = pd.concat(out).astype(object).sort_values("cmd_id")
    assert [(a, b, c or None, d, e) for a, b, c, d, e in got[["cmd_id", "status", "sequence", "state_before", "state_after"]].itertuples(index=False)] == sequential_guard(commands)


def lane(n, seed):
    r = random.Random(seed)
    return [
        dict(topic="t.retry", partition=0, offset=i, micros=i, key=b"k", value=f"v{i}".encode(), names=["a"], texts=[b"b"], due_ms=r.randrange(1, 50) * 100 + i // 4, attempt=2)
        for i in range(n)
    ]


def release_all(p, rows, batches, moments, arrive_at=50):
    """Records by the moment they leave at; rows come in shuffled frames of 1,000, batch after batch."""
    clock = lambda ms: N(getCurrentProcessingTimeInMs=lambda: ms)
    left, frames, size = {}, [], len(rows) // batches
    for b in range(batches):
        part = rows[b * size:(b + 1) * size]
        random.Random(b).shuffle(part)
        frames += list(p.handleInputRows((0,), (pd.DataFrame(part[i:i + 1000]) for i in range(0, size, 1000)), clock(arrive_at)))
    for ms in moments:
        frames += list(p.handleExpiredTimer((0,), clock(ms), None))
    for f in frames:
        for r in f.to_dict("records"):
            assert r["offset"] not in left
            left[r["offset"]] = r
    return left, frames


def test_a_lane_leaves_in_order_and_in_bounded_pieces():
    rows, moments = lane(12_000, 4), [900, 2500, 4000, 9000]
    p, store = P.ReleaseProcessor(), Store()
    p.init(store)
    left, frames = release_all(p, list(rows), 2, moments)
    gate, expected = 0, {}
    for r in rows:
        gate = max(gate, r["due_ms"])
        expected[r["offset"]] = next(ms for ms in [50, *moments] if ms >= gate)
    assert {o: r["released_ms"] for o, r in left.items()} == expected
    assert all(left[r["offset"]]["value"] == r["value"] and left[r["offset"]]["texts"] == r["texts"] for r in rows)
    assert max(len(f) for f in frames) <= P.PIECE and not p.pieces.values
    assert p.pieces.calls < len(rows) / 50  # not a call per record
    assert store.timers and min(store.timers) > 50


def test_a_release_reads_only_the_pieces_it_touches():
    rows = lane(12_000, 4)
    p, store = P.ReleaseProcessor(), Store()
    p.init(store)
    release_all(p, list(rows), 1, [])
    before, standing = p.pieces.calls, store.timers[-1]
    # near pieces of 1,000 rows each; the first gate of a frame touches at most its own piece
    list(p.handleExpiredTimer((0,), N(getCurrentProcessingTimeInMs=lambda: standing), None))
    assert p.pieces.calls - before <= 3 * 12 and store.timers[-1] > standing


def test_a_lane_judged_at_a_moment_sets_no_timer():
    rows = lane(3000, 8)
    p, store = P.ReleaseProcessor(at_ms=2500), Store()
    p.init(store)
    left, _ = release_all(p, list(rows), 1, [])
    gate, due = 0, set()
    for r in rows:
        gate = max(gate, r["due_ms"])
        due |= {r["offset"]} if gate <= 2500 else set()
    assert set(left) == due and not store.timers
