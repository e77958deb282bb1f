"""Streams against the batch operators, across a restart, and timers."""

import datetime as dt
import glob
import json
import time

from pyspark.sql import functions as F

from eventfold.functions import headers as H
from eventfold.operators import fold as O
from eventfold.operators.services import ServiceSpec
from eventfold.sources.logs import stream_log
from eventfold.sources.sinks import table_sink
from eventfold.streaming import jobs as J
from eventfold.streaming import processors as P
from eventfold.schemas import LOG_SCHEMA
from eventfold.streaming.sequence import Sequencer
from helpers import TYPES, log_of, record
from test_fold import random_rows, to_log

ONE = (ServiceSpec("inventory", TYPES),)


def test_restarted_stream_equals_batch(spark, tmp_path):
    rows = random_rows(21, 10, 240)
    failing = [r["event_id"] for r in rows if not r["ok"]]

    def handler(df):
        return df.withColumn("error_class", F.when(F.col("event_id").isin(failing), "RetryableError")).withColumn(
            "error_message", F.lit("x")
        )

    path, out, ckpt = (str(tmp_path / n) for n in ("log", "out", "ckpt"))
    for start in range(0, 240, 80):
        to_log(spark, rows[start:start + 80]).coalesce(1).write.mode("append").parquet(path)
        J.run_once(J.fold_stream(stream_log(spark, path), ONE, handler), out, ckpt)
    streamed = {
        r.offset: (r.redelivery, r.seq_gap, r.illegal, r.last_sequence, r.state, r.handled_count)
        for r in spark.read.parquet(out).where("not is_tombstone").collect()
    }
    hist = O.history(O.deliveries(to_log(spark, rows), ONE, handler, find_hot=False))
    batch = {
        r.offset: (r.redelivery, r.seq_gap, r.illegal, r.cur.sequence if r.cur else None, r.cur.state if r.cur else None, r.handled)
        for r in O.judge(hist).collect()
    }
    assert streamed == batch


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    write = table_sink(str(tmp_path), lambda b: {"even": b.where("id % 2 = 0"), "odd": b.where("id % 2 = 1")})
    for batch_id in (0, 1, 1):
        write(spark.range(10), batch_id)
    assert spark.read.parquet(str(tmp_path / "even")).count() == 10
    assert spark.read.parquet(str(tmp_path / "odd")).count() == 10


def lane_record(i, due, partition=0, attempt=2, service="inventory", value=None):
    headers = [
        (H.RETRY_AT, due.isoformat().encode()), (H.ATTEMPT, str(attempt).encode()), (H.SERVICE, service.encode()),
        (H.ORIGINAL_TOPIC, b"order-lifecycle"), (H.ORIGINAL_PARTITION, str(partition).encode()), (H.ORIGINAL_OFFSET, str(i).encode()),
    ]
    body = value or json.dumps({"event_id": f"e{i}", "order_id": "o1", "sequence": 1, "event_type": "PACKED", "payload": {}}).encode()
    return record(i, body, topic="order-lifecycle.retry", partition=partition, headers=headers)


def released_while(spark, out, n, seconds=90):
    stop_at, seen = time.time() + seconds, []
    while time.time() < stop_at and len(seen) < n:
        time.sleep(1)
        if glob.glob(f"{out}/batch=*/_SUCCESS"):
            seen = spark.read.schema(f"{LOG_SCHEMA}, batch int").parquet(out).collect()
    return seen


def test_waiting_records_leave_without_new_ones(spark, tmp_path):
    """Due times lie ahead, nothing new arrives: timers release all, in the lane's order, at dense positions."""
    now = dt.datetime.now(dt.timezone.utc)
    at = lambda s: now + dt.timedelta(seconds=s)
    rows = [lane_record(i, at(s)) for i, s in enumerate([-5, 12, 8, -5])] + [lane_record(i, at(s), partition=1) for i, s in enumerate([10, -5, 11])]
    rows.append(lane_record(3, at(-5), partition=1, service="nobody"))
    lane, out, ckpt = (str(tmp_path / n) for n in ("lane", "out", "ckpt"))
    log_of(spark, rows).coalesce(1).write.parquet(lane)
    reads = []

    def log():
        reads.append(1)
        return log_of(spark, [record(i, b"x", partition=p) for p in (0, 1) for i in range(10 * (p + 1))])

    write = J.release_sink(out, Sequencer(f"{out}-ends", log))
    query = J.release_stream(stream_log(spark, lane)).writeStream.foreachBatch(write).option("checkpointLocation", ckpt).trigger(processingTime="1 second").start()
    seen = released_while(spark, out, 8)
    query.stop()
    assert len(reads) == 1
    back = sorted((r.partition, r.offset, dict((h.key, bytes(h.value).decode()) for h in r.headers)[H.ORIGINAL_OFFSET]) for r in seen if r.topic == "order-lifecycle")
    assert back == [(0, 10, "0"), (0, 11, "1"), (0, 12, "2"), (0, 13, "3"), (1, 20, "0"), (1, 21, "1"), (1, 22, "2")]
    assert [(r.topic, r.partition, r.offset) for r in seen if r.topic != "order-lifecycle"] == [("order-lifecycle.dlq", 1, 0)]
    by = {(r.partition, r.offset): r.batch for r in seen if r.topic == "order-lifecycle"}
    assert by[(0, 10)] < by[(0, 11)] and by[(0, 11)] <= by[(0, 13)]  # one was due at once, the rest stood behind a later one


def test_sequencer_repeats_and_interleaves(spark, tmp_path):
    log = log_of(spark, [record(i, b"x") for i in range(5)])
    rows = spark.createDataFrame([("order-lifecycle", 0, i, 0) for i in range(3)] + [("new", 2, 0, 0)], "topic string, partition int, n int, cell int")
    for writer in (0, 1):
        s = Sequencer(str(tmp_path / str(writer)), lambda: log, writer, 2)
        place = lambda b, s=s: sorted((r.topic, r.n, r.offset) for r in s.place(rows, ["cell"], ["n"], b).collect())
        first = place(0)
        assert first == [("new", 0, writer), *[("order-lifecycle", i, 5 + writer + 2 * i) for i in range(3)]]
        second = place(1)
        assert second == [("new", 0, writer + 2), *[("order-lifecycle", i, 11 + writer + 2 * i) for i in range(3)]]
        assert place(1) == second  # a repeated batch
        again = Sequencer(str(tmp_path / str(writer)), None, writer, 2)  # a restarted job reads no log
        assert sorted((r.topic, r.n, r.offset) for r in again.place(rows, ["cell"], ["n"], 2).collect())[1][2] == 17 + writer


class Stub:
    """A state variable and handle in memory that counts the calls."""

    def __init__(self):
        self.value, self.items, self.timers, self.calls = None, [], [], []

    def getValueState(self, *_):
        return self

    getListState = getValueState

    def get(self):
        self.calls.append("get")
        return iter(list(self.items)) if self.items else self.value

    def update(self, value):
        self.calls.append("update")
        self.value = ({g: dict(zip(P._FOLD_FIELDS, v)) for g, v in value[0].items()},)

    def appendList(self, rows):
        self.calls.append("append")
        self.items += rows

    def put(self, rows):
        self.items = rows

    def clear(self):
        self.items = []

    def registerTimer(self, at):
        self.timers.append(at)


def test_rows_of_an_order_are_one_append_and_one_timer():
    """Every call is a trip to the JVM: they follow the orders of a batch and not its rows."""
    from types import SimpleNamespace as N

    p, waiting, store = P.MergedFoldProcessor(), Stub(), Stub()
    p.handle, p.waiting, p.store = waiting, waiting, store
    rows = [
        N(arrival=1000 * i, topic_rank=1, partition=0, offset=i, is_tombstone=False, sequence=i, event_type=TYPES[i - 1], event_id=f"e{i}", seen=[{"group_id": "g", "handler_ok": True}])
        for i in (3, 1, 2)
    ]
    assert list(p.handleInputRows(("o",), iter(rows), None)) == []
    assert waiting.calls == ["append"] and waiting.timers == [1]
    at = lambda ms: N(getCurrentWatermarkInMs=lambda: ms)
    assert [r.offset for r in p.handleExpiredTimer(("o",), at(2), None)] == [1, 2]
    assert waiting.timers == [1, 3] and len(waiting.items) == 1
    assert [(r.offset, r.prev_sequence, r.handled_count) for r in p.handleExpiredTimer(("o",), at(3), None)] == [(3, 2, 3)]
    assert not waiting.items and store.calls == ["get", "update", "get", "update"]
