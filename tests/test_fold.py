"""The fold against a sequential model, with and without cutting orders into blocks."""

import random

import pytest
from pyspark.sql import functions as F

from eventfold.operators import fold as O
from eventfold.operators.services import ServiceSpec
from helpers import TYPES, event_bytes, log_of, record, sequential_fold

ONE = (ServiceSpec("inventory", TYPES),)


def random_rows(seed, orders, n):
    rng, rows = random.Random(seed), []
    for offset in range(n):
        order = "big" if rng.random() < 0.5 else f"o{rng.randrange(orders)}"
        kind = "tombstone" if rng.random() < 0.04 else "event"
        seq = rng.randrange(1, 30) if order == "big" else rng.randrange(1, 6)
        rows.append(
            dict(order_id=order, offset=offset, kind=kind, sequence=seq, event_type=rng.choice(TYPES),
                 event_id=f"e{offset}", ok=rng.random() > 0.15)
        )
    return rows


def to_log(spark, rows):
    return log_of(
        spark,
        [
            record(
                r["offset"],
                None if r["kind"] == "tombstone" else event_bytes(r["order_id"], r["sequence"], r["event_type"], r["event_id"]),
                r["order_id"].encode(),
                headers=None if r["ok"] else [("fail", b"1")],
            )
            for r in rows
        ],
    )


def run(spark, rows, mode, block_rows, resets=()):
    failing = [r["event_id"] for r in rows if not r["ok"]]

    def handler(df):
        bad = F.col("event_id").isin(failing)
        return df.withColumn("error_class", F.when(bad, "RetryableError")).withColumn("error_message", F.lit("x"))

    got = O.deliveries(to_log(spark, rows), ONE, handler, block_rows=block_rows)
    hist = O.history(got, mode, resets=resets).cache()
    seen = [
        (r.offset, None, r.redelivery, r.seq_gap, r.illegal,
         (r.cur.sequence, r.cur.state, r.cur.event_id, r.handled) if r.cur else None)
        for r in O.judge(hist).collect()
    ] + [(r.offset, r.deleted, None, None, None, None) for r in O.tombstones(hist).collect()]
    folds = {r.order_id: (r.last_sequence, r.state, r.last_event_id, r.handled_count) for r in O.final_folds(hist).collect()}
    hist.unpersist()
    return sorted(seen, key=lambda x: x[0]), folds


@pytest.mark.parametrize("mode", [O.GUARDED, O.LAST_WRITE])
@pytest.mark.parametrize("block_rows", [1 << 20, 40, 7])
def test_fold_equals_sequential_model(spark, mode, block_rows):
    rows = random_rows(block_rows, 12, 600)
    want, folds = sequential_fold(rows, mode == O.GUARDED)
    got, got_folds = run(spark, rows, mode, block_rows)
    assert got == want
    assert got_folds == folds


@pytest.mark.parametrize("block_rows", [1 << 20, 16])
def test_reset_forgets_the_partition(spark, block_rows):
    rows = random_rows(5, 8, 300)
    marks = [100, 220]
    resets = [O.Reset("inventory-service", "order-lifecycle", 0, m) for m in marks]
    want, folds = sequential_fold(rows, False, marks)
    got, got_folds = run(spark, rows, O.LAST_WRITE, block_rows, resets)
    assert got == want
    assert got_folds == folds


def test_hot_orders_are_found_by_decoded_id_and_cut_by_rows(spark):
    """Null keys and a first record from the far future: neither hides the order nor pins its blocks."""
    log = to_log(spark, random_rows(9, 20, 800)).where("value is not null")
    log = log.withColumn("key", F.lit(None).cast("binary")).withColumn(
        "timestamp", F.when(F.col("offset") == 0, F.timestamp_seconds(F.lit(4_000_000_000))).otherwise(F.col("timestamp"))
    )
    for topics in ((), ("order-lifecycle",)):
        got = O.deliveries(log, ONE, block_rows=50, merge_topics=topics)
        assert {r[0] for r in got.hot.select("order_id").distinct().collect()} == {"big"}
        sizes = [r["count"] for r in got.hot.groupBy("block").count().collect()]
        assert len(sizes) > 4 and max(sizes) < 150
    assert O.deliveries(log, ONE, block_rows=10_000).hot is None


def steps(spark, *rows):
    log = log_of(spark, [record(i, event_bytes("o", s, t, f"e{i}"), b"o") for i, (s, t) in enumerate(rows)])
    return O.history(O.deliveries(log, ONE, find_hot=False))


def test_forced_step_is_illegal_without_a_gap(spark):
    hist = steps(spark, (1, "ORDER_CREATED"), (2, "DELIVERED"))
    v = O.violations(O.judge(hist)).collect()
    assert [(r.type, r.expected, r.observed) for r in v] == [("ILLEGAL_TRANSITION", "PACKED", "DELIVERED after CREATED")]


def test_lost_memory_reports_a_gap(spark):
    log = log_of(
        spark, [record(i, event_bytes("o", i + 1, t, f"e{i}"), b"o") for i, t in enumerate(TYPES[:3])]
    )
    got = O.deliveries(log, ONE, find_hot=False)
    hist = O.history(got, O.LAST_WRITE, resets=[O.Reset("inventory-service", "order-lifecycle", 0, 2)])
    v = O.violations(O.judge(hist)).where("type = 'SEQUENCE_GAP'").collect()
    assert [(r.expected, r.observed) for r in v] == [("1", "3")]


def test_completed_order_expects_nothing(spark):
    hist = steps(spark, *[(i + 1, t) for i, t in enumerate(TYPES)], (5, "PACKED"))
    v = O.violations(O.judge(hist)).collect()
    assert [(r.expected, r.observed) for r in v] == [("nothing (lifecycle complete)", "PACKED after DELIVERED")]


def test_null_key_tombstone_deletes_the_placeholder_order(spark):
    log = log_of(spark, [record(0, event_bytes("<null>", 1, "ORDER_CREATED"), None), record(1, None, None)])
    hist = O.history(O.deliveries(log, ONE, find_hot=False))
    assert [(r.order_id, r.deleted) for r in O.tombstones(hist).collect()] == [("<null>", True)]


def test_bad_stored_fold_stops_the_job(spark):
    df = spark.createDataFrame([('{"last_sequence":1,"state":"LOST","last_event_id":"e","handled_count":1}',)], "v string")
    with pytest.raises(Exception, match="undecodable stored fold"):
        df.select(O.decode_fold(F.col("v")).alias("f")).collect()


@pytest.mark.parametrize("block_rows", [1 << 20, 16])
def test_deletes_on_their_own_topic_keep_their_place(spark, block_rows):
    """Record i arrives at millisecond i, so the merged order is the order of the rows."""
    rows = random_rows(33, 8, 300)
    _, folds = sequential_fold([{**r, "ok": True} for r in rows])
    gone = F.col("value").isNull()
    log = to_log(spark, rows).withColumn("topic", F.when(gone, "order-snapshot").otherwise(F.col("topic"))).withColumn(
        "offset", F.when(gone, F.col("offset") * 9).otherwise(F.col("offset"))
    )
    got = O.deliveries(
        log, ONE, block_rows=block_rows, merge_topics=("order-lifecycle", "order-snapshot")
    )
    final = O.final_folds(O.history(got, order=O.MERGED)).collect()
    assert {r.order_id: (r.last_sequence, r.state, r.last_event_id, r.handled_count) for r in final} == folds


def test_events_without_a_handler_succeed(spark):
    """Inventory has no handler for PACKED, so a handler that always fails cannot fail there."""
    log = log_of(spark, [record(i, event_bytes("o", i + 1, t, f"e{i}"), b"o") for i, t in enumerate(TYPES)])

    def failing(df):
        return df.withColumn("error_class", F.lit("RetryableError")).withColumn("error_message", F.lit("x"))

    got = O.deliveries(log, (ServiceSpec("inventory", ("ORDER_CREATED", "SHIPPED")),), failing, find_hot=False).cold
    assert {r.event_type: r.handler_ok for r in got.collect()} == {t: t in ("PACKED", "DELIVERED") for t in TYPES}
