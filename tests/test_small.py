"""Running aggregates, headers, texts, positions, retry timing and option checks."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from eventfold.functions import headers as H
from eventfold.functions import text as X
from eventfold.operators import changelog as C
from eventfold.operators import deadletters as DL
from eventfold.operators import failures as FL
from eventfold.operators import retry as R
from eventfold.plans.scan import running
from eventfold.sources import logs as L
from eventfold.sources import offsets as P
from helpers import T0, event_bytes, log_of, record


def test_running_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.choice([None, rng.randrange(100)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    got = running(df, ["k"], "i", {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("min", F.col("v"))}, 13)
    seen = {(r.k, r.i): (r.s, r.m, r.l) for r in got.collect()}
    for key in "ab":
        past = []
        for k, i, v in rows:
            if k == key:
                past += [] if v is None else [v]
                assert seen[k, i] == ((sum(past), max(past), min(past)) if past else (None, None, None))


def test_headers(spark):
    given = [("a", b"1"), ("b", None), ("a", b"2"), ("c", b"\xff"), ("a", b"\xff")]
    log = log_of(spark, [record(0, b"x", headers=given), record(1, b"x")])
    got = log.select(
        H.decode_headers(F.col("headers")).alias("m"), H.header(F.col("headers"), "a").alias("a")
    ).collect()
    assert [(r.m, r.a) for r in got] == [({"a": "2"}, "2"), ({}, None)]


@pytest.mark.parametrize(
    "text,attempt,plain", [("3", 3, 3), (" 4 ", 4, 4), ("0", 1, 0), ("-2", 1, -2), ("x", 1, 2), (None, 1, 2), ("1_0", 10, 10), ("2.0", 1, 2)]
)
def test_attempts(spark, text, attempt, plain):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(H.attempt_of(F.col("t")), H.int_header(F.col("t"), 2)).first()[:] == (attempt, plain)


def test_due_times(spark):
    texts = ["2026-01-01T00:00:30+00:00", "2026-01-01T00:00:30", "soon", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(F.unix_millis(H.due_time(F.col("t")))).collect()]
    assert got == [1767225630000, 1767225630000, None, None]


def test_origin_falls_back_to_the_record(spark):
    rows = [record(7, b"x", headers=[(H.ORIGINAL_TOPIC, b"src"), (H.ORIGINAL_OFFSET, b"3")]), record(8, b"x")]
    got = R.with_retry_fields(log_of(spark, rows)).select("origin").collect()
    assert got[0].origin[:] == ("src", -1, 3, "unknown")
    assert got[1].origin.topic == "order-lifecycle" and got[1].origin.offset == 8


def test_texts(spark):
    df = spark.createDataFrame([(b"k",), (None,), (b"\xff",)], "k binary")
    assert [r[0] for r in df.select(X.key_text(F.col("k"))).collect()] == ["k", "<null>", "<undecodable-key>"]
    with pytest.raises(Exception, match="without a readable key"):
        df.select(X.strict_key_text(F.col("k"))).collect()
    errors = spark.createDataFrame([(" a\nb\t",), ("",), ("x" * 501,)], "e string")
    assert [r[0] for r in errors.select(X.describe_error(F.col("e"))).collect()] == ["a b", "<no message>", "x" * 500 + "…"]


@pytest.mark.parametrize("waits,attempt,seconds", [((30, 120), 1, 0), ((30, 120), 2, 30), ((30, 120), 3, 120), ((30, 120), 9, 120), ((), 2, 30)])
def test_backoff(spark, waits, attempt, seconds):
    policy = FL.RetryPolicy(backoff_seconds=waits)
    assert spark.range(1).select(FL.backoff(F.lit(attempt), policy)).first()[0] == seconds


def test_head_of_line_blocking_equals_a_loop(spark):
    rng, rows = random.Random(3), []
    for i in range(200):
        due = f"2026-01-01T00:0{rng.randrange(6)}:00+00:00".encode() if rng.random() > 0.2 else b"soon"
        rows.append(record(i * 5, b"x", partition=i % 2, headers=[(H.RETRY_AT, due), (H.ATTEMPT, b"2")]))
    lane = R.with_retry_fields(log_of(spark, rows))
    got = {r.offset: r for r in R.due_gate_hol(lane, F.lit("2026-01-01 00:02:00").cast("timestamp"), 64).collect()}
    clock = {0: None, 1: None}
    for r in sorted(lane.collect(), key=lambda r: r.offset):
        ready = max(r.due_at or r.timestamp, r.timestamp)
        clock[r.partition] = max(clock[r.partition] or ready, ready)
        assert got[r.offset].release_at == clock[r.partition]


def test_key_partition_is_crc32(spark):
    keys = [b"ord-1", b"ord-2", "ordé".encode()]
    df = spark.createDataFrame([(k,) for k in keys], "k binary")
    assert [r[0] for r in df.select(P.key_partition(F.col("k"), 3)).collect()] == [zlib.crc32(k) % 3 for k in keys]


def test_replay_keeps_limit_over_matched(spark):
    def letter(i, error, topic=b"order-lifecycle"):
        heads = [(H.SERVICE, b"inventory"), (H.ERROR_CLASS, error)] + ([(H.ORIGINAL_TOPIC, topic)] if topic else [])
        return record(i, b"v", topic="order-lifecycle.dlq", headers=heads)

    dlq = log_of(spark, [letter(0, b"NonRetryableError"), letter(1, b"RetryableError", None), letter(2, b"RetryableError"), letter(3, b"X")])
    assert [r.offset for r in DL.replay(dlq).orderBy("offset").collect()] == [2, 3]
    assert [r.offset for r in DL.replay(dlq, limit=3).collect()] == [2]
    assert DL.replay(dlq, include_poison=True).count() == 3
    assert DL.counts(dlq, "inventory").first()[:] == (4, 4, 1)


def test_checkpoint_rebuild_is_refused_under_exactly_once():
    C.check_rebuild("exactly_once", "full")
    C.check_rebuild("at_least_once", "checkpoint")
    with pytest.raises(ValueError, match="cannot be combined"):
        C.check_rebuild("exactly_once", "checkpoint")


def test_rebuild_clears_a_partition_with_nothing_alive(spark, tmp_path):
    old = log_of(spark, [record(0, b"v", b"k", 0), record(0, b"w", b"j", 1)])
    C.write_state(C.compact_latest(old), str(tmp_path / "s"))
    log = old.unionByName(log_of(spark, [record(1, None, b"k", 0)]))
    left = C.rebuild_partitions(log, str(tmp_path / "s"), [("order-lifecycle", 0)])
    assert [r.key for r in left.collect()] == [b"j"]


def test_null_keys_are_kept_apart(spark):
    log = log_of(spark, [record(0, b"v", None), record(1, b"v", b"k"), record(2, b"w", b"k")])
    assert [r.offset for r in C.compact_latest(log).collect()] == [2]
    assert [r.offset for r in C.null_keys(log).collect()] == [0]


def test_kafka_options():
    o = L.kafka_options("b:9092", ["a", "s"], starting={"a": {0: 5}}, ending={"a": {0: 9}}, max_per_trigger=100)
    assert o["subscribe"] == "a,s" and o["startingOffsets"] == '{"a": {"0": 5}}' and o["endingOffsets"] == '{"a": {"0": 9}}'
    assert o["kafka.isolation.level"] == "read_committed" and o["maxOffsetsPerTrigger"] == "100"
    assert L.kafka_options("b", [], assign={"a": [0, 1]})["assign"] == '{"a": [0, 1]}'


def test_key_on_two_partitions_is_reported(spark):
    from eventfold.operators.observe import key_mismatches, keys_on_many_partitions
    from eventfold.operators.decode import parse_event

    log = log_of(spark, [record(0, event_bytes("k", 1, "ORDER_CREATED"), b"k", 0), record(1, event_bytes("z", 2, "PACKED"), b"k", 2)])
    assert [r.key_text for r in keys_on_many_partitions(log).collect()] == ["k"]
    assert [r.order_id for r in key_mismatches(parse_event(log)).collect()] == ["z"]


def test_unknown_settings_are_refused(spark):
    with pytest.raises(ValueError):
        FL.fail_lever("sometimes", F.lit("o"), F.lit(1), F.lit(1))
    log = log_of(spark, [record(0, b"v")])
    with pytest.raises(ValueError):
        P.reset_offsets(P.log_bounds(log), log, to="nowhere")
    assert T0.year == 2026
