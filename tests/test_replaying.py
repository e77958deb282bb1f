"""Replay runs: fixed bounds, repeated runs, dry runs, dead letters that arrive meanwhile."""

import json

import pytest

from eventfold.functions import headers as H
from eventfold.operators import replaying as R
from eventfold.schemas import LOG_SCHEMA
from eventfold.sources.offsets import log_bounds
from eventfold.streaming.sequence import Sequencer
from helpers import log_of, record


def letter(i, service="inventory", error="RetryableError", topic="order-lifecycle", partition=0):
    headers = [(H.SERVICE, service.encode()), (H.ERROR_CLASS, error.encode())] + ([(H.ORIGINAL_TOPIC, topic.encode())] if topic else [])
    return record(i, json.dumps({"n": i}).encode(), key=b"o%d" % (i % 3), topic="order-lifecycle.dlq", partition=partition, headers=headers)


@pytest.fixture
def runs(spark, tmp_path):
    """Builds runs over a dead-letter table that can grow, and an output log."""
    path, ledger, out = (str(tmp_path / n) for n in ("dead", "ledger", "out"))

    def add(rows):
        log_of(spark, rows).coalesce(1).write.mode("append").parquet(path)

    source = log_of(spark, [record(i, b"x", partition=p) for p in range(3) for i in range(4)])

    def make(number, **how):
        return R.ReplayRun(number, lambda: spark.read.schema(LOG_SCHEMA).parquet(path), ledger, 3, **how)

    return add, make, lambda: Sequencer(f"{out}-ends", lambda: source), ledger, out


def totals(df):
    r = df.first()
    return (r.read, r.matched, r.excluded, r.skipped, r.published)


FIRST = [letter(0), letter(1, error="NonRetryableError"), letter(2, service="analytics"), letter(3, topic=None), letter(0, partition=1)]


def test_dry_run_counts_and_writes_nothing(runs, tmp_path):
    add, make, _, ledger, out = runs
    add(FIRST)
    assert totals(make(0).dry()) == (5, 5, 1, 1, 0)
    assert totals(make(0, service="analytics", include_poison=True).dry()) == (5, 1, 0, 0, 0)
    assert totals(make(0, limit=2).dry()) == (5, 2, 1, 0, 0)
    assert not (tmp_path / "ledger").exists() and not (tmp_path / "out").exists()


def test_what_arrives_meanwhile_is_left_to_the_next_run(spark, runs):
    add, make, ends, ledger, out = runs
    add(FIRST)
    run = make(0)
    run.bounds(keep=True)
    add([letter(4), letter(5, partition=2)])  # provoked while the run is under way
    assert totals(run.publish(out, ends())) == (5, 5, 1, 1, 3)
    assert R.sent(spark, ledger, 0).count() == 3 and R.published(spark, out, ledger).count() == 3
    assert totals(run.publish(out, ends())) == (5, 5, 1, 1, 3)  # again under its number: nothing more
    assert R.published(spark, out, ledger).count() == 3
    assert totals(make(1).publish(out, ends())) == (7, 7, 1, 1, 5)
    everything = R.published(spark, out, ledger)
    assert everything.count() == 8 == everything.select("topic", "partition", "offset").distinct().count()
    assert everything.where("headers is not null").count() == 0
    assert {r.low for r in log_bounds(everything).collect()} == {4}  # behind the log's end
    assert everything.select("key", "partition").distinct().count() == 3  # one partition per key


def test_a_broken_run_is_finished_without_repeats(spark, runs, monkeypatch):
    add, make, ends, ledger, out = runs
    add(FIRST)
    with monkeypatch.context() as m:
        m.setattr(R.ReplayRun, "_summary", lambda *a: 1 / 0)  # all is written but the commit
        with pytest.raises(ZeroDivisionError):
            make(0).publish(out, ends())
    assert R.sent(spark, ledger, 0).count() == 0
    add([letter(9)])
    assert totals(make(0).publish(out, ends())) == (5, 5, 1, 1, 3)
    rows = R.published(spark, out, ledger)
    assert rows.count() == 3 == rows.select("topic", "partition", "offset").distinct().count()
