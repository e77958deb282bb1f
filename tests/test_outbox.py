"""Several logs in one batch: a failure between the writes leaves all or nothing to read."""

import pytest
from pyspark.sql import functions as F

from eventfold.sources import outbox as B
from eventfold.sources.sinks import write_batch


def logs(spark, n):
    return {"events": spark.range(n).toDF("id"), "snapshots": spark.range(n // 2).toDF("id")}


def seen(box):
    return [sorted(r.id for r in box.read(name, "id bigint").collect()) for name in ("events", "snapshots")]


@pytest.mark.parametrize("fails_at", ["snapshots", "commits"])
def test_a_broken_batch_is_not_read_and_can_be_finished(spark, tmp_path, monkeypatch, fails_at):
    box = B.Outbox(spark, str(tmp_path))
    assert box.publish(0, logs(spark, 4)).count() == 2
    with monkeypatch.context() as m:

        def broken(rows, path, batch_id):
            if path.endswith(fails_at):
                raise OSError("lost")
            write_batch(rows, path, batch_id)

        m.setattr(B, "write_batch", broken)
        with pytest.raises(OSError):
            box.publish(1, logs(spark, 8))
    assert seen(box) == [[0, 1, 2, 3], [0, 1]]
    box.publish(1, logs(spark, 6))
    assert seen(box) == [sorted([*range(4), *range(6)]), sorted([*range(2), *range(3)])]


def test_a_committed_batch_is_left_as_it_is(spark, tmp_path):
    box = B.Outbox(spark, str(tmp_path))
    box.publish(0, logs(spark, 4))
    again = box.publish(0, logs(spark, 100)).collect()
    assert sorted((r.log, r.n, r.batch) for r in again) == [("events", 4, 0), ("snapshots", 2, 0)]
    assert seen(box) == [[0, 1, 2, 3], [0, 1]]


def test_committed_batch_is_not_worked_out_again(spark, tmp_path):
    """A repeat of a committed run of the guard reads its commit records and none of its inputs."""
    from eventfold.operators.publishing import publish_results

    box = B.Outbox(spark, str(tmp_path / "box"))
    first = box.publish(3, {"a": spark.range(2)})
    broken = spark.range(1).select(F.raise_error(F.lit("worked out again")).alias("cmd_id"))
    again = publish_results(box, 3, broken, broken, broken, 3)
    assert sorted(again.collect()) == sorted(first.collect()) and box.batch(4) is None


def test_only_payloads_with_rules_are_parsed(spark):
    """Steps without rules take any text; the others are parsed once in the plan."""
    from eventfold.operators.commands import check_advances

    rows = [(1, "advance", "PACKED", "no json"), (2, "advance", "SHIPPED", "no json"), (3, "create", None, "no json"), (4, "advance", "SHIPPED", '{"carrier":"c","tracking_number":"t"}'), (5, "advance", "SHIPPED", None)]
    made = spark.createDataFrame(rows, "cmd_id int, kind string, event_type string, payload string").selectExpr("*", "kind = 'create' AS payload_ok", "CAST(NULL AS string) AS payload_reason")
    out = check_advances(made)
    missing = "carrier, tracking_number are empty"
    assert {r.cmd_id: (r.payload_ok, r.payload_reason) for r in out.collect()} == {1: (True, None), 2: (False, missing), 3: (True, None), 4: (True, None), 5: (False, missing)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parse_json") <= 3
