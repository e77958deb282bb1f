"""Release from the retry lane: nothing early, nothing lost, positions after the log's end."""

import datetime as dt

from pyspark.sql import functions as F

from eventfold.functions import headers as H
from eventfold.operators import retry as R
from eventfold.plans.scan import numbered
from eventfold.registry import failing
from eventfold.schemas import LOG_COLUMNS, RETRY_TOPIC
from eventfold.session import written
from eventfold.sources.logs import stream_log
from eventfold.streaming import jobs as J
from eventfold.streaming.sequence import Sequencer

SF = "/root/testdata/sf0.001"


def test_released_and_waiting_make_the_lane(spark):
    lane = written(failing.damaged_lane(spark, SF), "lane")
    log = written(failing.logs(spark, SF), "logs")
    back, waiting = R.release_due(lane, log, failing.now(), block_rows=64)
    back, waiting = back.collect(), waiting.collect()
    assert len(back) + len(waiting) == lane.count() and back and waiting
    taken = {(r.topic, r.partition, r.offset) for r in log.where(F.col("topic") != RETRY_TOPIC).collect()}
    placed = [(r.topic, r.partition, r.offset) for r in back]
    assert len(set(placed)) == len(placed) and not taken & set(placed)
    ends = {}
    for t, p, o in taken:
        ends[t, p] = max(ends.get((t, p), 0), o + 1)
    for t, p in {(t, p) for t, p, _ in placed}:
        assert sorted(o for a, b, o in placed if (a, b) == (t, p)) == list(range(ends.get((t, p), 0), ends.get((t, p), 0) + sum((a, b) == (t, p) for a, b, _ in placed)))


def test_far_future_waits_in_the_stream(spark, tmp_path):
    lane = failing.retry_lane(spark, SF).select(*LOG_COLUMNS)
    late = F.array(F.struct(F.lit(H.RETRY_AT).alias("key"), F.encode(F.lit("2099-01-01T00:00:00Z"), "UTF-8").alias("value")))
    kept = F.filter("headers", lambda h: h["key"] != H.RETRY_AT)
    lane = written(lane.withColumn("headers", F.when(F.col("partition") == 1, F.concat(kept, late)).otherwise(F.col("headers"))), "lane")
    log, path = written(failing.logs(spark, SF), "logs"), str(tmp_path / "lane")
    middle = lane.agg(F.max("offset")).first()[0] // 2
    for part in (lane.where(F.col("offset") < middle), lane.where(F.col("offset") >= middle)):
        part.coalesce(1).write.mode("append").parquet(path)
    sink = J.release_sink(f"{tmp_path}/out", Sequencer(f"{tmp_path}/ends", lambda: log))

    def twice(batch, batch_id):
        rows = written(batch, "batch")
        sink(rows, batch_id)
        sink(rows, batch_id)  # as after a failure

    moment = int(dt.datetime(2026, 2, 1, tzinfo=dt.timezone.utc).timestamp() * 1000)
    J.run_batches(J.release_stream(stream_log(spark, path, 1), at_ms=moment), twice, str(tmp_path / "ckpt"))
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    held = lane.where("partition = 1").count()
    assert held > 0 and len(out) == lane.count() - held
    assert not [r for r in out if r.topic == "order-lifecycle" and r.partition == 1]
    places = {(r.topic, r.partition, r.offset) for r in out}
    assert len(places) == len(out)
    assert not places & {(r.topic, r.partition, r.offset) for r in log.collect()}


def test_numbered_is_dense(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.expr("id div 100").alias("cell"), "id")
    got = numbered(rows, ["k"], ["cell"], ["id"]).collect()
    for k in range(3):
        assert [r.rank for r in sorted((r for r in got if r.k == k), key=lambda r: r.id)] == list(range(sum(r.k == k for r in got)))
