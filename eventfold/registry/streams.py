"""Streaming runs: a written log table is streamed to its end and the output read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventfold.functions import headers as H
from eventfold.operators.services import DEFAULT_SERVICES
from eventfold.operators.services import analytics_counts as count_types
from eventfold.registry import register
from eventfold.registry.commands import commands, guarded
from eventfold.registry.failing import APPENDED, NOW_MS, failure_records, logs
from eventfold.registry.folding import two_topics
from eventfold.registry.serving import handled_rows
from eventfold.registry.sql import cte, using
from eventfold.schemas import DLQ_TOPIC, LIFECYCLE_TOPIC, RETRY_TOPIC, SNAPSHOT_TOPIC
from eventfold.session import configure, work_dir
from eventfold.sources.logs import stream_log
from eventfold.sources.order_log import fixture_handler, lifecycle_log
from eventfold.streaming import jobs as J
from eventfold.streaming.sequence import Sequencer

FILES = 8


def streamed(spark, d):
    """The log as a stream of two file batches, earlier offsets first, cut in the middle."""
    configure(spark)
    path = work_dir(spark, "log")
    log = lifecycle_log(spark, d)
    middle = (log.agg(F.max("offset")).first()[0] or 0) // 2
    for part in (log.where(F.col("offset") < middle), log.where(F.col("offset") >= middle)):
        part.repartition(FILES, "key").write.mode("append").parquet(path)
    return stream_log(spark, path, FILES)


_FOLD_STREAM = using(
    """SELECT group_id, order_id, p AS "partition", off AS "offset", s AS sequence, prev.s AS prev_sequence, redelivery, seq_gap, illegal,
    cur.s AS last_sequence, cur.st AS state, cur.e AS last_event_id, handled AS handled_count FROM g_judged""",
    "g_judged",
)


def folded(spark, stream, **how):
    out, ckpt = work_dir(spark, "folds"), work_dir(spark, "ckpt")
    J.run_once(J.fold_stream(stream, handler=fixture_handler, **how), out, ckpt)
    return spark.read.parquet(out).where("not is_tombstone").select(
        "group_id", "order_id", "partition", "offset", "sequence", "prev_sequence", "redelivery", "seq_gap", "illegal",
        "last_sequence", "state", "last_event_id", "handled_count",
    )


@register("fold_stream", _FOLD_STREAM)
def fold_stream(spark, d):
    return folded(spark, streamed(spark, d))


@register("fold_stream_two_topics", _FOLD_STREAM)
def fold_stream_two_topics(spark, d):
    """Deletes on a topic of their own, read before the events they follow; a later record moves the watermark past the end."""
    configure(spark)
    path, log = work_dir(spark, "log"), two_topics(spark, d)
    deletes = F.col("topic") == SNAPSHOT_TOPIC
    end = log.agg(F.max("timestamp").alias("timestamp")).select(
        F.lit(LIFECYCLE_TOPIC).alias("topic"), F.lit(0).alias("partition"), F.lit(-1).cast("bigint").alias("offset"),
        (F.col("timestamp") + F.expr("interval 2 days")).alias("timestamp"), F.lit(None).cast("binary").alias("key"),
        F.encode(F.lit("{}"), "UTF-8").alias("value"), F.lit(None).cast(log.schema["headers"].dataType).alias("headers"),
    )
    for part in (log.where(deletes), log.where(~deletes), end):
        part.repartition(FILES, "offset").write.mode("append").parquet(path)
    return folded(spark, stream_log(spark, path, FILES), merge_topics=(LIFECYCLE_TOPIC, SNAPSHOT_TOPIC), delay="1 day")


@register(
    "guard_stream",
    guarded("SELECT cmd_id, kind, order_id, event_type, status, sequence, state_before, state_after FROM res"),
)
def guard_stream(spark, d):
    configure(spark)
    path, out, ckpt = (work_dir(spark, n) for n in ("commands", "results", "ckpt"))
    table = commands(spark, d)
    table.write.parquet(path)
    stream = spark.readStream.schema(table.schema).parquet(path)
    J.run_once(J.guard_stream(stream), out, ckpt)
    return spark.read.parquet(out)


def failure_logs(spark, d):
    path, ckpt = work_dir(spark, "failures"), work_dir(spark, "ckpt")
    J.run_batches(streamed(spark, d), J.failure_sink(path, DEFAULT_SERVICES, fixture_handler), ckpt)
    return spark.read.parquet(path)


@register(
    "sink_failures",
    using(
        "SELECT 'order-lifecycle.' || destination AS topic, service, err AS error_class, count(*) AS n FROM routed GROUP BY ALL",
        "routed",
    ),
)
def sink_failures(spark, d):
    h = F.col("headers")
    return failure_logs(spark, d).select(
        "topic", H.header(h, H.SERVICE).alias("service"), H.header(h, H.ERROR_CLASS).alias("error_class")
    ).groupBy("topic", "service", "error_class").agg(F.count(F.lit(1)).alias("n"))


#: Appended positions are dense in each target partition, in the order of the source records.
_APPENDED = "row_number() OVER (PARTITION BY p ORDER BY off, ord) - 1"


@register(
    "sink_retry",
    using(f'SELECT p AS "partition", {_APPENDED} AS "offset", CAST(next_attempt AS VARCHAR) AS attempt FROM lane', "lane"),
)
def sink_retry(spark, d):
    return failure_logs(spark, d).where(F.col("topic") == RETRY_TOPIC).select(
        "partition", "offset", H.header(F.col("headers"), H.ATTEMPT).alias("attempt")
    )


@register(
    "sink_dlq",
    using(f'SELECT p AS "partition", {_APPENDED} AS "offset", CAST(att AS VARCHAR) AS attempts_made FROM dlq', "dlq"),
)
def sink_dlq(spark, d):
    return failure_logs(spark, d).where(F.col("topic") == DLQ_TOPIC).select(
        "partition", "offset", H.header(F.col("headers"), H.ATTEMPTS_MADE).alias("attempts_made")
    )


def released(spark, d, **how):
    """The retry topic as a stream, judged at the fixture's moment; what is due goes to the end of its log."""
    configure(spark)
    lane, out, ckpt = (work_dir(spark, n) for n in ("lane", "released", "ckpt"))
    records = failure_records(spark, d)
    records.where(F.col("topic") == RETRY_TOPIC).write.parquet(lane)
    ends = Sequencer(f"{out}-ends", lambda: logs(spark, d, records))
    J.run_batches(J.release_stream(stream_log(spark, lane), at_ms=NOW_MS, **how), J.release_sink(out, ends), ckpt)
    return spark.read.parquet(out)


_RELEASED = f"""SELECT 'order-lifecycle' AS topic, p AS "partition", {APPENDED} AS "offset", service AS retry_target,
    CAST(next_attempt AS VARCHAR) AS attempt FROM due LEFT JOIN ends ON p = ep"""


def back(records):
    h = F.col("headers")
    return records.where(F.col("topic") == LIFECYCLE_TOPIC).select(
        "topic", "partition", "offset", H.header(h, H.RETRY_TARGET).alias("retry_target"), H.header(h, H.ATTEMPT).alias("attempt")
    )


@register("sink_source", using(_RELEASED, "due", "ends"))
def sink_source(spark, d):
    return back(released(spark, d))


cte(
    "due_tiered",
    f"""SELECT * FROM (SELECT *, max(greatest(due_ms, failed_ms)) OVER (PARTITION BY p, next_attempt ORDER BY pos) AS release_ms FROM lane)
    WHERE release_ms <= {NOW_MS}""",
    "lane",
)


@register("release_tiered_stream", using(_RELEASED.replace("FROM due ", "FROM due_tiered "), "due_tiered", "ends"))
def release_tiered_stream(spark, d):
    """The same with a lane for each attempt."""
    return back(released(spark, d, tiered=True))


@register(
    "analytics_stream",
    using(
        "SELECT ty AS event_type, count(*) AS n FROM dlv WHERE service = 'analytics' AND NOT stone AND err IS NULL GROUP BY 1",
        "dlv",
    ),
)
def analytics_stream(spark, d):
    """The tally as a stream; each batch replaces the written totals."""
    out, ckpt = work_dir(spark, "tally"), work_dir(spark, "ckpt")
    counts = count_types(handled_rows(streamed(spark, d)))
    counts.writeStream.outputMode("complete").foreachBatch(
        lambda batch, _: batch.write.mode("overwrite").parquet(out)
    ).option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
