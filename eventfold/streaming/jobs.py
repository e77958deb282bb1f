"""Structured Streaming jobs over log streams. Decode and handlers are the batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.functions import text as X
from eventfold.lifecycle import ORDER_LIFECYCLE, Lifecycle
from eventfold.operators.commands import check_advances
from eventfold.operators.decode import parse_event
from eventfold.operators.failures import (
    RetryPolicy,
    failed_deliveries,
    route_failures,
    to_failure_logs,
)
from eventfold.operators.retry import as_log, give_up, judge_due, release, with_retry_fields
from eventfold.operators.routing import branch, with_delivery
from eventfold.operators.services import DEFAULT_SERVICES, Handler, ServiceSpec, apply_handler
from eventfold.plans.hot import BLOCK_ROWS, int_div
from eventfold.schemas import LOG_COLUMNS, SNAPSHOT_TOPIC
from eventfold.session import written
from eventfold.sources.sinks import write_batch
from eventfold.streaming import cells as C
from eventfold.streaming import processors as P
from eventfold.streaming.sequence import Sequencer


def seen_by(rows: DataFrame, services: Sequence[ServiceSpec], handler: Handler | None) -> DataFrame:
    """Add ``marks``: a character per service, whether it takes a record and its handler succeeds. Narrow.

    The handler runs once per service on the undivided row, so it must not change columns
    other than the two it adds.
    """
    out, each = rows, []
    for i, s in enumerate(services):
        mine = out.withColumn("service", F.lit(s.name)).withColumn("group_id", F.lit(s.group)).withColumn(
            "handled_types", F.array(*[F.lit(t) for t in s.handled]).cast("array<string>")
        )
        done = apply_handler(mine, handler).drop("handled_types")
        ours = branch(F.lit(s.name), SNAPSHOT_TOPIC).isin("event", "tombstone")
        fine = F.when(F.col("handler_ok") & ~F.col("is_tombstone"), F.lit("1")).otherwise(F.lit("0"))
        out = done.withColumn(f"_mark{i}", F.when(ours, fine).otherwise(F.lit(C.NOT_MINE))).drop(
            "service", "group_id", "error_class", "error_message", "handler_ok"
        )
        each.append(f"_mark{i}")
    return out.withColumn("marks", F.concat(*each)).drop(*each)


def fold_stream(
    log: DataFrame,
    services: Sequence[ServiceSpec] = DEFAULT_SERVICES,
    handler: Handler | None = None,
    guarded: bool = True,
    lifecycle: Lifecycle = ORDER_LIFECYCLE,
    merge_topics: Sequence[str] = (),
    delay: str = "10 minutes",
) -> DataFrame:
    """The fold as a stream: one output row per delivery and group, with the state it left.

    With ``merge_topics`` the log holds several topics. Their rows are put in the merged order
    (log append time, then the topics' order given, then offset) by a buffer behind a
    watermark of ``delay``, which must cover how far the topics run apart: a row that comes
    later than that is dropped. Rows leave the buffer once newer ones have moved the watermark.
    """
    source = log.withWatermark("timestamp", delay) if merge_topics else log
    decoded = with_delivery(parse_event(source, with_payload=False, lifecycle=lifecycle))
    rows = seen_by(decoded, services, handler)
    groups = [s.group for s in services]
    keyed = rows.withColumn(
        "order_id", F.when(F.col("is_tombstone"), X.key_text(F.col("key"))).otherwise(F.col("order_id"))
    ).where(~F.col("is_poison") & F.col("marks").rlike("[01]"))
    slim = ["partition", "offset", "is_tombstone", F.coalesce("sequence", F.lit(0).cast("bigint")).alias("sequence"), "event_type", "event_id", "marks"]
    if not merge_topics:
        folded = keyed.select(*C.bucket_of(F.col("order_id")), "order_id", *slim).groupBy("bucket").transformWithStateInPandas(
            C.FoldCells(groups, guarded, lifecycle), C.FOLD_ROWS, "Append", "None"
        )
    else:
        rank = F.array_position(F.array(*[F.lit(t) for t in merge_topics]), F.col("topic")).cast("int")
        placed = keyed.where(F.col("is_tombstone") | (F.col("topic") != SNAPSHOT_TOPIC)).select(
            *C.bucket_of(F.col("order_id")), "order_id", *slim, "timestamp", F.unix_micros("timestamp").alias("arrival"), rank.alias("topic_rank")
        )
        folded = placed.groupBy("bucket").transformWithStateInPandas(
            C.MergedFoldCells(groups, guarded, lifecycle), C.FOLD_ROWS, "Append", "EventTime"
        )
    return folded.withColumns(
        {
            "sequence": F.when(~F.col("is_tombstone"), F.col("sequence")),
            "prev_sequence": F.when(F.col("prev_state").isNotNull(), F.col("prev_sequence")),
            "last_sequence": F.when(F.col("state").isNotNull(), F.col("last_sequence")),
        }
    )


def guard_stream(commands: DataFrame, lifecycle: Lifecycle = ORDER_LIFECYCLE) -> DataFrame:
    """The transition guard as a stream, for any lifecycle."""
    checked = check_advances(commands, lifecycle)
    sure = [F.coalesce(c, F.lit(False)).alias(c) for c in ("force", "payload_ok", "publish_ok")]
    rows = checked.select(*C.bucket_of(F.col("order_id")), "order_id", "cmd_id", "kind", "event_type", *sure)
    judged = rows.groupBy("bucket").transformWithStateInPandas(C.GuardCells(lifecycle), C.GUARD_ROWS, "Append", "None")
    return judged.withColumn("sequence", F.when(F.col("sequence") > 0, F.col("sequence")))


def release_stream(lane: DataFrame, tiered: bool = False, at_ms: int | None = None) -> DataFrame:
    """Waiting records as they leave the lane, on processing-time timers; whole lane rows, headers included.

    A record leaves when it is due and everything before it in its partition has left;
    ``tiered`` lets each attempt wait in a lane of its own. A lane without new records is
    drained all the same, as long as the query runs. ``at_ms`` releases what is due at that
    moment and keeps the rest, whatever the machine's clock says.
    """
    rows = with_retry_fields(lane).select(
        *[c for c in LOG_COLUMNS if c not in ("timestamp", "headers")], F.unix_micros("timestamp").alias("micros"),
        F.transform("headers", lambda h: h["key"]).alias("names"), F.transform("headers", lambda h: h["value"]).alias("texts"),
        F.coalesce(F.unix_millis("due_at"), F.unix_millis("timestamp")).alias("due_ms"), "attempt",
    )
    keys = ["topic", "partition", "attempt"] if tiered else ["topic", "partition"]
    left = rows.groupBy(*keys).transformWithStateInPandas(
        P.ReleaseProcessor(at_ms), P.RELEASE_ROWS, "Append", "ProcessingTime" if at_ms is None else "None"
    )
    headers = F.zip_with("names", "texts", lambda name, text: F.struct(name.alias("key"), text.alias("value")))
    return left.select(
        "topic", "partition", "offset", F.timestamp_micros("micros").alias("timestamp"), "key", "value", headers.alias("headers"),
        "due_ms", "released_ms",
    )


def failure_sink(
    path: str,
    services: Sequence[ServiceSpec] = DEFAULT_SERVICES,
    handler: Handler | None = None,
    policy: RetryPolicy = RetryPolicy(),
    sequencer: Sequencer | None = None,
):
    """A ``foreachBatch`` function appending failed deliveries to the retry and dead-letter logs.

    Both are written in one pass over the batch, into a folder that is rewritten if the batch
    runs again, so neither log holds a record twice. Positions are the sequencer's.
    """
    numbers = sequencer or Sequencer(f"{path}-ends")
    ordinal = F.lit(0)
    for i, s in enumerate(services):
        ordinal = F.when(F.col("service") == s.name, F.lit(i)).otherwise(ordinal)

    def write(batch: DataFrame, batch_id: int) -> None:
        moment = F.col("timestamp") + F.make_dt_interval(secs=F.lit(1))
        failed = route_failures(failed_deliveries(batch, services, handler), policy)
        kept = failed.withColumn("ordinal", ordinal).withColumn("moment", moment).withColumn("source_offset", F.col("offset")).withColumn("source", F.col("topic"))
        records = written(to_failure_logs(kept, F.col("moment"), policy, ["source", "source_offset", "ordinal", "moment"]), "failures")
        cut = records.withColumn("_cell", int_div(F.col("source_offset"), BLOCK_ROWS))
        placed = numbers.place(cut, ["_cell"], ["source_offset", "source", "ordinal"], batch_id)
        write_batch(as_log(placed, F.col("offset"), F.col("moment")), path, batch_id)

    return write


def release_sink(path: str, sequencer: Sequencer, services: Sequence[ServiceSpec] = DEFAULT_SERVICES):
    """A ``foreachBatch`` function for ``release_stream``: released records go to the end of the log they came from.

    Records nothing can run go to the dead-letter log's end, in the same repeatable write.
    The sequencer knows the ends, so no log is read. Without records nothing is written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # Timers depend on the clock, so the batch is worked out once and read from its folder.
        write_batch(batch, f"{path}-released", batch_id)
        lane = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}-released/batch={batch_id}")
        if lane.isEmpty():
            return
        moment = F.timestamp_millis("released_ms")
        marked = with_retry_fields(lane).withColumn("lane_partition", F.col("partition")).withColumn("lane_offset", F.col("offset")).withColumn("moment", moment)
        judged = judge_due(marked, services)
        keep = ["lane_partition", "lane_offset", "moment"]
        records = written(release(judged, keep).unionByName(give_up(judged, F.col("moment"), keep)), "released-records")
        cut = records.withColumn("_cell", int_div(F.col("lane_offset"), BLOCK_ROWS))
        placed = sequencer.place(cut, ["lane_partition", "_cell"], ["lane_offset"], batch_id)
        write_batch(as_log(placed, F.col("offset"), F.col("moment")), path, batch_id)

    return write


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available into a Parquet table, then stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


def run_batches(stream: DataFrame, write, checkpoint: str) -> None:
    """Process everything available through a ``foreachBatch`` function, then stop."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True
    ).start().awaitTermination()


