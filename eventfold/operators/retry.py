"""The retry lane: when a waiting record is released, and the whole cycle to its end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.functions import headers as H
from eventfold.operators.decode import parse_event, poison_message
from eventfold.operators.failures import (
    RetryPolicy,
    failed_deliveries,
    route_failures,
    to_dead_letter,
    to_failure_logs,
    to_source,
)
from eventfold.operators.services import DEFAULT_SERVICES, Handler, ServiceSpec
from eventfold.plans.hot import BLOCK_ROWS
from eventfold.plans.hot import int_div
from eventfold.plans.scan import numbered, running
from eventfold.schemas import LOG_SCHEMA, RETRY_TOPIC
from eventfold.sources.offsets import log_bounds
from eventfold.session import work_dir


def with_retry_fields(lane: DataFrame) -> DataFrame:
    """Add what the retry worker reads from the headers of a waiting record."""
    m = F.col("headers_map")
    pick = lambda name: F.try_element_at(m, F.lit(name))
    return (
        lane.withColumn("headers_map", H.decode_headers(F.col("headers")))
        .withColumn("attempt", H.int_header(pick(H.ATTEMPT), 2))
        .withColumn("service", F.coalesce(pick(H.SERVICE), F.lit("")))
        .withColumn("due_at", H.due_time(pick(H.RETRY_AT)))
        .withColumn(
            "origin",
            H.origin_of(m, F.col("topic"), F.col("partition"), F.col("offset"), F.col("timestamp")),
        )
    )


def due_gate_hol(waiting: DataFrame, now: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Release times with head-of-line blocking.

    A record leaves when it is due and everything before it in its partition has left, so
    its release time is the largest due time up to it. Two-level running maximum: no task
    holds more than one offset block of a partition.
    """
    ready = F.greatest(F.coalesce("due_at", "timestamp"), F.col("timestamp"))
    gated = running(waiting, ["topic", "partition"], "offset", {"release_at": ("max", ready)}, block_rows)
    return gated.withColumn("released", F.col("release_at") <= now)


def due_gate_tiered(waiting: DataFrame, now: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Release times with one lane per attempt, so a long wait never blocks a short one."""
    ready = F.greatest(F.coalesce("due_at", "timestamp"), F.col("timestamp"))
    gated = running(
        waiting, ["topic", "partition", "attempt"], "offset", {"release_at": ("max", ready)}, block_rows
    )
    return gated.withColumn("released", F.col("release_at") <= now)


def judge_due(
    due: DataFrame, services: Sequence[ServiceSpec] = DEFAULT_SERVICES
) -> DataFrame:
    """What becomes of a due record: ``release`` it, or ``give_up`` for an unknown service or bad bytes."""
    names = sorted(s.name for s in services)
    known = F.col("service").isin(names)
    decoded = parse_event(due.withColumn("body", F.col("value")), with_payload=False)
    verdict = (
        F.when(
            ~known,
            F.format_string(
                "x-service header '%s' names no registered service (known: %s)",
                F.col("service"), F.lit(", ".join(names)),
            ),
        )
        .when(F.col("is_tombstone"), F.lit("undecodable message: null"))
        .when(F.col("is_poison"), poison_message(F.col("reasons")))
    )
    group = F.concat(
        F.when(F.col("service") == "", F.lit("<unset>")).otherwise(F.col("service")), F.lit("-service")
    )
    for s in services:
        group = F.when(F.col("service") == s.name, F.lit(s.group)).otherwise(group)
    return (
        decoded.withColumn("value", F.col("body"))
        .drop("body")
        .withColumn("error_message", verdict)
        .withColumn("error_class", F.when(F.col("error_message").isNotNull(), F.lit("NonRetryableError")))
        .withColumn("action", F.when(F.col("error_message").isNull(), F.lit("release")).otherwise(F.lit("give_up")))
        .withColumn("group_id", group)
        .withColumn("service", F.when(F.col("service") == "", F.lit("<unset>")).otherwise(F.col("service")))
        .withColumn("attempts_made", F.col("attempt"))
        .withColumn("destination", F.lit("dlq"))
    )


def give_up(judged: DataFrame, now: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Dead letters for due records nothing can run."""
    return to_dead_letter(judged.where(F.col("action") == "give_up"), now, keep)


def release(judged: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Records going back to the log they came from."""
    return to_source(judged.where(F.col("action") == "release"), keep)


def as_log(records: DataFrame, offset: Column, timestamp: Column) -> DataFrame:
    """Addressed records as log rows at given positions."""
    return records.select(
        "topic",
        F.col("partition").cast("int").alias("partition"),
        offset.cast("bigint").alias("offset"),
        timestamp.alias("timestamp"),
        "key",
        "value",
        H.encode_headers(F.col("headers_map")).alias("headers"),
    )


def at_end(records: DataFrame, log: DataFrame, timestamp: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Addressed records appended to ``log``: positions from each partition's end on.

    Records carry the lane position they come from as ``lane_partition`` and ``lane_offset``
    and keep that order. The end is the log's as read here, before anything is written.
    """
    ends = log_bounds(log).select("topic", "partition", "high")
    cut = records.withColumn("_cell", int_div(F.col("lane_offset"), block_rows))
    keys = ["topic", "partition"]
    ranked = numbered(cut, keys, ["lane_partition", "_cell"], ["lane_offset"])
    placed = ranked.join(ends, keys, "left")
    return as_log(placed, F.coalesce("high", F.lit(0)) + F.col("rank"), timestamp)


def release_due(
    lane: DataFrame,
    log: DataFrame,
    now: Column,
    services: Sequence[ServiceSpec] = DEFAULT_SERVICES,
    *,
    gate=due_gate_hol,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Run the retry lane once: ``(records to append, records still waiting)``.

    Nothing leaves before the gate lets it. What is due goes back to the end of its source
    log or, when no service can run it, to the end of the dead-letter log; both ends are
    taken from ``log``. ``lane`` is read twice and should be a written table.
    """
    gated = gate(with_retry_fields(lane), now, block_rows)
    marked = gated.withColumn("lane_partition", F.col("partition")).withColumn("lane_offset", F.col("offset"))
    judged = judge_due(marked.where("released"), services)
    keep = ["lane_partition", "lane_offset"]
    records = release(judged, keep).unionByName(give_up(judged, now, keep))
    waiting = gated.where("not released").select(*lane.columns)
    return at_end(records, log, now, block_rows), waiting


def retry_rounds(
    log: DataFrame,
    handler: Handler,
    services: Sequence[ServiceSpec] = DEFAULT_SERVICES,
    policy: RetryPolicy = RetryPolicy(),
    path: str | None = None,
) -> DataFrame:
    """Run the retry cycle until nothing waits, and return every record it wrote.

    Round r handles what round r-1 released. Each round is written to the shared folder and
    read back, so the plan does not grow with the rounds and a lost executor costs at most
    one round. The attempt budget bounds the rounds. A written position is
    ``source offset * services + service``, unique because a delivery is written at most once.
    """
    spark = log.sparkSession
    path = path or work_dir(spark, "retry-rounds")
    n = len(services)
    ordinal = F.lit(0)
    for i, s in enumerate(services):
        ordinal = F.when(F.col("service") == s.name, F.lit(i)).otherwise(ordinal)
    source, written = log, []
    for attempt_round in range(1, policy.max_attempts + 1):
        now = F.col("timestamp") + F.make_dt_interval(secs=F.lit(1))
        failed = route_failures(failed_deliveries(source, services, handler), policy)
        failed = failed.withColumn("position", F.col("offset") * n + ordinal).withColumn("moment", now)
        records = to_failure_logs(failed, F.col("moment"), policy, ["position", "moment"])
        target = f"{path}/round={attempt_round}"
        as_log(records, F.col("position"), F.col("moment")).write.mode("overwrite").parquet(target)
        done = spark.read.schema(LOG_SCHEMA).parquet(target)
        written.append(done.withColumn("round", F.lit(attempt_round)))
        lane = with_retry_fields(done.where(F.col("topic") == RETRY_TOPIC))
        back = release(judge_due(lane, services), ["offset", "due_at", "origin"])
        source = as_log(back, F.col("offset"), F.col("due_at"))
    out = written[0]
    for more in written[1:]:
        out = out.unionByName(more)
    return out


