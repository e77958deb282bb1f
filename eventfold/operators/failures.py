"""Failure routing: classify, spend the attempt budget, and address the retry and dead-letter logs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.functions import headers as H
from eventfold.functions import text as X
from eventfold.operators.decode import parse_event, poison_message
from eventfold.operators.routing import OUTCOME, divided, per_service, with_delivery
from eventfold.operators.services import DEFAULT_SERVICES, Handler, ServiceSpec
from eventfold.schemas import DLQ_TOPIC, RETRY_TOPIC, SNAPSHOT_TOPIC

#: Error classes no further attempt can fix, fixed values.
NON_RETRYABLE = ("NonRetryableError",)


@dataclass(frozen=True)
class RetryPolicy:
    """Attempts in all, and the wait in seconds before attempt 2, 3, and so on."""

    max_attempts: int = 3
    backoff_seconds: Sequence[float] = (30.0, 120.0)

    @property
    def schedule(self) -> list[float]:
        return [float(s) for s in self.backoff_seconds] or [30.0]


def classify(error_class: Column, non_retryable: Sequence[str] = NON_RETRYABLE) -> Column:
    """``poison`` for a declared class, ``retryable`` for anything else, NULL for no error."""
    return F.when(error_class.isin(list(non_retryable)), F.lit("poison")).when(
        error_class.isNotNull(), F.lit("retryable")
    )


def backoff(attempt: Column, policy: RetryPolicy = RetryPolicy()) -> Column:
    """Seconds before an attempt may run; the last entry repeats for later attempts."""
    waits = F.array(*[F.lit(s) for s in policy.schedule])
    index = F.least(attempt - 1, F.lit(len(policy.schedule))).cast("int")
    return F.when(attempt < 2, F.lit(0.0)).otherwise(F.get(waits, index - 1))


def after(moment: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(moment) + F.round(seconds * 1000000).cast("bigint"))


def fail_lever(
    mode: str,
    order_id: Column,
    sequence: Column,
    attempt: Column,
    target: Column | None = None,
    attempts: int = 1,
) -> tuple[Column, Column]:
    """A handler that fails on purpose: ``none``, ``poison``, or ``transient`` for the first attempts."""
    aimed = F.lit(True) if target is None else target
    none = F.lit(None).cast("string")
    if mode == "none":
        return none, none
    if mode == "poison":
        text = F.format_string(
            "HANDLER_FAILURE_MODE=poison: %s seq %d can never be processed", order_id, sequence
        )
        return F.when(aimed, F.lit("NonRetryableError")), F.when(aimed, text)
    if mode == "transient":
        fails = aimed & (attempt <= attempts)
        text = F.format_string(
            "HANDLER_FAILURE_MODE=transient: %s seq %d failed attempt %d of %d",
            order_id, sequence, attempt, F.lit(attempts),
        )
        return F.when(fails, F.lit("RetryableError")), F.when(fails, text)
    raise ValueError(f"unknown failure mode {mode!r}")


def failed_deliveries(
    log: DataFrame,
    services: Sequence[ServiceSpec] = DEFAULT_SERVICES,
    handler: Handler | None = None,
    snapshot_topic: str = SNAPSHOT_TOPIC,
) -> DataFrame:
    """Every delivery that failed: the handler raised, or the record would not decode.

    Narrow. Rows keep the original key and value, and where the record was read. Records
    that no service fails are dropped before a row per service is made.
    """
    decoded = with_delivery(parse_event(log.withColumn("body", F.col("value")), with_payload=False))
    judged, fails = per_service(decoded, services, handler, snapshot_topic), F.lit(False)
    for i in range(len(services)):
        failed = (F.col(f"_route{i}") == "poison") | ((F.col(f"_route{i}") == "event") & F.col(f"_error_class{i}").isNotNull())
        fails = fails | failed
    handled = divided(judged.where(fails), services, OUTCOME).where(F.col("route").isin("event", "poison"))
    bad = F.col("route") == "poison"
    return (
        handled.withColumn(
            "error_class", F.when(bad, F.lit("NonRetryableError")).otherwise(F.col("error_class"))
        )
        .withColumn(
            "error_message", F.when(bad, poison_message(F.col("reasons"))).otherwise(F.col("error_message"))
        )
        .where(F.col("error_class").isNotNull())
        .select(
            "service", "group_id", "topic", "partition", "offset", "timestamp", "attempt",
            F.when(bad, X.key_text(F.col("key"))).otherwise(F.col("order_id")).alias("order_id"),
            "sequence", "error_class", "error_message", "key", F.col("body").alias("value"),
            F.struct(
                F.coalesce("topic", F.lit("unknown")).alias("topic"),
                F.coalesce("partition", F.lit(-1)).alias("partition"),
                F.coalesce("offset", F.lit(-1)).alias("offset"),
                H.message_ts_iso(F.col("timestamp")).alias("timestamp"),
            ).alias("origin"),
        )
    )


def route_failures(
    rows: DataFrame, policy: RetryPolicy = RetryPolicy(), non_retryable: Sequence[str] = NON_RETRYABLE
) -> DataFrame:
    """Decide where each failed delivery goes; narrow.

    Input rows carry ``error_class`` and ``attempt``. Adds ``failure_kind``, ``destination``
    (``retry`` or ``dlq``), ``marker``, ``attempts_made`` and ``next_attempt``.
    """
    failed = rows.where(F.col("error_class").isNotNull())
    kind = classify(F.col("error_class"), non_retryable)
    retry = (kind == "retryable") & (F.lit(policy.max_attempts) > F.col("attempt"))
    return failed.select(
        "*",
        kind.alias("failure_kind"),
        F.when(retry, F.lit("retry")).otherwise(F.lit("dlq")).alias("destination"),
        F.when(retry, F.lit("RETRY_SCHEDULED"))
        .when(kind == "retryable", F.lit("RETRY_EXHAUSTED"))
        .otherwise(F.lit("POISON_MESSAGE"))
        .alias("marker"),
        F.col("attempt").alias("attempts_made"),
        F.when(retry, F.col("attempt") + 1).alias("next_attempt"),
    )


def _record(rows: DataFrame, topic: Column | str, headers_map: Column, extra: Sequence[str] = ()) -> DataFrame:
    topic_col = F.lit(topic) if isinstance(topic, str) else topic
    return rows.select(
        topic_col.alias("topic"),
        F.col("partition"),
        F.col("key"),
        F.col("value"),
        headers_map.alias("headers_map"),
        *[F.col(c) for c in extra],
    )


def _why(now: Column) -> list[Column]:
    return [
        F.lit(H.ERROR_CLASS), F.col("error_class"),
        F.lit(H.ERROR_MESSAGE), X.describe_error(F.col("error_message")),
        F.lit(H.FAILED_AT), H.iso_text(now),
    ]


def _from() -> list[Column]:
    return H.provenance(F.col("service"), F.col("group_id"), F.col("origin"))


def _retry_headers(now: Column, policy: RetryPolicy) -> Column:
    due = after(now, backoff(F.col("next_attempt"), policy))
    return F.create_map(
        *_from(), F.lit(H.ATTEMPT), F.col("next_attempt").cast("string"), F.lit(H.RETRY_AT), H.iso_text(due), *_why(now)
    )


def _dead_headers(now: Column) -> Column:
    return F.create_map(*_from(), F.lit(H.ATTEMPTS_MADE), F.col("attempts_made").cast("string"), *_why(now))


def to_retry(routed: DataFrame, now: Column, policy: RetryPolicy = RetryPolicy(), keep: Sequence[str] = ()) -> DataFrame:
    """Records for the retry log: original key and value, when the next attempt is due, and why."""
    rows = routed.where(F.col("destination") == "retry")
    return _record(rows, RETRY_TOPIC, _retry_headers(now, policy), keep)


def to_dead_letter(routed: DataFrame, now: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Terminal records, with the attempts spent and the last error."""
    return _record(routed.where(F.col("destination") == "dlq"), DLQ_TOPIC, _dead_headers(now), keep)


def to_failure_logs(
    routed: DataFrame, now: Column, policy: RetryPolicy = RetryPolicy(), keep: Sequence[str] = ()
) -> DataFrame:
    """Records for both logs in one pass; the topic tells them apart."""
    waits = F.col("destination") == "retry"
    return _record(
        routed,
        F.when(waits, F.lit(RETRY_TOPIC)).otherwise(F.lit(DLQ_TOPIC)),
        F.when(waits, _retry_headers(now, policy)).otherwise(_dead_headers(now)),
        keep,
    )


def to_source(due: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Due retry records go back to the log they came from, for one service, with the attempt carried on."""
    headers_map = F.create_map(
        *_from(), F.lit(H.ATTEMPT), F.col("attempt").cast("string"), F.lit(H.RETRY_TARGET), F.col("service")
    )
    return _record(due, F.col("origin.topic"), headers_map, keep)
