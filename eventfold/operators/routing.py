"""First-match routing of every record for every service."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.functions import headers as H
from eventfold.functions import text as X
from eventfold.operators.decode import poison_message
from eventfold.operators.services import DEFAULT_SERVICES, Handler, ServiceSpec, apply_handler, fan_out
from eventfold.schemas import SNAPSHOT_TOPIC


def with_delivery(decoded: DataFrame) -> DataFrame:
    """Add what the headers say about a delivery: ``attempt`` and ``retry_target``."""
    return decoded.withColumn("attempt", H.attempt_of(H.header(F.col("headers"), H.ATTEMPT))).withColumn(
        "retry_target", H.header(F.col("headers"), H.RETRY_TARGET)
    )


def branch(service: Column, snapshot_topic: str = SNAPSHOT_TOPIC) -> Column:
    """Which way a record goes for one service; the first rule that fits wins.

    A record without a value deletes on any topic, so that rule comes before decoding.
    """
    return (
        F.when(F.col("is_tombstone"), F.lit("tombstone"))
        .when(F.col("topic") == snapshot_topic, F.lit("snapshot"))
        .when(F.col("retry_target").isNotNull() & (F.col("retry_target") != service), F.lit("not_ours"))
        .when(F.col("is_poison"), F.lit("poison"))
        .otherwise(F.lit("event"))
    )


def route(
    decoded: DataFrame,
    services: Sequence[ServiceSpec] = DEFAULT_SERVICES,
    snapshot_topic: str = SNAPSHOT_TOPIC,
) -> DataFrame:
    """Fan decoded records out to the services and add ``route``; narrow."""
    seen = decoded if "attempt" in decoded.columns else with_delivery(decoded)
    return fan_out(seen, services).withColumn("route", branch(F.col("service"), snapshot_topic))


#: What ``per_service`` adds for every service.
OUTCOME = ("route", "error_class", "error_message", "handler_ok")


def per_service(
    rows: DataFrame, services: Sequence[ServiceSpec], handler: Handler | None, snapshot_topic: str = SNAPSHOT_TOPIC
) -> DataFrame:
    """Route and handler outcome of every service as columns of the undivided row, numbered by service.

    The handler runs once per service on all rows, so it must not change columns other than
    the two it adds. Whoever needs one row per service calls :func:`divided` at the end.
    """
    out = rows
    for i, s in enumerate(services):
        handled = apply_handler(
            out.withColumn("service", F.lit(s.name)).withColumn("group_id", F.lit(s.group)).withColumn(
                "handled_types", F.array(*[F.lit(t) for t in s.handled]).cast("array<string>")
            ),
            handler,
        )
        out = handled.withColumn("route", branch(F.lit(s.name), snapshot_topic)).select(
            *out.columns, *[F.col(name).alias(f"_{name}{i}") for name in OUTCOME]
        )
    return out


def divided(rows: DataFrame, services: Sequence[ServiceSpec], names: Sequence[str] = OUTCOME) -> DataFrame:
    """One row per service: its numbered columns under their own ``names``, with ``service`` and ``group_id``."""
    numbered = {f"_{name}{i}" for name in names for i in range(len(services))}
    at = rows.select("*", F.explode(F.array(*[F.lit(i) for i in range(len(services))])).alias("_at"))

    def pick(values: Sequence[Column]) -> Column:
        out = values[-1]
        for i in reversed(range(len(values) - 1)):
            out = F.when(F.col("_at") == i, values[i]).otherwise(out)
        return out

    return at.select(
        *[c for c in rows.columns if c not in numbered],
        pick([F.lit(s.name) for s in services]).alias("service"),
        pick([F.lit(s.group) for s in services]).alias("group_id"),
        *[pick([F.col(f"_{name}{i}") for i in range(len(services))]).alias(name) for name in names],
    )


def poison_failures(routed: DataFrame) -> DataFrame:
    """Undecodable records as failed deliveries, keyed by the record key."""
    return routed.where(F.col("route") == "poison").withColumn(
        "error_class", F.lit("NonRetryableError")
    ).withColumn("error_message", poison_message(F.col("reasons"))).withColumn(
        "order_id", X.key_text(F.col("key"))
    )
