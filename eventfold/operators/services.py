"""Consumer services: who reads the log, what each reacts to, and the reactions as transforms."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.plans.hot import BLOCK_ROWS
from eventfold.plans.scan import running

#: A handler adds ``error_class`` (NULL on success) and ``error_message`` to its rows. It sees
#: ``service``, ``group_id``, ``attempt`` and the event columns, and must keep every row.
Handler = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class ServiceSpec:
    """One service, its consumer group, and the event types it reacts to."""

    name: str
    handled: Sequence[str]
    group_id: str = ""

    @property
    def group(self) -> str:
        return self.group_id or f"{self.name}-service"


_ALL = ("ORDER_CREATED", "PACKED", "SHIPPED", "DELIVERED")

#: The three readers of the order log, fixed values.
DEFAULT_SERVICES = (
    ServiceSpec("inventory", ("ORDER_CREATED", "SHIPPED")),
    ServiceSpec("notification", _ALL),
    ServiceSpec("analytics", _ALL),
)


def fan_out(rows: DataFrame, services: Sequence[ServiceSpec] = DEFAULT_SERVICES) -> DataFrame:
    """Every service sees every row. Narrow, and it keeps the rows' partitioning, so a
    shuffle done before it is paid once and not once per service."""
    each = F.array(
        *[
            F.struct(
                F.lit(s.name).alias("service"),
                F.lit(s.group).alias("group_id"),
                F.array(*[F.lit(t) for t in s.handled]).cast("array<string>").alias("handled_types"),
            )
            for s in services
        ]
    )
    out = rows.select("*", F.explode(each).alias("_s"))
    return out.select(*rows.columns, "_s.service", "_s.group_id", "_s.handled_types")


def service_fanout(events: DataFrame, services: Sequence[ServiceSpec] = DEFAULT_SERVICES) -> DataFrame:
    """Each event once per service, with whether that service has a handler for it."""
    return fan_out(events, services).select(
        *events.columns,
        "service",
        "group_id",
        F.array_contains("handled_types", F.col("event_type")).alias("handled"),
    )


def apply_handler(rows: DataFrame, handler: Handler | None) -> DataFrame:
    """Run a handler and add ``handler_ok``; without a handler every row succeeds.

    A service has no handler for event types outside ``handled_types``; such events succeed.
    """
    if handler is None:
        none = F.lit(None).cast("string")
        rows = rows.withColumn("error_class", none).withColumn("error_message", none)
    else:
        ours = F.coalesce(F.array_contains("handled_types", F.col("event_type")), F.lit(False))
        rows = handler(rows)
        for name in ("error_class", "error_message"):
            rows = rows.withColumn(name, F.when(ours, F.col(name)))
    return rows.withColumn("handler_ok", F.col("error_class").isNull())


def inventory_reserve(events: DataFrame) -> DataFrame:
    """Stock to reserve: one row per line item of a new order."""
    return events.where(F.col("event_type") == "ORDER_CREATED").select(
        "order_id", "partition", "offset", F.explode("created.items").alias("item")
    ).select("order_id", "partition", "offset", "item.sku", "item.qty")


def inventory_commit(events: DataFrame) -> DataFrame:
    """Reservations turned into stock movements when the parcel ships."""
    return events.where(F.col("event_type") == "SHIPPED").select(
        "order_id", "partition", "offset", "shipped.carrier", "shipped.tracking_number"
    )


#: Customer messages by event type, fixed values.
MESSAGES = {
    "ORDER_CREATED": "Order confirmed — payment received, we are preparing it",
    "PACKED": "Your order is packed and waiting for pickup",
    "SHIPPED": "On its way",
    "DELIVERED": "Delivered — thanks for shopping with us",
}


def notification_text(event_type: Column, total: Column, carrier: Column, tracking: Column) -> Column:
    message = F.lit(None).cast("string")
    for name, words in MESSAGES.items():
        message = F.when(event_type == name, F.lit(words)).otherwise(message)
    return (
        F.when(event_type == "SHIPPED", F.concat(message, F.lit(" via "), carrier, F.lit(", tracking "), tracking))
        .when(event_type == "ORDER_CREATED", F.concat(message, F.lit(" (total "), total.cast("string"), F.lit(")")))
        .otherwise(message)
    )


def notifications(events: DataFrame) -> DataFrame:
    return events.select(
        "order_id",
        "partition",
        "offset",
        notification_text(
            F.col("event_type"),
            F.col("created.total_amount"),
            F.col("shipped.carrier"),
            F.col("shipped.tracking_number"),
        ).alias("message"),
    )


def analytics_counts(deliveries: DataFrame) -> DataFrame:
    """Deliveries handled per event type, repeats included. Combined before the shuffle."""
    return deliveries.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def analytics_running(deliveries: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The tally after each delivery, per log partition and event type, in offset order."""
    return running(
        deliveries, ["topic", "partition", "event_type"], "offset",
        {"tally": ("sum", F.lit(1).cast("bigint"))}, block_rows,
    )
