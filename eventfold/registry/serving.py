"""Runs of the service reactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventfold.operators import routing as RT
from eventfold.operators import services as S
from eventfold.operators.decode import parse_event
from eventfold.registry import register
from eventfold.registry.decoding import events
from eventfold.registry.sql import using
from eventfold.session import written
from eventfold.sources.order_log import fixture_handler, lifecycle_log


def handled_rows(log, service="analytics"):
    """Deliveries one service handled; each attempt that failed is left out."""
    decoded = RT.with_delivery(parse_event(log, with_payload=False))
    mine = [s for s in S.DEFAULT_SERVICES if s.name == service]
    rows = RT.route(decoded, mine).where(F.col("route") == "event")
    return S.apply_handler(rows, fixture_handler).where("handler_ok")


def handled(spark, d):
    return handled_rows(lifecycle_log(spark, d))


@register(
    "inventory_reserve",
    using(
        """SELECT log.order_id, p AS "partition", off AS "offset", sku, qty FROM log JOIN lines USING (k)
        WHERE kind = 'event' AND ty = 'ORDER_CREATED'""",
        "log",
        "lines",
    ),
)
def inventory_reserve(spark, d):
    return S.inventory_reserve(events(spark, d))


@register(
    "inventory_commit",
    using(
        """SELECT order_id, p AS "partition", off AS "offset", 'Pathao' AS carrier, 'PT-' || k AS tracking_number
        FROM log WHERE kind = 'event' AND ty = 'SHIPPED'""",
        "log",
    ),
)
def inventory_commit(spark, d):
    return S.inventory_commit(events(spark, d))


@register(
    "notification_text",
    using(
        """SELECT order_id, p AS "partition", off AS "offset", CASE ty
        WHEN 'ORDER_CREATED' THEN 'Order confirmed — payment received, we are preparing it (total ' || total || ')'
        WHEN 'PACKED' THEN 'Your order is packed and waiting for pickup'
        WHEN 'SHIPPED' THEN 'On its way via Pathao, tracking PT-' || k
        ELSE 'Delivered — thanks for shopping with us' END AS message FROM events_ok""",
        "events_ok",
    ),
)
def notification_text(spark, d):
    return S.notifications(events(spark, d))


@register(
    "analytics_counts",
    using(
        "SELECT ty AS event_type, count(*) AS n FROM dlv WHERE service = 'analytics' AND NOT stone AND err IS NULL GROUP BY 1",
        "dlv",
    ),
)
def analytics_counts(spark, d):
    return S.analytics_counts(handled(spark, d))


@register(
    "analytics_running",
    using(
        """SELECT p AS "partition", off AS "offset", ty AS event_type,
        count(*) OVER (PARTITION BY p, ty ORDER BY off) AS tally FROM dlv WHERE service = 'analytics' AND NOT stone AND err IS NULL""",
        "dlv",
    ),
)
def analytics_running(spark, d):
    slim = handled(spark, d).select("topic", "partition", "offset", "event_type")
    return S.analytics_running(written(slim, "handled"), block_rows=8192).select(
        "partition", "offset", "event_type", "tally"
    )


@register(
    "service_fanout",
    using(
        """SELECT service, ty AS event_type, service <> 'inventory' OR ty IN ('ORDER_CREATED', 'SHIPPED') AS handled, count(*) AS n
        FROM log CROSS JOIN services WHERE kind = 'event' GROUP BY 1, 2, 3""",
        "log",
        "services",
    ),
)
def service_fanout(spark, d):
    return S.service_fanout(events(spark, d)).groupBy("service", "event_type", "handled").agg(
        F.count(F.lit(1)).alias("n")
    )
