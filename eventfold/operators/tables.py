"""Whole-order views: the current record of every order, and its snapshot text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.functions import text as X
from eventfold.lifecycle import ORDER_LIFECYCLE, Lifecycle
from eventfold.operators.decode import parse_event
from eventfold.operators.guarded import event_fold, place
from eventfold.operators.routing import with_delivery
from eventfold.plans.compose import fold
from eventfold.plans.hot import BLOCK_ROWS
from eventfold.schemas import SNAPSHOT_TOPIC
from eventfold.session import written

_ALONG = ("offset", "topic", "partition")


def owner_rows(log: DataFrame, lifecycle: Lifecycle = ORDER_LIFECYCLE) -> DataFrame:
    """What an order's owner reads: its events and tombstones, without redeliveries aimed at one service.

    Creations keep their payload in ``created``; it is null elsewhere.
    """
    decoded = with_delivery(parse_event(log, lifecycle=lifecycle))
    mine = decoded.where(
        ~F.col("is_poison") & F.col("retry_target").isNull() & (F.col("is_tombstone") | (F.col("topic") != SNAPSHOT_TOPIC))
    )
    births = [e for e, before, _ in lifecycle.steps if before is None]
    return mine.select(
        *_ALONG, F.when(F.col("is_tombstone"), X.key_text(F.col("key"))).otherwise(F.col("order_id")).alias("order_id"),
        "sequence", "event_type", "is_tombstone", F.when(F.col("event_type").isin(births), F.col("created")).alias("created"),
    )


def table_from_events(
    log: DataFrame, lifecycle: Lifecycle = ORDER_LIFECYCLE, *, only: str | None = None, order: Sequence[str] = _ALONG, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Current record of every live order: what its creation said plus where it stands now.

    The state moves by legal steps only; a forced or lost step leaves it, see ``event_fold``.
    The creation is the one the order's life began with, which after a delete is the one
    that recreated it; the fold carries its place. The log is decoded once, into narrow rows
    that hold a payload only for creations, and each order fetches one of them. ``only``
    narrows the decoded rows to one order before anything is shuffled.
    """
    rows = owner_rows(log, lifecycle)
    rows = written(rows if only is None else rows.where(F.col("order_id") == only), "owner-rows")
    stands = fold(rows, event_fold(lifecycle), "order_id", order, block_rows=block_rows).where("state is not null")
    made = rows.where(F.col("created").isNotNull()).select("order_id", place(F.col("partition"), F.col("offset")).alias("created_at"), "created.*")
    return made.join(stands, ["order_id", "created_at"]).select(
        "order_id", "customer_id", "state", "last_sequence", "total_amount", "payment", "items",
        lifecycle.expected_next(F.col("state")).alias("expected_next_event"),
    )


def get_order(log: DataFrame, order_id: str, lifecycle: Lifecycle = ORDER_LIFECYCLE) -> DataFrame:
    """One order's whole record; no row means it is unknown or deleted."""
    return table_from_events(log, lifecycle, only=order_id)


def snapshot_json() -> Column:
    """One self-contained JSON value per order, nothing left out."""
    names = (
        "order_id", "customer_id", "state", "last_sequence", "total_amount", "payment", "items",
        "expected_next_event",
    )
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
