"""From the guard's results to logs: events with their payload, whole-order snapshots, tombstones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.lifecycle import ORDER_LIFECYCLE, Lifecycle
from eventfold.operators.commands import accepted_events, deletes, orders_after
from eventfold.operators.tables import snapshot_json
from eventfold.schemas import LIFECYCLE_TOPIC, SNAPSHOT_TOPIC
from eventfold.session import written
from eventfold.sources.offsets import key_partition
from eventfold.sources.outbox import Outbox
from eventfold.sources.sinks import NO_HEADERS, event_records, tombstone_records

#: Records before they have a position.
RECORD = f"topic string, partition int, key binary, value binary, headers {NO_HEADERS}"


def creation_payloads(creates: DataFrame, lines: DataFrame) -> DataFrame:
    """What each creation says (cmd_id, order_id, customer_id, total_amount, payment, items), from its header and lines.

    Items of a command come sorted by all their fields, as the tables do not order them.
    """
    items = lines.groupBy("cmd_id").agg(F.array_sort(F.collect_list(F.struct("sku", "qty", "unit_price"))).alias("items"))
    return creates.join(items, "cmd_id").select(
        "cmd_id", "order_id", "customer_id", "total_amount", F.struct("method", "reference", "amount").alias("payment"), "items"
    )


def publish_results(
    outbox: Outbox, batch_id: int, results: DataFrame, creations: DataFrame, advances: DataFrame, partitions: int, lifecycle: Lifecycle = ORDER_LIFECYCLE
) -> DataFrame:
    """Publish one run of the guard: events, then snapshots of the orders as they stand, then tombstones of the deleted.

    ``results`` come from ``commands.guard``, ``creations`` from ``creation_payloads``,
    ``advances`` holds ``cmd_id`` and ``payload`` (JSON text). The three logs are one batch.
    For a batch that is committed nothing is worked out again.
    """
    if (done := outbox.batch(batch_id)) is not None:
        return done
    results = written(results, "guard-results")
    made = written(creations, "creations")
    said = made.select("cmd_id", F.to_json(F.struct("customer_id", "items", "total_amount", "payment")).alias("payload_json")).unionByName(
        advances.select("cmd_id", F.coalesce("payload", F.lit("{}")).alias("payload_json"))
    )
    events = accepted_events(results).join(said, "cmd_id").select(
        F.concat(F.lit("evt-"), F.col("cmd_id").cast("string")).alias("event_id"), "order_id", "sequence", "event_type",
        F.timestamp_millis(F.col("cmd_id")).alias("occurred_at"), "payload_json",
    )
    born = results.where(F.col("status") == 201).select("cmd_id")
    stands = orders_after(results, lifecycle).join(made.join(born, "cmd_id", "left_semi").drop("cmd_id"), "order_id")
    key = F.encode("order_id", "UTF-8")
    snapshots = stands.select(
        F.lit(SNAPSHOT_TOPIC).alias("topic"), key_partition(key, partitions).alias("partition"), key.alias("key"),
        F.encode(snapshot_json(), "UTF-8").alias("value"), F.lit(None).cast(NO_HEADERS).alias("headers"),
    )
    gone = tombstone_records(F.col("order_id"), deletes(results), partitions)
    return outbox.publish(
        batch_id, {LIFECYCLE_TOPIC: event_records(events, partitions), SNAPSHOT_TOPIC: snapshots, f"{SNAPSHOT_TOPIC}-deletes": gone}
    )
