"""Writing records to log tables or Kafka. Every table write can be repeated safely."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.schemas import LIFECYCLE_TOPIC, SNAPSHOT_TOPIC
from eventfold.sources.offsets import key_partition

NO_HEADERS = "array<struct<key:string,value:binary>>"


def event_value(event_id, order_id, sequence, event_type, occurred_at, payload_json) -> Column:
    """JSON text of one event in the producer's field order; the payload is JSON text already."""
    head = F.to_json(
        F.struct(
            event_id.alias("event_id"), order_id.alias("order_id"), sequence.alias("sequence"),
            event_type.alias("event_type"),
            F.date_format(occurred_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("occurred_at"),
        )
    )
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"payload":'), payload_json, F.lit("}"))


def event_records(events: DataFrame, partitions: int, topic: str = LIFECYCLE_TOPIC) -> DataFrame:
    """Typed events as records keyed by order; the partition follows from the key."""
    c = F.col
    key = F.encode(c("order_id"), "UTF-8")
    value = event_value(
        c("event_id"), c("order_id"), c("sequence"), c("event_type"), c("occurred_at"), c("payload_json")
    )
    return events.select(
        F.lit(topic).alias("topic"),
        key_partition(key, partitions).alias("partition"),
        key.alias("key"),
        F.encode(value, "UTF-8").alias("value"),
        F.lit(None).cast(NO_HEADERS).alias("headers"),
    )


def tombstone_records(order_id: Column, rows: DataFrame, partitions: int, topic: str = SNAPSHOT_TOPIC) -> DataFrame:
    """A key with no value: the delete of an order on a compacted log."""
    key = F.encode(order_id, "UTF-8")
    return rows.select(
        F.lit(topic).alias("topic"),
        key_partition(key, partitions).alias("partition"),
        key.alias("key"),
        F.lit(None).cast("binary").alias("value"),
        F.lit(None).cast(NO_HEADERS).alias("headers"),
    )


def write_batch(records: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch into its own folder, replacing what a failed attempt left there."""
    records.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def table_sink(path: str, route: Callable[[DataFrame], Mapping[str, DataFrame]]):
    """A ``foreachBatch`` function that writes several outputs of one batch.

    ``route`` maps output names to rows. A repeated batch id rewrites the same folders, so
    each output holds every batch once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, rows in route(batch).items():
                write_batch(rows, f"{path}/{name}", batch_id)
        finally:
            batch.unpersist()

    return write


def write_kafka(records: DataFrame, servers: str) -> None:
    """Publish records; needs the Kafka connector. Topic, partition and headers are columns."""
    out = records.select("topic", "partition", "key", "value", "headers")
    out.write.format("kafka").options(
        **{
            "kafka.bootstrap.servers": servers,
            "kafka.acks": "all",
            "kafka.enable.idempotence": "true",
            "includeHeaders": "true",
        }
    ).save()


