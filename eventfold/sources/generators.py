"""Deterministic orders and malformed messages for trying out a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.functions.text import pad_left

from eventfold.functions.text import new_event_id
from eventfold.lifecycle import ORDER_LIFECYCLE
from eventfold.schemas import LIFECYCLE_TOPIC
from eventfold.sources.sinks import NO_HEADERS

#: Messages that cannot be decoded, fixed values.
NOT_JSON = "this is not json at all }{"
WRONG_SHAPE = '{"order_id":"poison-order-%s","this_field":"is not the schema"}'


def gen_orders(ids: DataFrame, advance: bool = False) -> DataFrame:
    """One order per row of ``i``: created only, or walked to the end of its lifecycle."""
    last = len(ORDER_LIFECYCLE.event_types) if advance else 1
    kinds = F.array(*[F.lit(t) for t in ORDER_LIFECYCLE.event_types])
    i = F.col("i").cast("string")
    payload = (
        F.when(
            F.col("sequence") == 1,
            F.format_string(
                '{"customer_id":"cust-%s","items":[{"sku":"PEN","qty":1,"unit_price":1000}],"total_amount":1000,'
                '"payment":{"method":"CARD","reference":"pay-%s","amount":1000}}',
                i, i,
            ),
        )
        .when(F.col("sequence") == 3, F.format_string('{"carrier":"Pathao","tracking_number":"PT-%s"}', i))
        .otherwise(F.lit("{}"))
    )
    steps = ids.select("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(last).cast("bigint"))).alias("sequence"))
    order_id = F.concat(F.lit("ord-"), pad_left(F.col("i").cast("string"), 12))
    return steps.select(
        "i",
        order_id.alias("order_id"),
        "sequence",
        F.get(kinds, (F.col("sequence") - 1).cast("int")).alias("event_type"),
        payload.alias("payload_json"),
        F.timestamp_seconds(F.lit(1767225600) + F.col("sequence")).alias("occurred_at"),
    ).withColumn("event_id", new_event_id(F.lit("gen"), F.col("i"), F.col("sequence")))


def gen_poison(ids: DataFrame, topic: str = LIFECYCLE_TOPIC, partitions: int = 3) -> DataFrame:
    """Two malformed records per row of ``i``: not JSON, and JSON of the wrong shape."""
    i = F.col("i").cast("string")
    values = F.array(F.lit(NOT_JSON), F.format_string(WRONG_SHAPE, i))
    return ids.select("i", F.posexplode(values).alias("n", "text")).select(
        F.lit(topic).alias("topic"),
        F.pmod(F.col("i"), F.lit(partitions)).cast("int").alias("partition"),
        F.encode(F.concat(F.lit("poison-order-"), i), "UTF-8").alias("key"),
        F.encode("text", "UTF-8").alias("value"),
        F.lit(None).cast(NO_HEADERS).alias("headers"),
    )


