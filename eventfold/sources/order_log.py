"""A lifecycle log derived from the ``orders`` table in one pass.

Orders are dealt by key first, five narrow columns each, as a table of one file may come as
one task, which would then build and decode the bytes of every record.

Every order becomes a run of records on partition ``orderkey % partitions``. Which records
an order gets follows from its status and from remainders of its key, so gaps, illegal
steps, late and duplicate deliveries, bad bytes and deletes all occur at known places.
Orders advance in cohorts: the offset is (cohort, slot, place in cohort), unique and
increasing within a partition, with holes as in any compacted log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.functions import headers as H
from eventfold.functions.text import pad_left
from eventfold.plans.hot import int_div
from eventfold.schemas import LIFECYCLE_TOPIC, LOG_SCHEMA

PARTITIONS = 3
COHORT = 1024
SLOTS = 16
#: 2026-01-01T00:00:00Z; one offset is one millisecond.
START_MILLIS = 1767225600000

_TYPES = ("ORDER_CREATED", "PACKED", "SHIPPED", "DELIVERED")


#: Log tables already written for a data folder: folder to path.
_TABLES: dict[str, str] = {}


def use_log_table(sf_dir: str, path: str | None) -> None:
    """Read the lifecycle log of a data folder from a written table instead of deriving it."""
    if path is None:
        _TABLES.pop(sf_dir, None)
    else:
        _TABLES[sf_dir] = path


def order_id_of(key: Column) -> Column:
    return F.concat(F.lit("ord-"), pad_left(key.cast("string"), 12, "0"))


def order_number(order_id: Column) -> Column:
    return F.substring(order_id, 5, 20).try_cast("bigint")


def _steps(k: Column, n: Column) -> Column:
    """Records of one order as an array of (slot, kind, step, event type)."""

    def rec(when: Column, slot: Column | int, kind: str, step, event_type):
        slot = F.lit(slot) if isinstance(slot, int) else slot
        return F.when(
            when,
            F.struct(
                slot.cast("bigint").alias("slot"),
                F.lit(kind).alias("kind"),
                F.lit(step).cast("bigint").alias("s"),
                (event_type if isinstance(event_type, Column) else F.lit(event_type).cast("string")).alias("ty"),
            ),
        )

    out = [
        rec(k % 31 == 13, 0, "not_json", None, None),
        rec(k % 41 == 19, 1, "bad_schema", None, None),
    ]
    for i, name in enumerate(_TYPES, start=1):
        there = n >= i
        if i == 2:
            slot = F.when(k % 29 == 11, F.lit(8)).otherwise(F.lit(4))
            kind = F.when(k % 23 == 7, F.lit("DELIVERED")).otherwise(F.lit(name))
            out.append(rec(there & (k % 17 != 3), slot, "event", i, kind))
        else:
            out.append(rec(there, (2, 4, 6, 9)[i - 1], "event", i, name))
        out.append(rec(there & (k % 19 == 5), (3, 5, 7, 10)[i - 1], "event", i, name))
    out.append(rec(k % 37 == 17, 11, "tombstone", None, None))
    out.append(rec(k % 74 == 17, 12, "event", 1, "ORDER_CREATED"))
    return F.array_compact(F.array(*out))


def lines(k: Column, price: Column) -> Column:
    """One to three line items of an order."""
    return F.transform(
        F.sequence(F.lit(0).cast("bigint"), k % 3),
        lambda i: F.struct(
            F.concat(F.lit("P-"), ((k * 7 + i * 13) % 2000).cast("string")).alias("sku"),
            (1 + (k + i) % 5).alias("qty"),
            (100 + price % 9000 + i * 10).alias("unit_price"),
        ),
    )


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Narrow rows dealt by key to at least two tasks a core, before they are made into wide ones."""
    return rows.repartition(max(2 * rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()), key)


def lifecycle_rows(spark: SparkSession, sf_dir: str, partitions: int = PARTITIONS) -> DataFrame:
    """The log as typed columns, before anything is encoded to bytes."""
    k = F.col("o_orderkey")
    n = (
        F.when(F.col("o_orderstatus") == "F", 4)
        .when(F.col("o_orderstatus") == "P", 3)
        .otherwise(1 + k % 2)
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("k"),
        F.col("o_custkey").alias("ck"),
        F.floor("o_totalprice").cast("bigint").alias("price"),
        F.col("o_orderdate").alias("ordered"),
        n.cast("bigint").alias("n"),
    )
    base = dealt(orders, "k").select("k", "ck", "price", "ordered", F.explode(_steps(F.col("k"), F.col("n"))).alias("r"))
    place = int_div(F.col("k"), partitions)
    offset = (int_div(place, COHORT) * SLOTS + F.col("r.slot")) * COHORT + place % COHORT
    return base.select(
        "k",
        "ck",
        "price",
        "ordered",
        (F.col("k") % partitions).cast("int").alias("partition"),
        offset.alias("offset"),
        F.timestamp_millis(F.lit(START_MILLIS) + offset).alias("timestamp"),
        order_id_of(F.col("k")).alias("order_id"),
        F.col("r.kind").alias("kind"),
        F.col("r.s").alias("s"),
        F.col("r.ty").alias("ty"),
        F.col("r.slot").alias("slot"),
    )


def _payload(ty: Column, k: Column, ck: Column, price: Column, amount_shift: Column) -> Column:
    from eventfold.functions.validate import order_total

    items = lines(k, price)
    total = order_total(items)
    method = F.when(k % 3 == 0, "CARD").when(k % 3 == 1, "BKASH").otherwise("NAGAD")
    created = F.to_json(
        F.struct(
            F.concat(F.lit("cust-"), ck.cast("string")).alias("customer_id"),
            items.alias("items"),
            total.alias("total_amount"),
            F.struct(
                method.alias("method"),
                F.concat(F.lit("pay-"), k.cast("string")).alias("reference"),
                (total + amount_shift).alias("amount"),
            ).alias("payment"),
        )
    )
    shipped = F.to_json(
        F.struct(
            F.lit("Pathao").alias("carrier"),
            F.concat(F.lit("PT-"), k.cast("string")).alias("tracking_number"),
        )
    )
    return F.when(ty == "ORDER_CREATED", created).when(ty == "SHIPPED", shipped).otherwise(F.lit("{}"))


def encode(rows: DataFrame, topic: str = LIFECYCLE_TOPIC) -> DataFrame:
    """Typed rows to log records: key and value bytes, no headers."""
    c = F.col
    event_id = F.concat(
        F.lit("evt-"), c("k").cast("string"), F.lit("-"), c("s").cast("string"),
        F.when(c("slot") == 12, F.lit("-again")).otherwise(F.lit("")),
    )
    occurred = F.date_format(c("ordered") + F.make_dt_interval(hours=c("s").cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    sequence = F.when((c("k") % 13 == 4) & (c("s") == 3), F.concat(F.lit('"'), c("s").cast("string"), F.lit('"'))).otherwise(
        c("s").cast("string")
    )
    good = F.concat(
        F.lit('{"event_id":"'), event_id,
        F.lit('","order_id":"'), c("order_id"),
        F.lit('","sequence":'), sequence,
        F.lit(',"event_type":"'), c("ty"),
        F.lit('","occurred_at":"'), occurred,
        F.lit('","payload":'), _payload(c("ty"), c("k"), c("ck"), c("price"), F.lit(0)),
        F.lit("}"),
    )
    head = F.concat(F.lit('{"order_id":"'), c("order_id"), F.lit('",'))
    flaw = int_div(c("k"), 41) % 6
    bad = (
        F.when(flaw == 0, F.concat(head, F.lit('"this_field":"is not the schema"}')))
        .when(flaw == 1, F.concat(head, F.lit('"sequence":0,"event_type":"PACKED"}')))
        .when(flaw == 2, F.concat(head, F.lit('"sequence":1,"event_type":"PACKED"} trailing')))
        .when(
            flaw == 3,
            F.concat(
                head, F.lit('"sequence":1,"event_type":"ORDER_CREATED","payload":'),
                _payload(F.lit("ORDER_CREATED"), c("k"), c("ck"), c("price"), F.lit(1)), F.lit("}"),
            ),
        )
        .when(
            flaw == 4,
            F.concat(
                head,
                F.lit('"sequence":3,"event_type":"SHIPPED","payload":{"carrier":"","tracking_number":"PT-1"}}'),
            ),
        )
        .otherwise(F.concat(head, F.lit('"sequence":2,"event_type":"PACKED","payload":[]}')))
    )
    value = (
        F.when(c("kind") == "event", good)
        .when(c("kind") == "not_json", F.lit("this is not json at all }{"))
        .when(c("kind") == "bad_schema", bad)
    )
    return rows.select(
        F.lit(topic).alias("topic"),
        "partition",
        "offset",
        "timestamp",
        F.encode(c("order_id"), "UTF-8").alias("key"),
        F.encode(value, "UTF-8").alias("value"),
        F.when(c("kind") != "tombstone", _headers(c("k"), c("slot"))).alias("headers"),
    )


def _headers(k: Column, slot: Column) -> Column:
    """Some records arrive as later attempts; half of the repeats are meant for one service."""

    def head(when: Column, name: str, text: str):
        return F.when(when, F.struct(F.lit(name).alias("key"), F.encode(F.lit(text), "UTF-8").alias("value")))

    return F.array_compact(
        F.array(
            head(k % 10 == 3, H.ATTEMPT, "2"),
            head(k % 10 == 7, H.ATTEMPT, "3"),
            head(k % 10 == 9, H.ATTEMPT, "not a number"),
            head(slot.isin(3, 5, 7, 10) & (k % 2 == 0), H.RETRY_TARGET, "notification"),
        )
    )


def lifecycle_log(spark: SparkSession, sf_dir: str, partitions: int = PARTITIONS) -> DataFrame:
    if sf_dir in _TABLES:
        return spark.read.schema(LOG_SCHEMA).parquet(_TABLES[sf_dir])
    return encode(lifecycle_rows(spark, sf_dir, partitions))


def activity_log(spark: SparkSession, sf_dir: str, partitions: int = PARTITIONS) -> DataFrame:
    """The ``events`` table as a second keyed log: key is the user, offset the event id.

    ``purchase`` records with an even id have no value, which makes them tombstones.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    value = F.to_json(F.struct("event_id", "event_type", "value"))
    gone = (F.col("event_type") == "purchase") & (F.col("event_id") % 2 == 0)
    return e.select(
        F.lit("activity").alias("topic"),
        (F.col("user_id") % partitions).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.encode(F.concat(F.lit("user-"), F.col("user_id").cast("string")), "UTF-8").alias("key"),
        F.when(~gone, F.encode(value, "UTF-8")).alias("value"),
        F.lit(None).cast("array<struct<key:string,value:binary>>").alias("headers"),
    )


def fixture_outcome(order_id: Column, sequence: Column, service: Column, attempt: Column) -> tuple[Column, Column]:
    """Error class and message of the deterministic test handler (NULL when it succeeds)."""
    from eventfold.operators.failures import fail_lever

    n = order_number(order_id) + sequence
    poison_at = n % 47 == 0
    flaky_at = (n % 43 == 0) & ~poison_at & (service == "notification")
    p_class, p_text = fail_lever("poison", order_id, sequence, attempt, target=poison_at)
    t_class, t_text = fail_lever("transient", order_id, sequence, attempt, target=flaky_at, attempts=3)
    return F.coalesce(p_class, t_class), F.coalesce(p_text, t_text)


def fixture_handler(rows: DataFrame) -> DataFrame:
    """Handler in library form: adds ``error_class`` and ``error_message``."""
    error_class, error_message = fixture_outcome(
        F.col("order_id"), F.col("sequence"), F.col("service"), F.col("attempt")
    )
    return rows.withColumn("error_class", error_class).withColumn("error_message", error_message)


