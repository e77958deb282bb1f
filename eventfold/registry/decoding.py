"""Runs of decode, defaults, validation and typed views."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventfold.functions import text as X
from eventfold.functions import validate as V
from eventfold.lifecycle import ORDER_LIFECYCLE
from eventfold.operators import fold as FO
from eventfold.operators import routing as RT
from eventfold.operators.decode import parse_event
from eventfold.registry import register
from eventfold.registry.sql import cte, using
from eventfold.schemas import ITEMS_TYPE
from eventfold.sources.order_log import lifecycle_log


def decoded(spark, d, with_payload=True):
    return parse_event(lifecycle_log(spark, d), with_payload=with_payload)


def events(spark, d):
    return decoded(spark, d).where(~F.col("is_poison") & ~F.col("is_tombstone"))


cte("events_ok", "SELECT log.*, total FROM log JOIN totals USING (k) WHERE kind = 'event'", "log", "totals")


@register(
    "decode_event",
    using(
        """SELECT p AS "partition", off AS "offset", kind = 'tombstone' AS is_tombstone,
        kind IN ('not_json', 'bad_schema') AS is_poison, why, event_id,
        CASE WHEN kind = 'event' THEN order_id END AS order_id, s AS sequence, ty AS event_type,
        CASE WHEN kind = 'event' THEN epoch_ms(ordered) + s * 3600000 END AS occurred_ms FROM reasons""",
        "reasons",
    ),
)
def decode_event(spark, d):
    return decoded(spark, d, with_payload=False).select(
        "partition", "offset", "is_tombstone", "is_poison", F.array_join("reasons", ", ").alias("why"),
        "event_id", "order_id", "sequence", "event_type", F.unix_millis("occurred_at").alias("occurred_ms"),
    )


@register(
    "validate_event",
    using("SELECT why, count(*) AS n FROM reasons WHERE kind <> 'tombstone' GROUP BY why", "reasons"),
)
def validate_event(spark, d):
    rows = decoded(spark, d, with_payload=False).where(~F.col("is_tombstone"))
    return rows.groupBy(F.array_join("reasons", ", ").alias("why")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "event_defaults",
    using(
        """SELECT p AS "partition", off AS "offset",
        sha256('order-lifecycle/' || p || '/' || off) AS event_id, ms AS occurred_ms,
        CASE WHEN ty IN ('PACKED', 'DELIVERED') THEN '{}' ELSE 'given' END AS payload
        FROM log WHERE kind = 'event'""",
        "log",
    ),
)
def event_defaults(spark, d):
    """Events stripped to their required fields get an id, a time and, where none is required, an empty payload."""
    log = lifecycle_log(spark, d)
    whole = parse_event(log.withColumn("body", F.col("value")), with_payload=False).where(F.col("event_type").isNotNull())
    needed = F.when(F.col("event_type").isin("ORDER_CREATED", "SHIPPED"), F.get_json_object(F.col("body").cast("string"), "$.payload"))
    head = F.to_json(F.struct("order_id", "sequence", "event_type"))
    text = F.when(needed.isNull(), head).otherwise(F.concat(F.rtrim(head, F.lit("}")), F.lit(',"payload":'), needed, F.lit("}")))
    bare = whole.withColumn("value", F.encode(text, "UTF-8")).select(*log.columns)
    payload = F.to_json("payload")
    return parse_event(bare).select(
        "partition", "offset", "event_id", F.unix_millis("occurred_at").alias("occurred_ms"),
        F.when(payload == "{}", payload).when(payload.isNotNull(), F.lit("given")).alias("payload"),
    )


@register(
    "validate_created",
    using(
        """SELECT o_orderkey AS k, why FROM (SELECT o_orderkey, CASE o_orderkey % 9
        WHEN 0 THEN 'customer_id' WHEN 1 THEN 'items' WHEN 2 THEN 'item' WHEN 3 THEN 'item' WHEN 4 THEN 'payment'
        WHEN 5 THEN 'payment' WHEN 6 THEN 'total_mismatch' WHEN 7 THEN 'payment_mismatch' ELSE '' END AS why FROM orders)""",
        "base",
    ),
)
def validate_created(spark, d):
    k, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("bigint")
    flaw = k % 9
    item = F.struct(
        F.when(flaw == 2, F.lit("")).otherwise(F.lit("PEN")).alias("sku"),
        F.when(flaw == 3, F.lit(0)).otherwise(2).cast("bigint").alias("qty"),
        price.alias("unit_price"),
    )
    items = F.when(flaw != 1, F.array(item)).otherwise(F.array().cast(ITEMS_TYPE))
    created = F.struct(
        F.when(flaw == 0, F.lit("")).otherwise(F.lit("cust")).alias("customer_id"),
        items.alias("items"),
        (price * 2 + (flaw == 6).cast("int")).alias("total_amount"),
        F.struct(
            F.when(flaw == 4, F.lit("CASH")).otherwise(F.lit("CARD")).alias("method"),
            F.lit("pay").alias("reference"),
            F.when(flaw == 5, F.lit(-1)).otherwise(price * 2 + (flaw == 7).cast("int")).alias("amount"),
        ).alias("payment"),
    )
    orders = spark.read.parquet(f"{d}/orders.parquet").select(k.alias("k"), created.alias("created"))
    return orders.select("k", F.array_join(V.created_reasons(F.col("created")), ", ").alias("why"))


@register(
    "validate_shipped",
    using(
        """SELECT l_orderkey, l_linenumber, why, count(*) AS n FROM (SELECT l_orderkey, l_linenumber,
        CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'carrier, tracking_number' WHEN l_returnflag = 'A' THEN 'carrier'
        WHEN l_linestatus = 'F' THEN 'tracking_number' ELSE '' END AS why FROM lineitem) GROUP BY 1, 2, 3""",
        "base",
    ),
)
def validate_shipped(spark, d):
    shipped = F.struct(
        F.when(F.col("l_returnflag") == "A", F.lit("")).otherwise(F.col("l_returnflag")).alias("carrier"),
        F.when(F.col("l_linestatus") != "F", F.col("l_linestatus")).alias("tracking_number"),
    )
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", F.array_join(V.shipped_reasons(shipped), ", ").alias("why")
    )
    return lines.groupBy("l_orderkey", "l_linenumber", "why").agg(F.count(F.lit(1)).alias("n"))


@register(
    "validate_payload",
    using(
        """SELECT e.event_id, CASE e.event_id % 4 WHEN 0 THEN 'customer_id, items, total_amount, payment'
        WHEN 2 THEN 'carrier, tracking_number' ELSE '' END AS why FROM events e""",
        "base",
    ),
)
def validate_payload(spark, d):
    """The ``props`` of an activity record offered as the payload of each event type in turn."""
    kinds = F.array(*[F.lit(t) for t in ORDER_LIFECYCLE.event_types])
    e = spark.read.parquet(f"{d}/events.parquet").select(
        "event_id",
        F.get(kinds, (F.col("event_id") % 4).cast("int")).alias("event_type"),
        F.try_parse_json("props").alias("payload"),
    )
    return e.select(
        "event_id",
        F.array_join(V.command_payload_reasons(F.col("event_type"), F.col("payload")), ", ").alias("why"),
    )


@register(
    "as_order_created",
    using(
        """SELECT e.p AS "partition", e.off AS "offset", e.order_id, 'cust-' || e.ck AS customer_id, total AS total_amount,
        CASE e.k % 3 WHEN 0 THEN 'CARD' WHEN 1 THEN 'BKASH' ELSE 'NAGAD' END AS method, 'pay-' || e.k AS reference,
        e.k % 3 + 1 AS items FROM events_ok e WHERE ty = 'ORDER_CREATED'""",
        "events_ok",
    ),
)
def as_order_created(spark, d):
    return events(spark, d).where("event_type = 'ORDER_CREATED'").select(
        "partition", "offset", "order_id", "created.customer_id", "created.total_amount",
        "created.payment.method", "created.payment.reference",
        F.size("created.items").cast("bigint").alias("items"),
    )


@register(
    "as_shipped",
    using(
        """SELECT p AS "partition", off AS "offset", order_id, 'Pathao' AS carrier, 'PT-' || k AS tracking_number
        FROM log WHERE kind = 'event' AND ty = 'SHIPPED'""",
        "log",
    ),
)
def as_shipped(spark, d):
    return events(spark, d).where("event_type = 'SHIPPED'").select(
        "partition", "offset", "order_id", "shipped.carrier", "shipped.tracking_number"
    )


@register(
    "line_total",
    """SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT) * CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS line_total,
    count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def line_total(spark, d):
    item = F.struct(
        F.col("l_quantity").cast("bigint").alias("qty"), F.floor("l_extendedprice").cast("bigint").alias("unit_price")
    )
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", item.alias("item")
    ).select("l_orderkey", "l_linenumber", V.line_total(F.col("item")).alias("t"))
    return lines.groupBy("l_orderkey", "l_linenumber").agg(
        F.sum("t").alias("line_total"), F.count(F.lit(1)).alias("n")
    )


@register(
    "order_total",
    using(
        """SELECT p AS "partition", off AS "offset", total AS order_total FROM events_ok WHERE ty = 'ORDER_CREATED'""",
        "events_ok",
    ),
)
def order_total(spark, d):
    return events(spark, d).where("event_type = 'ORDER_CREATED'").select(
        "partition", "offset", V.order_total(F.col("created.items")).alias("order_total")
    )


_PAIRS = """(VALUES ('ORDER_CREATED', NULL, 'CREATED'), ('PACKED', 'CREATED', 'PACKED'), ('SHIPPED', 'PACKED', 'SHIPPED'),
    ('DELIVERED', 'SHIPPED', 'DELIVERED')) AS t(event_type, predecessor, leads_to)"""


def _pairs(spark, d):
    """Every order status paired with an event type picked by the order key."""
    k = F.col("o_orderkey")
    kinds = F.array(*[F.lit(t) for t in ORDER_LIFECYCLE.event_types])
    states = F.array(F.lit(None).cast("string"), *[F.lit(s) for s in ORDER_LIFECYCLE.states])
    return spark.read.parquet(f"{d}/orders.parquet").select(
        k.alias("k"),
        F.get(kinds, (k % 4).cast("int")).alias("event_type"),
        F.get(states, (k % 5).cast("int")).alias("state"),
    )


cte(
    "pairs",
    """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'ORDER_CREATED' WHEN 1 THEN 'PACKED' WHEN 2 THEN 'SHIPPED' ELSE 'DELIVERED' END AS event_type,
    CASE o_orderkey % 5 WHEN 1 THEN 'CREATED' WHEN 2 THEN 'PACKED' WHEN 3 THEN 'SHIPPED' WHEN 4 THEN 'DELIVERED' END AS state FROM orders""",
)


@register(
    "legal_transition",
    using(
        f"""SELECT pairs.event_type, pairs.state, predecessor IS NOT DISTINCT FROM state AS legal, count(*) AS n
        FROM pairs JOIN {_PAIRS} ON pairs.event_type = t.event_type GROUP BY 1, 2, 3""",
        "pairs",
    ),
)
def legal_transition(spark, d):
    legal = ORDER_LIFECYCLE.is_legal(F.col("event_type"), F.col("state"))
    return _pairs(spark, d).groupBy("event_type", "state", legal.alias("legal")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "expected_next",
    using(
        f"""SELECT pairs.state, coalesce(t.event_type, 'nothing (lifecycle complete)') AS expected, count(*) AS n
        FROM pairs LEFT JOIN {_PAIRS} ON t.predecessor IS NOT DISTINCT FROM pairs.state GROUP BY 1, 2""",
        "pairs",
    ),
)
def expected_next(spark, d):
    return _pairs(spark, d).groupBy(
        "state", ORDER_LIFECYCLE.expected_text(F.col("state")).alias("expected")
    ).agg(F.count(F.lit(1)).alias("n"))


@register(
    "route_branch",
    using(
        """SELECT service, CASE WHEN kind = 'tombstone' THEN 'tombstone' WHEN target IS NOT NULL AND target <> service THEN 'not_ours'
        WHEN kind IN ('not_json', 'bad_schema') THEN 'poison' ELSE 'event' END AS route, p AS "partition", count(*) AS n
        FROM log CROSS JOIN services GROUP BY 1, 2, 3""",
        "log",
        "services",
    ),
)
def route_branch(spark, d):
    return RT.route(decoded(spark, d, with_payload=False)).groupBy("service", "route", "partition").agg(
        F.count(F.lit(1)).alias("n")
    )


@register(
    "key_text",
    """SELECT key_text, count(*) AS n FROM (SELECT CASE WHEN user_id % 10 = 0 THEN '<null>' WHEN user_id % 10 = 1
    THEN '<undecodable-key>' ELSE 'user-' || user_id END AS key_text FROM events) GROUP BY 1""",
)
def key_text(spark, d):
    u = F.col("user_id")
    key = F.when(u % 10 == 1, F.unhex(F.lit("FF"))).when(
        u % 10 != 0, F.encode(F.concat(F.lit("user-"), u.cast("string")), "UTF-8")
    )
    keyed = spark.read.parquet(f"{d}/events.parquet").select(key.alias("key"))
    return keyed.groupBy(X.key_text(F.col("key")).alias("key_text")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "message_ts_iso",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END AS shown FROM events""",
)
def message_ts_iso(spark, d):
    from eventfold.functions.headers import message_ts_iso as shown

    e = spark.read.parquet(f"{d}/events.parquet")
    ts = F.when(F.col("event_id") % 5 != 0, F.col("ts").cast("timestamp"))
    return e.select("event_id", shown(ts).alias("shown"))


@register(
    "fold_codec",
    using(
        """SELECT group_id, order_id, last_sequence, state, last_event_id, handled_count,
        '{"last_sequence":' || last_sequence || ',"state":"' || state || '","last_event_id":"' || last_event_id
        || '","handled_count":' || handled_count || '}' AS stored FROM g_fold""",
        "g_fold",
    ),
)
def fold_codec(spark, d):
    from eventfold.registry.folding import folds

    c = F.col
    stored = folds(spark, d).select(
        "group_id", "order_id",
        FO.encode_fold(c("last_sequence"), c("state"), c("last_event_id"), c("handled_count")).alias("stored"),
    )
    return stored.withColumn("f", FO.decode_fold(c("stored"))).select("group_id", "order_id", "f.*", "stored")


@register(
    "order_id",
    "SELECT o_orderkey AS cmd_id, 'ord-' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 12) AS order_id FROM orders",
)
def order_id(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("cmd_id"), X.new_order_id(F.col("o_orderkey")).alias("order_id"))


@register(
    "event_id",
    using(
        """SELECT p AS "partition", off AS "offset", sha256('order-lifecycle/' || p || '/' || off) AS event_id FROM log""",
        "log",
    ),
)
def event_id(spark, d):
    log = lifecycle_log(spark, d)
    made = X.new_event_id(F.col("topic"), F.col("partition"), F.col("offset"))
    return log.select("partition", "offset", made.alias("event_id"))


@register(
    "target_orders",
    using(
        """SELECT order_id, count(*) AS n FROM log WHERE kind = 'event' AND order_id IN
        ('ord-000000000005', 'ord-000000000043', 'ord-000000000081') GROUP BY 1""",
        "log",
    ),
)
def target_orders(spark, d):
    listed = "ord-000000000005, ord-000000000043,ord-000000000081,"
    aimed = decoded(spark, d, with_payload=False).where(X.target_orders(F.col("order_id"), listed))
    return aimed.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
