"""Runs of the command side. Commands come from orders and their line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventfold.functions import text as X
from eventfold.lifecycle import ORDER_LIFECYCLE
from eventfold.operators import commands as O
from eventfold.operators.decode import parse_event
from eventfold.operators.guarded import guard_any
from eventfold.operators.publishing import RECORD, creation_payloads, publish_results
from eventfold.registry import register
from eventfold.registry.sql import cte, using
from eventfold.schemas import ITEMS_TYPE, LIFECYCLE_TOPIC, PAYMENT_TYPE, SNAPSHOT_TOPIC
from eventfold.session import work_dir, written
from eventfold.sources.order_log import dealt, order_id_of
from eventfold.sources.outbox import Outbox


def _orders(spark, d):
    k = F.col("o_orderkey")
    n = F.when(F.col("o_orderstatus") == "F", 4).when(F.col("o_orderstatus") == "P", 3).otherwise(1 + k % 2)
    return spark.read.parquet(f"{d}/orders.parquet").select(
        k.alias("k"), n.alias("n"), F.col("o_custkey").alias("ck")
    )


def lines(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select(
        (F.col("l_orderkey") * 16 + 1).alias("cmd_id"),
        F.concat(F.lit("P-"), F.col("l_partkey").cast("string")).alias("sku"),
        F.col("l_quantity").cast("bigint").alias("qty"),
        F.floor("l_extendedprice").cast("bigint").alias("unit_price"),
    )


def creates(spark, d):
    """Creation requests. The amount paid is the sum of the lines, off by one now and then."""
    paid = lines(spark, d).groupBy("cmd_id").agg(F.sum(F.col("qty") * F.col("unit_price")).alias("paid"))
    k = F.col("k")
    headers = (
        _orders(spark, d)
        .withColumn("cmd_id", k * 16 + 1)
        .join(paid, "cmd_id", "left")
        .select(
            "cmd_id", "k",
            F.lit("create").alias("kind"),
            order_id_of(k).alias("order_id"),
            F.when(k % 97 == 0, F.lit("")).otherwise(F.concat(F.lit("cust-"), F.col("ck").cast("string"))).alias("customer_id"),
            F.when(k % 89 == 0, F.lit("CASH")).otherwise(F.lit("CARD")).alias("method"),
            F.concat(F.lit("pay-"), k.cast("string")).alias("reference"),
            (F.coalesce("paid", F.lit(0)) + (k % 101 == 0).cast("bigint")).alias("amount"),
        )
    )
    return O.check_creates(headers, lines(spark, d))


def commands(spark, d, made=None):
    """Requests of every kind; ``made`` are the creations, where they are worked out already."""
    k, n = F.col("k"), F.col("n")

    def cmd(when, slot, kind, event_type=None, force=None, unknown=False, bad=None):
        return F.when(
            when,
            F.struct(
                F.lit(slot).cast("bigint").alias("slot"),
                F.lit(kind).alias("kind"),
                F.lit(event_type).cast("string").alias("event_type"),
                (F.lit(False) if force is None else force).alias("force"),
                F.lit(unknown).alias("unknown"),
                (F.lit(False) if bad is None else bad).alias("bad"),
            ),
        )

    forced = k % 23 == 7
    later = F.array_compact(
        F.array(
            cmd((n >= 2) & (k % 17 != 3) & ~forced, 2, "advance", "PACKED"),
            cmd((n >= 2) & (k % 17 != 3) & forced, 2, "advance", "DELIVERED", F.lit(True)),
            cmd(n >= 3, 3, "advance", "SHIPPED", bad=k % 43 == 0),
            cmd(n >= 4, 4, "advance", "DELIVERED"),
            cmd(k % 19 == 5, 5, "advance", "PACKED"),
            cmd(k % 37 == 17, 6, "delete"),
            cmd(k % 37 == 17, 7, "advance", "DELIVERED"),
            cmd(k % 74 == 17, 8, "delete"),
            cmd(k % 61 == 9, 9, "advance", "PACKED", unknown=True),
        )
    )
    rest = dealt(_orders(spark, d).select("k", "n"), "k").select("k", F.explode(later).alias("c")).select(
        (k * 16 + F.col("c.slot")).alias("cmd_id"),
        "k",
        "c.kind",
        F.when(F.col("c.unknown"), F.concat(F.lit("ord-unknown-"), k.cast("string"))).otherwise(order_id_of(k)).alias("order_id"),
        "c.event_type",
        "c.force",
        F.lit(None).cast("boolean").alias("payload_ok"),
        F.lit(None).cast("string").alias("payload_reason"),
        # a shipment names its carrier, but for some; other steps take any object
        F.when(
            F.col("c.event_type") == "SHIPPED",
            F.to_json(F.struct(F.when(F.col("c.bad"), "").otherwise("Pathao").alias("carrier"), F.concat(F.lit("PT-"), F.col("k")).alias("tracking_number"))),
        ).otherwise(F.lit("{}")).alias("payload"),
    )
    first = (creates(spark, d) if made is None else made).select(
        "cmd_id", "k", "kind", "order_id", F.lit(None).cast("string").alias("event_type"), F.lit(False).alias("force"),
        "payload_ok", "payload_reason", F.lit(None).cast("string").alias("payload"),
    )
    both = first.unionByName(rest)
    publish_ok = (F.col("k") + F.col("cmd_id") % 16) % 53 != 0
    return both.withColumn("publish_ok", publish_ok).drop("k")


cte(
    "cline",
    """SELECT l_orderkey AS k, CAST(sum(CAST(l_quantity AS BIGINT) * CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS total
    FROM lineitem GROUP BY 1""",
)
cte(
    "creates",
    """SELECT base.k, base.k * 16 + 1 AS cmd_id, total, coalesce(total, 0) + CASE WHEN base.k % 101 = 0 THEN 1 ELSE 0 END AS amount,
    CASE WHEN base.k % 97 = 0 THEN 'customer_id is empty' WHEN total IS NULL THEN 'items is empty'
    WHEN base.k % 89 = 0 THEN 'payment is invalid'
    WHEN base.k % 101 = 0 THEN 'payment.amount ' || (total + 1) || ' does not equal total_amount ' || total END AS why
    FROM base LEFT JOIN cline ON base.k = cline.k""",
    "base",
    "cline",
)
cte(
    "cmds",
    """SELECT k, cmd_id, kind, order_id, event_type, force, payload_reason, (k + cmd_id % 16) % 53 <> 0 AS publish_ok,
    row_number() OVER (PARTITION BY order_id ORDER BY cmd_id) AS rn FROM (
    SELECT k, cmd_id, 'create' AS kind, 'ord-' || lpad(CAST(k AS VARCHAR), 12, '0') AS order_id, CAST(NULL AS VARCHAR) AS event_type, false AS force, why AS payload_reason FROM creates
    UNION ALL SELECT k, k * 16 + slot, kind, CASE WHEN slot = 9 THEN 'ord-unknown-' || k ELSE 'ord-' || lpad(CAST(k AS VARCHAR), 12, '0') END, ty, force, bad FROM (
    SELECT k, 2 AS slot, 'advance' AS kind, CASE WHEN k % 23 = 7 THEN 'DELIVERED' ELSE 'PACKED' END AS ty, k % 23 = 7 AS force, CAST(NULL AS VARCHAR) AS bad FROM base WHERE n >= 2 AND k % 17 <> 3
    UNION ALL SELECT k, 3, 'advance', 'SHIPPED', false, CASE WHEN k % 43 = 0 THEN 'carrier is empty' END FROM base WHERE n >= 3
    UNION ALL SELECT k, 4, 'advance', 'DELIVERED', false, NULL FROM base WHERE n >= 4
    UNION ALL SELECT k, 5, 'advance', 'PACKED', false, NULL FROM base WHERE k % 19 = 5
    UNION ALL SELECT k, 6, 'delete', NULL, false, NULL FROM base WHERE k % 37 = 17
    UNION ALL SELECT k, 7, 'advance', 'DELIVERED', false, NULL FROM base WHERE k % 37 = 17
    UNION ALL SELECT k, 8, 'delete', NULL, false, NULL FROM base WHERE k % 74 = 17
    UNION ALL SELECT k, 9, 'advance', 'PACKED', false, NULL FROM base WHERE k % 61 = 9))""",
    "base",
    "creates",
)

_STEP = """CASE c.event_type WHEN 'PACKED' THEN 2 WHEN 'SHIPPED' THEN 3 WHEN 'DELIVERED' THEN 4 END = {rank} + 1"""


def _transition(rank: str, seq: str) -> str:
    """One step of the guard in SQL, from the rank (0 = no order) and last sequence before it."""
    legal = _STEP.format(rank=rank)
    status = f"""CASE WHEN c.kind = 'create' THEN CASE WHEN c.payload_reason IS NOT NULL THEN 422 WHEN c.publish_ok THEN 201 ELSE 502 END
        WHEN {rank} = 0 THEN 404
        WHEN c.kind = 'delete' THEN CASE WHEN c.publish_ok THEN 204 ELSE 502 END
        WHEN c.payload_reason IS NOT NULL THEN 422 WHEN NOT c.force AND NOT {legal} THEN 409
        WHEN c.publish_ok THEN 200 ELSE 502 END"""
    took = f"c.kind = 'advance' AND {rank} > 0 AND c.payload_reason IS NULL AND (c.force OR {legal})"
    return f"""c.order_id, c.rn, c.cmd_id, c.kind, c.event_type, c.force, c.payload_reason, {rank} AS before_rank,
        {status} AS status,
        CASE WHEN c.kind = 'create' AND c.payload_reason IS NULL AND c.publish_ok THEN 1 WHEN {took} THEN {seq} + 1 END AS sequence,
        CASE WHEN c.kind = 'create' AND c.payload_reason IS NULL AND c.publish_ok THEN 1
             WHEN c.kind = 'delete' AND {rank} > 0 AND c.publish_ok THEN 0
             WHEN {took} AND c.publish_ok AND {legal} THEN {rank} + 1 ELSE {rank} END AS rank,
        CASE WHEN c.kind = 'create' AND c.payload_reason IS NULL AND c.publish_ok THEN 1 WHEN {took} THEN {seq} + 1 ELSE {seq} END AS last_seq"""


_NAME = "CASE {r} WHEN 1 THEN 'CREATED' WHEN 2 THEN 'PACKED' WHEN 3 THEN 'SHIPPED' WHEN 4 THEN 'DELIVERED' END"
_NEXT = "CASE {r} WHEN 1 THEN 'PACKED' WHEN 2 THEN 'SHIPPED' WHEN 3 THEN 'DELIVERED' END"


def guarded(query: str) -> str:
    walk = f"""walk AS (SELECT {_transition('0', '0')} FROM cmds c WHERE rn = 1
    UNION ALL SELECT {_transition('w.rank', 'w.last_seq')} FROM walk w JOIN cmds c ON c.order_id = w.order_id AND c.rn = w.rn + 1),
    res AS (SELECT cmd_id, kind, order_id, event_type, force, status, CAST(sequence AS BIGINT) AS sequence,
    {_NAME.format(r='before_rank')} AS state_before, {_NAME.format(r='rank')} AS state_after, before_rank, rank, rn, last_seq,
    CASE status WHEN 404 THEN 'no order ' || order_id WHEN 422 THEN payload_reason WHEN 502 THEN 'publish failed'
    WHEN 409 THEN CASE WHEN before_rank = 4 THEN 'order ' || order_id || ' is DELIVERED and its lifecycle is complete; ' || event_type || ' cannot follow'
    ELSE 'order ' || order_id || ' is ' || {_NAME.format(r='before_rank')} || '; expected ' || {_NEXT.format(r='before_rank')} || ' but got ' || event_type END END AS reason
    FROM walk)"""
    return using("", "cmds").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + walk + "\n" + query


def results(spark, d):
    return O.guard(commands(spark, d))


@register("guard_hot", guarded("SELECT cmd_id, status, sequence, state_before, state_after, reason FROM res"))
def guard_hot(spark, d):
    """The guard with orders of more than eight commands taken as hot."""
    return O.guard(commands(spark, d), block_rows=8).select(
        "cmd_id", "status", "sequence", "state_before", "state_after", "reason"
    )


@register(
    "create_order",
    using(
        """SELECT cmd_id, 'ord-' || lpad(CAST(k AS VARCHAR), 12, '0') AS order_id, total AS total_amount, why IS NULL AS accepted, why AS reason FROM creates""",
        "creates",
    ),
)
def create_order(spark, d):
    return creates(spark, d).select(
        "cmd_id", "order_id", "total_amount", F.col("payload_ok").alias("accepted"), F.col("payload_reason").alias("reason")
    )


@register(
    "guard_transition",
    guarded(
        "SELECT cmd_id, kind, order_id, event_type, status, sequence, state_before, state_after FROM res"
    ),
)
def guard_transition(spark, d):
    return results(spark, d).select(
        "cmd_id", "kind", "order_id", "event_type", "status", "sequence", "state_before", "state_after"
    )


@register(
    "accepted_events",
    guarded(
        """SELECT cmd_id, order_id, sequence, CASE kind WHEN 'create' THEN 'ORDER_CREATED' ELSE event_type END AS event_type, state_after,
        force AS forced FROM res WHERE status IN (200, 201)"""
    ),
)
def accepted_events(spark, d):
    return O.accepted_events(results(spark, d))


@register(
    "burned_sequence",
    guarded("SELECT cmd_id, order_id, sequence, event_type, state_after FROM res WHERE status = 502 AND sequence IS NOT NULL"),
)
def burned_sequence(spark, d):
    return O.burned_sequences(results(spark, d))


@register("delete_order", guarded("SELECT cmd_id, order_id, state_before FROM res WHERE status = 204"))
def delete_order(spark, d):
    return O.deletes(results(spark, d))


@register("rejections", guarded("SELECT cmd_id, kind, order_id, status, reason FROM res WHERE status >= 400"))
def rejections(spark, d):
    return O.rejections(results(spark, d))


_ORDERS = f"""SELECT order_id, {_NAME.format(r='rank')} AS state, CAST(last_seq AS BIGINT) AS last_sequence, {_NEXT.format(r='rank')} AS expected_next_event
    FROM res QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY rn DESC) = 1 AND rank > 0"""


@register("orders_after", guarded(_ORDERS))
def orders_after(spark, d):
    return O.orders_after(results(spark, d))


@register(
    "guard_composed",
    guarded("SELECT cmd_id, kind, order_id, event_type, status, sequence, state_before, state_after FROM res"),
)
def guard_composed(spark, d):
    """The guard for any lifecycle, by composed maps, with orders of more than eight commands as hot."""
    return guard_any(commands(spark, d), ORDER_LIFECYCLE, block_rows=8)


def published(spark, d):
    """One run of the guard, published twice under one batch id, as after a retry; the second finds the batch committed."""
    box, made = Outbox(spark, work_dir(spark, "outbox")), written(creates(spark, d), "creates")
    asked = written(commands(spark, d, made), "asked")
    results = O.guard(asked)
    for _ in range(2):
        publish_results(box, 0, results, creation_payloads(made, lines(spark, d)), asked.where("kind = 'advance'").select("cmd_id", "payload"), 3)
    return box


@register(
    "sink_events",
    guarded(
        """SELECT 'evt-' || res.cmd_id AS event_id, res.order_id, sequence, CASE kind WHEN 'create' THEN 'ORDER_CREATED' ELSE event_type END AS event_type,
        CASE kind WHEN 'create' THEN 'cust-' || ck END AS customer_id, CASE kind WHEN 'create' THEN total END AS total_amount,
        CASE kind WHEN 'create' THEN lines END AS items, CASE event_type WHEN 'SHIPPED' THEN 'PT-' || base.k END AS tracking_number
        FROM res JOIN base ON base.k = res.cmd_id // 16 LEFT JOIN cline ON cline.k = base.k
        LEFT JOIN (SELECT l_orderkey AS k, count(*) AS lines FROM lineitem GROUP BY 1) n ON n.k = base.k WHERE status IN (200, 201)"""
    ),
)
def sink_events(spark, d):
    """Accepted events with their payload, decoded from what was published."""
    log = published(spark, d).read(LIFECYCLE_TOPIC, RECORD).withColumn("offset", F.lit(0)).withColumn("timestamp", F.lit(None).cast("timestamp"))
    return parse_event(log).select(
        "event_id", "order_id", "sequence", "event_type", "created.customer_id", "created.total_amount",
        F.when(F.col("event_type") == "ORDER_CREATED", F.size("created.items")).cast("bigint").alias("items"), "shipped.tracking_number",
    )


@register(
    "sink_snapshot",
    guarded(
        f"""SELECT 'order-snapshot' AS topic, o.order_id, 'cust-' || ck AS customer_id, state, last_sequence, total AS total_amount, 'CARD' AS method,
        'pay-' || base.k AS reference, total AS amount, lines AS items, expected_next_event
        FROM ({_ORDERS}) o JOIN base ON o.order_id = 'ord-' || lpad(CAST(base.k AS VARCHAR), 12, '0') JOIN cline USING (k)
        JOIN (SELECT l_orderkey AS k, count(*) AS lines FROM lineitem GROUP BY 1) n USING (k)"""
    ),
)
def sink_snapshot(spark, d):
    """One whole snapshot per live order, read back from the compacted log."""
    back = published(spark, d).read(SNAPSHOT_TOPIC, RECORD)
    shape = f"order_id string, customer_id string, state string, last_sequence bigint, total_amount bigint, payment {PAYMENT_TYPE}, items {ITEMS_TYPE}, expected_next_event string"
    return back.select("topic", F.from_json(F.col("value").cast("string"), shape).alias("v")).select(
        "topic", "v.order_id", "v.customer_id", "v.state", "v.last_sequence", "v.total_amount", "v.payment.method", "v.payment.reference",
        "v.payment.amount", F.size("v.items").cast("bigint").alias("items"), "v.expected_next_event",
    )


@register("sink_deletes", guarded("SELECT 'order-snapshot' AS topic, order_id AS key_text, true AS empty FROM res WHERE status = 204"))
def sink_deletes(spark, d):
    """The tombstones of the same batch."""
    gone = published(spark, d).read(f"{SNAPSHOT_TOPIC}-deletes", RECORD)
    return gone.select("topic", X.key_text(F.col("key")).alias("key_text"), F.col("value").isNull().alias("empty"))
