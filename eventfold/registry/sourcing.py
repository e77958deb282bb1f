"""Runs of sources, positions and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventfold.functions import text as X
from eventfold.registry import register
from eventfold.registry.sql import cte, using
from eventfold.schemas import LIFECYCLE_TOPIC
from eventfold.session import work_dir
from eventfold.sources import generators as G
from eventfold.sources import logs as L
from eventfold.sources import offsets as P
from eventfold.sources import sinks as K
from eventfold.sources.order_log import START_MILLIS, activity_log, lifecycle_log

GROUPS = ("inventory-service", "notification-service", "analytics-service")
CUT = START_MILLIS + 40_000


def cut():
    return F.timestamp_millis(F.lit(CUT))


cte("bounds", 'SELECT p, min(off) AS low, max(off) + 1 AS high FROM log GROUP BY p', "log")
#: Inventory stands in the middle of each partition, notification a quarter in, analytics nowhere.
cte(
    "committed",
    """SELECT group_id, p, low + (high - low) // (CASE service WHEN 'inventory' THEN 2 ELSE 4 END) AS committed, low, high
    FROM bounds CROSS JOIN services WHERE service <> 'analytics'""",
    "bounds",
    "services",
)


def committed(spark, d):
    parts = F.array(
        F.struct(F.lit(GROUPS[0]).alias("group_id"), F.lit(2).alias("share")),
        F.struct(F.lit(GROUPS[1]).alias("group_id"), F.lit(4).alias("share")),
    )
    b = P.log_bounds(lifecycle_log(spark, d)).select("*", F.explode(parts).alias("g"))
    return b.select(
        "g.group_id", "topic", "partition",
        (F.col("low") + F.call_function("div", F.col("high") - F.col("low"), F.col("g.share").cast("bigint"))).alias("committed"),
    )


@register(
    "src_file_log",
    using(
        """SELECT p AS "partition", count(*) AS n, CAST(sum(off) AS BIGINT) AS offsets, count(*) FILTER (WHERE kind = 'tombstone') AS tombstones
        FROM log GROUP BY p""",
        "log",
    ),
)
def src_file_log(spark, d):
    path = work_dir(spark, "log")
    lifecycle_log(spark, d).write.parquet(path)
    return L.read_log(spark, path, LIFECYCLE_TOPIC).groupBy("partition").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("offset").alias("offsets"),
        F.count_if(F.col("value").isNull()).alias("tombstones"),
    )


@register(
    "log_bounds",
    using(
        """SELECT 'order-lifecycle' AS topic, p AS "partition", low, high FROM bounds
        UNION ALL SELECT 'activity', CAST(user_id % 3 AS INTEGER), min(event_id), max(event_id) + 1 FROM events GROUP BY user_id % 3""",
        "bounds",
    ),
)
def log_bounds(spark, d):
    return P.log_bounds(lifecycle_log(spark, d).unionByName(activity_log(spark, d)))


@register(
    "read_bounded",
    using(
        f"""SELECT log.p AS "partition", count(*) AS n, CAST(sum(off) AS BIGINT) AS offsets FROM log JOIN
        (SELECT p, min(off) AS low, max(off) + 1 AS high FROM log WHERE ms < {CUT} GROUP BY p) b ON log.p = b.p
        AND off >= low AND off < high GROUP BY log.p""",
        "log",
    ),
)
def read_bounded(spark, d):
    log = lifecycle_log(spark, d)
    bounds = P.fixed_bounds(log.where(F.col("timestamp") < cut()))
    return P.read_bounded(log, bounds).groupBy("partition").agg(
        F.count(F.lit(1)).alias("n"), F.sum("offset").alias("offsets")
    )


@register(
    "message_count",
    using("SELECT CAST(sum(high - low) AS BIGINT) AS messages FROM bounds", "bounds"),
)
def message_count(spark, d):
    return P.message_count(P.log_bounds(lifecycle_log(spark, d)))


@register(
    "read_partition_from",
    using(
        """SELECT p AS "partition", off AS "offset", order_id AS key_text FROM log
        WHERE p = 1 AND off >= (SELECT max(off) * 3 // 4 FROM log)""",
        "log",
    ),
)
def read_partition_from(spark, d):
    log = lifecycle_log(spark, d)
    start = (log.agg(F.max("offset")).first()[0] or 0) * 3 // 4
    rows = P.read_partition_from(log, LIFECYCLE_TOPIC, 1, start)
    return rows.select("partition", "offset", X.key_text(F.col("key")).alias("key_text"))


@register(
    "reset_offsets",
    using(
        f"""SELECT how, group_id, p AS "partition", committed, greatest(low, least(high, target)) AS new_offset FROM (
        SELECT 'earliest' AS how, *, low AS target FROM committed UNION ALL SELECT 'latest', *, high FROM committed
        UNION ALL SELECT 'shift', *, committed - 30000 FROM committed UNION ALL SELECT 'offset', *, 20000 FROM committed
        UNION ALL SELECT 'datetime', c.*, coalesce(t.off, high) FROM committed c LEFT JOIN
            (SELECT p, min(off) AS off FROM log WHERE ms >= {CUT} GROUP BY p) t ON c.p = t.p)""",
        "committed",
        "log",
    ),
)
def reset_offsets(spark, d):
    log, held = lifecycle_log(spark, d), committed(spark, d)
    runs = [("earliest", None), ("latest", None), ("shift", -30000), ("offset", 20000), ("datetime", cut())]
    out = None
    for how, value in runs:
        one = P.reset_offsets(held, log, to=how, value=value).select(
            F.lit(how).alias("how"), "group_id", "partition", "committed", "new_offset"
        )
        out = one if out is None else out.unionByName(one)
    return out


@register(
    "consumer_lag",
    using(
        """SELECT s.group_id, 'order-lifecycle' AS topic, b.p AS "partition", c.committed, b.high AS log_end,
        b.high - coalesce(c.committed, b.low) AS lag FROM bounds b CROSS JOIN services s
        LEFT JOIN committed c ON c.group_id = s.group_id AND c.p = b.p""",
        "committed",
    ),
)
def consumer_lag(spark, d):
    return P.consumer_lag(lifecycle_log(spark, d), committed(spark, d), GROUPS)


@register(
    "print_limit",
    using(
        """SELECT p AS "partition", off AS "offset", ms AS timestamp_ms, order_id AS key_text FROM log ORDER BY p, off LIMIT 50""",
        "log",
    ),
)
def print_limit(spark, d):
    return P.print_limit(lifecycle_log(spark, d), 50)


@register(
    "key_partition",
    using(
        """SELECT key_text, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(key_text) + 1),
        lambda i: CAST(ascii(substr(key_text, i, 1)) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
        lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), CAST(4294967295 AS BIGINT)) % 3 AS INTEGER) AS home
        FROM (SELECT DISTINCT order_id AS key_text FROM log)""",
        "log",
    ),
)
def key_partition(spark, d):
    return lifecycle_log(spark, d).select(
        X.key_text(F.col("key")).alias("key_text"), P.key_partition(F.col("key"), 3).alias("home")
    ).distinct()


def ids(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("i"))


@register(
    "sink_events_generated",
    """SELECT 'ord-' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS key_text, CAST(1 AS BIGINT) AS n FROM orders""",
)
def sink_events_generated(spark, d):
    """Written twice under one batch id, as after a retry; every record is there once."""
    path = work_dir(spark, "events")
    for _ in range(2):
        K.write_batch(K.event_records(G.gen_orders(ids(spark, d)), 3), path, 0)
    return spark.read.parquet(path).groupBy(X.key_text(F.col("key")).alias("key_text")).agg(
        F.count(F.lit(1)).alias("n")
    )


@register(
    "sink_tombstone",
    using(
        """SELECT 'order-snapshot' AS topic, order_id AS key_text, true AS empty FROM log WHERE kind = 'tombstone'""",
        "log",
    ),
)
def sink_tombstone(spark, d):
    gone = lifecycle_log(spark, d).where("value is null").select(X.key_text(F.col("key")).alias("order_id"))
    return K.tombstone_records(F.col("order_id"), gone, 3).select(
        "topic", X.key_text(F.col("key")).alias("key_text"), F.col("value").isNull().alias("empty")
    )
