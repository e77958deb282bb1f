"""Runs of the observability questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventfold.operators import fold as FO
from eventfold.operators import observe as O
from eventfold.operators.services import DEFAULT_SERVICES
from eventfold.registry import register
from eventfold.registry.folding import folds, hist
from eventfold.registry.sql import cte, using
from eventfold.sources.order_log import activity_log, lifecycle_log


def scattered(spark, d):
    """The activity log with some records of every seventh user put on the next partition."""
    log = activity_log(spark, d)
    user = F.substring(F.col("key").cast("string"), 6, 20).cast("bigint")
    moved = (user % 7 == 0) & (F.col("offset") % 2 == 0)
    return log.withColumn(
        "partition", F.when(moved, (F.col("partition") + 1) % 3).otherwise(F.col("partition")).cast("int")
    )


@register(
    "key_single_partition",
    """SELECT 'activity' AS topic, 'user-' || user_id AS key_text, CAST(min(p) AS INTEGER) AS first_partition, CAST(max(p) AS INTEGER) AS last_partition
    FROM (SELECT user_id, CASE WHEN user_id % 7 = 0 AND event_id % 2 = 0 THEN (user_id % 3 + 1) % 3 ELSE user_id % 3 END AS p FROM events)
    GROUP BY user_id HAVING min(p) <> max(p)""",
)
def key_single_partition(spark, d):
    return O.keys_on_many_partitions(scattered(spark, d).unionByName(lifecycle_log(spark, d)))


@register(
    "partition_skew",
    using(
        """SELECT 'order-lifecycle' AS topic, p AS "partition", CAST(count(*) AS BIGINT) AS records, count(DISTINCT k) AS keys FROM log GROUP BY p
        UNION ALL SELECT 'activity', CAST(user_id % 3 AS INTEGER), count(*), count(DISTINCT user_id) FROM events GROUP BY user_id % 3""",
        "log",
    ),
)
def partition_skew(spark, d):
    return O.partition_skew(lifecycle_log(spark, d).unionByName(activity_log(spark, d)))


@register(
    "in_sequence",
    using(
        """SELECT group_id, order_id, CAST(count(*) AS BIGINT) AS handled FROM (SELECT *, row_number() OVER (PARTITION BY group_id, k, epoch ORDER BY off) AS i
        FROM g_judged WHERE ok) GROUP BY group_id, order_id HAVING bool_and(i = s)""",
        "g_judged",
    ),
)
def in_sequence(spark, d):
    return O.in_sequence(FO.judge(hist(spark, d)))


@register(
    "gapped_orders",
    using(
        """SELECT group_id, CAST(count(DISTINCT k) FILTER (WHERE seq_gap) AS BIGINT) AS gapped, count(DISTINCT k) AS orders FROM g_judged GROUP BY 1""",
        "g_judged",
    ),
)
def gapped_orders(spark, d):
    return O.gapped_orders(FO.judge(hist(spark, d)))


@register(
    "violation_counts",
    using("SELECT group_id, type, count(*) AS n FROM g_viol GROUP BY 1, 2", "g_viol"),
)
def violation_counts(spark, d):
    return O.violation_counts(FO.violations(FO.judge(hist(spark, d))))


cte(
    "plain",
    "SELECT log.*, group_id, service FROM log CROSS JOIN services WHERE kind = 'event' AND (target IS NULL OR target = service)",
    "log",
    "services",
)


@register(
    "replay_is_noop",
    using(
        """SELECT group_id, CAST(0 AS BIGINT) AS folds_changed, CAST(0 AS BIGINT) AS violations, count(*) AS absorbed, count(*) AS handled_before,
        2 * count(*) AS handled_after FROM plain GROUP BY group_id""",
        "plain",
    ),
)
def replay_is_noop(spark, d):
    """Without deletes: a replayed delete would bring its order back, as it does at the source."""
    return O.replay_effect(lifecycle_log(spark, d).where("value is not null"), DEFAULT_SERVICES)


@register(
    "group_divergence",
    using(
        """SELECT order_id, count(*) AS groups, min(last_sequence) AS lowest, max(last_sequence) AS highest FROM g_fold GROUP BY order_id
        HAVING count(*) <> 3 OR min(last_sequence) <> max(last_sequence) OR min(state) <> max(state)""",
        "g_fold",
    ),
)
def group_divergence(spark, d):
    return O.group_divergence(folds(spark, d), 3)
