"""Runs of the fold and what is read off it."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventfold.functions import text as X
from eventfold.operators import fold as O
from eventfold.operators.statetable import StateTable
from eventfold.registry import register
from eventfold.registry.sql import using
from eventfold.schemas import LIFECYCLE_TOPIC, SNAPSHOT_TOPIC
from eventfold.session import work_dir, written
from eventfold.sources.order_log import fixture_handler, lifecycle_log

FOLD_COLUMNS = "group_id, order_id, last_sequence, state, last_event_id, handled_count"


def hist(spark, sf_dir, mode=O.GUARDED, resets=()):
    rows = O.deliveries(lifecycle_log(spark, sf_dir), handler=fixture_handler)
    return O.history(rows, mode, resets=resets)


def folds(spark, sf_dir, mode=O.GUARDED, resets=()):
    return O.final_folds(hist(spark, sf_dir, mode, resets))


RESETS = (O.Reset("inventory-service", LIFECYCLE_TOPIC, 1, 20000),)

register("fold_guarded", using(f"SELECT {FOLD_COLUMNS} FROM g_fold", "g_fold"))(folds)
register("fold_last_write", using(f"SELECT {FOLD_COLUMNS} FROM w_fold", "w_fold"))(
    lambda spark, d: folds(spark, d, O.LAST_WRITE)
)


def two_topics(spark, d):
    """Deletes moved to the snapshot topic at offsets of their own, among snapshots to be skipped."""
    log = written(lifecycle_log(spark, d), "log")
    gone = F.col("value").isNull()
    keep = log.where(~gone)
    moved = log.where(gone).withColumn("topic", F.lit(SNAPSHOT_TOPIC)).withColumn("offset", F.col("offset") * 2 + 1)
    snapshots = (
        log.where(~gone & (F.col("offset") % 16 == 0))
        .withColumn("topic", F.lit(SNAPSHOT_TOPIC))
        .withColumn("offset", F.col("offset") * 2)
    )
    return keep.unionByName(moved).unionByName(snapshots)


@register("fold_two_topics", using(f"SELECT {FOLD_COLUMNS} FROM g_fold", "g_fold"))
def fold_two_topics(spark, d):
    rows = O.deliveries(
        two_topics(spark, d), handler=fixture_handler, merge_topics=(LIFECYCLE_TOPIC, SNAPSHOT_TOPIC)
    )
    return O.final_folds(O.history(rows, order=O.MERGED))


@register("fold_hot", using(f"SELECT {FOLD_COLUMNS} FROM g_fold", "g_fold"))
def fold_hot(spark, d):
    """The guarded fold with orders of more than four records cut into blocks."""
    rows = O.deliveries(lifecycle_log(spark, d), handler=fixture_handler, block_rows=4)
    return O.final_folds(O.history(rows))


@register("fold_two_topics_hot", using(f"SELECT {FOLD_COLUMNS} FROM g_fold", "g_fold"))
def fold_two_topics_hot(spark, d):
    rows = O.deliveries(
        two_topics(spark, d), handler=fixture_handler, merge_topics=(LIFECYCLE_TOPIC, SNAPSHOT_TOPIC), block_rows=4
    )
    return O.final_folds(O.history(rows, order=O.MERGED))


@register(
    "fold_per_group",
    using(
        """SELECT group_id, count(*) AS folds, CAST(sum(handled_count) AS BIGINT) AS handled,
        CAST(sum(last_sequence) AS BIGINT) AS sequences FROM g_fold GROUP BY group_id""",
        "g_fold",
    ),
)
def fold_per_group(spark, d):
    return folds(spark, d).groupBy("group_id").agg(
        F.count(F.lit(1)).alias("folds"),
        F.sum("handled_count").alias("handled"),
        F.sum("last_sequence").alias("sequences"),
    )


@register(
    "apply_event",
    using(
        """SELECT group_id, order_id, p AS "partition", off AS "offset", s AS sequence, coalesce(prev.s, 0) AS before_sequence,
        prev.st AS before_state, s AS after_sequence, leads_to AS after_state, redelivery, seq_gap, illegal FROM g_judged""",
        "g_judged",
    ),
)
def apply_event(spark, d):
    from eventfold.lifecycle import ORDER_LIFECYCLE

    return O.judge(hist(spark, d)).select(
        "group_id", "order_id", "partition", "offset", "sequence",
        F.coalesce(F.col("prev.sequence"), F.lit(0)).alias("before_sequence"),
        F.col("prev.state").alias("before_state"),
        F.col("sequence").alias("after_sequence"),
        ORDER_LIFECYCLE.resulting(F.col("event_type")).alias("after_state"),
        "redelivery", "seq_gap", "illegal",
    )


@register(
    "seq_gap",
    using(
        """SELECT group_id, order_id, sequence, expected, observed, "partition", "offset" FROM g_viol WHERE type = 'SEQUENCE_GAP'""",
        "g_viol",
    ),
)
def seq_gap(spark, d):
    return O.violations(O.judge(hist(spark, d))).where("type = 'SEQUENCE_GAP'").drop("type")


@register(
    "illegal_transition",
    using(
        """SELECT group_id, order_id, sequence, expected, observed, "partition", "offset" FROM g_viol WHERE type = 'ILLEGAL_TRANSITION'""",
        "g_viol",
    ),
)
def illegal_transition(spark, d):
    return O.violations(O.judge(hist(spark, d))).where("type = 'ILLEGAL_TRANSITION'").drop("type")


@register(
    "redelivery",
    using(
        """SELECT group_id, order_id, s AS sequence, prev.s AS stored_sequence, p AS "partition", off AS "offset"
        FROM g_judged WHERE redelivery""",
        "g_judged",
    ),
)
def redelivery(spark, d):
    return O.judge(hist(spark, d)).where("redelivery").select(
        "group_id", "order_id", "sequence", F.col("prev.sequence").alias("stored_sequence"), "partition", "offset"
    )


@register(
    "duplicate_absorbed",
    using(
        """SELECT group_id, order_id, s AS sequence, p AS "partition", off AS "offset", cur.s AS stored_sequence,
        handled AS handled_count FROM g_judged WHERE redelivery AND ok""",
        "g_judged",
    ),
)
def duplicate_absorbed(spark, d):
    return O.duplicates_absorbed(O.judge(hist(spark, d)))


@register(
    "violations",
    using(
        """SELECT group_id, type, order_id, sequence, expected, observed, "partition", "offset" FROM g_viol""",
        "g_viol",
    ),
)
def all_violations(spark, d):
    return O.violations(O.judge(hist(spark, d)))


@register(
    "render_violation",
    using(
        """SELECT 'VIOLATION type=' || type || ' order_id=' || order_id || ' seq=' || sequence || ' expected=' || expected
        || ' observed=' || observed AS line, count(*) AS n FROM g_viol GROUP BY 1""",
        "g_viol",
    ),
)
def render_violation(spark, d):
    c = F.col
    line = X.render_violation(c("type"), c("order_id"), c("sequence"), c("expected"), c("observed"))
    return all_violations(spark, d).groupBy(line.alias("line")).agg(F.count(F.lit(1)).alias("n"))


@register("residue", using(f"SELECT {FOLD_COLUMNS} FROM g_fold WHERE handled_count > last_sequence", "g_fold"))
def residue(spark, d):
    return O.residue(folds(spark, d))


@register(
    "tombstone_delete",
    using(
        """SELECT group_id, order_id, p AS "partition", off AS "offset", prev IS NOT NULL AS deleted FROM g_hist WHERE stone""",
        "g_hist",
    ),
)
def tombstone_delete(spark, d):
    return O.tombstones(hist(spark, d)).drop("topic")


@register(
    "fold_reset_at",
    using(
        """SELECT group_id, type, order_id, sequence, expected, observed, "partition", "offset" FROM r_viol""",
        "r_viol",
    ),
)
def fold_reset_at(spark, d):
    return O.violations(O.judge(hist(spark, d, O.LAST_WRITE, RESETS)))


@register(
    "fold_skip_failed",
    using(
        """SELECT group_id, order_id, s AS sequence, err AS error_class, prev.s AS kept_sequence, cur.s AS after_sequence,
        seq_gap, illegal FROM g_judged WHERE err IS NOT NULL""",
        "g_judged",
    ),
)
def fold_skip_failed(spark, d):
    return O.judge(hist(spark, d)).where("error_class is not null").select(
        "group_id", "order_id", "sequence", "error_class",
        F.col("prev.sequence").alias("kept_sequence"),
        F.col("cur.sequence").alias("after_sequence"),
        "seq_gap", "illegal",
    )


@register(
    "fold_lookup",
    using(
        f"SELECT {FOLD_COLUMNS} FROM g_fold WHERE group_id = 'inventory-service' AND order_id = 'ord-000000000005'",
        "g_fold",
    ),
)
def fold_lookup(spark, d):
    """One fold from kept state: the order's bucket is opened, nothing is folded for the lookup."""
    table = StateTable(spark, work_dir(spark, "state"))
    table.create(O.changelog(hist(spark, d)))
    found = table.get("order-fold.inventory-service", b"ord-000000000005")
    fold = O.decode_fold(F.col("value").cast("string"))
    return found.select(F.lit("inventory-service").alias("group_id"), F.col("key").cast("string").alias("order_id"), fold.alias("f")).select(
        "group_id", "order_id", "f.last_sequence", "f.state", "f.last_event_id", "f.handled_count"
    )


