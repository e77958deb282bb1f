"""Questions an operator asks of a log and its folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.functions.text import key_text
from eventfold.operators import fold as FO


def keys_on_many_partitions(log: DataFrame) -> DataFrame:
    """Keys seen on more than one partition of a topic; there should be none.

    Two bounded values per key (lowest and highest partition) answer it, so partial
    aggregates stay small whatever a key holds.
    """
    spread = log.where(F.col("key").isNotNull()).groupBy("topic", "key").agg(
        F.min("partition").alias("low"), F.max("partition").alias("high")
    )
    return spread.where(F.col("low") != F.col("high")).select(
        "topic", key_text(F.col("key")).alias("key_text"), F.col("low").alias("first_partition"),
        F.col("high").alias("last_partition"),
    )


def partition_skew(log: DataFrame) -> DataFrame:
    """Records and distinct keys per partition. Keys are reduced first, then counted."""
    per_key = log.groupBy("topic", "partition", "key").agg(F.count(F.lit(1)).alias("n"))
    return per_key.groupBy("topic", "partition").agg(
        F.sum("n").alias("records"), F.count("key").alias("keys")
    )


def in_sequence(judged: DataFrame) -> DataFrame:
    """Orders whose handled sequences are exactly 1..n in arrival order.

    In such an order the i-th handled delivery has sequence i, which the running count
    shows row by row; no list of sequences is built.
    """
    done = judged.where(F.col("handler_ok"))
    return done.groupBy("group_id", "order_id").agg(
        F.min((F.col("sequence") == F.col("handled")).cast("int")).alias("ok"), F.count(F.lit(1)).alias("handled")
    ).where(F.col("ok") == 1).select("group_id", "order_id", "handled")


def gapped_orders(judged: DataFrame) -> DataFrame:
    """Orders with a gap against all orders, per group."""
    per_order = judged.groupBy("group_id", "order_id").agg(F.max(F.col("seq_gap").cast("int")).alias("gap"))
    return per_order.groupBy("group_id").agg(
        F.sum("gap").alias("gapped"), F.count(F.lit(1)).alias("orders")
    )


def violation_counts(violations: DataFrame) -> DataFrame:
    return violations.groupBy("group_id", "type").agg(F.count(F.lit(1)).alias("n"))


def replay_effect(log: DataFrame, services, handler=None) -> DataFrame:
    """What reading the whole log a second time does: nothing but counting.

    Records carry the pass they belong to, and are ordered by pass and offset; one history
    over both passes shows how many folds moved, what was reported, and how many deliveries
    were absorbed.
    """
    passes = log.withColumn("pass", F.explode(F.array(F.lit(1), F.lit(2))))
    order = ("pass", "offset")
    hist = FO.history(FO.deliveries(passes, services, handler, extra=("pass",), order=order), order=order)
    judged = FO.judge(hist).withColumn("replayed", F.col("pass") == 2)
    moved = F.col("replayed") & F.col("handler_ok") & ~F.col("redelivery")
    return judged.groupBy("group_id").agg(
        F.count_if(moved).alias("folds_changed"),
        F.count_if(F.col("replayed") & (F.col("seq_gap") | F.col("illegal"))).alias("violations"),
        F.count_if(F.col("replayed") & F.col("redelivery") & F.col("handler_ok")).alias("absorbed"),
        F.count_if(~F.col("replayed") & F.col("handler_ok")).alias("handled_before"),
        F.count_if(F.col("handler_ok")).alias("handled_after"),
    )


def group_divergence(folds: DataFrame, groups: int) -> DataFrame:
    """Orders whose fold differs between groups, or is missing in some."""
    per_order = folds.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("groups"),
        F.min("last_sequence").alias("lowest"),
        F.max("last_sequence").alias("highest"),
        F.min("state").alias("s1"),
        F.max("state").alias("s2"),
    )
    differs = (F.col("groups") != groups) | (F.col("lowest") != F.col("highest")) | (F.col("s1") != F.col("s2"))
    return per_order.where(differs).select("order_id", "groups", "lowest", "highest")


def key_mismatches(decoded: DataFrame) -> DataFrame:
    """Events whose key is not their order id; tombstones for such orders would miss their fold."""
    return decoded.where(
        F.col("order_id").isNotNull() & (key_text(F.col("key")) != F.col("order_id"))
    ).select("topic", "partition", "offset", key_text(F.col("key")).alias("key_text"), "order_id")
