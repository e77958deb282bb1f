"""Compaction of keyed logs, and rebuilding state from a changelog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.plans.small import checked_broadcast
from eventfold.sources.offsets import BROADCAST_PARTITIONS, fixed_bounds


def compact_latest(log: DataFrame, where_live: Column | None = None) -> DataFrame:
    """The newest record of every key, tombstones included.

    Two steps: the highest offset per key, combined before the shuffle, then a semi join on
    the record's position. Positions are unique, so a hot key loads no single task, and
    values are not carried through the aggregation. The offset is the first join key, as both
    sides are sorted by the keys in turn, and topics are equal over long runs.
    """
    keyed = log.where(F.col("key").isNotNull())
    eligible = keyed if where_live is None else keyed.where(where_live)
    newest = (
        eligible.groupBy("topic", "partition", "key")
        .agg(F.max("offset").alias("offset"))
        .select("topic", "partition", "offset")
    )
    return eligible.join(newest, ["offset", "partition", "topic"], "left_semi").select(*log.columns)


def null_keys(log: DataFrame) -> DataFrame:
    """Records a compacted log refuses: they have no key."""
    return log.where(F.col("key").isNull())


def compact_with_lag(log: DataFrame, cutoff: Column) -> DataFrame:
    """Compact only what is older than ``cutoff``; the newer tail stays as it is."""
    old = F.col("timestamp") < cutoff
    return compact_latest(log, old).unionByName(log.where(~old & F.col("key").isNotNull()))


def tombstone_gc(compacted: DataFrame, cutoff: Column) -> DataFrame:
    """Drop tombstones older than ``cutoff`` from a compacted log."""
    return compacted.where(F.col("value").isNotNull() | (F.col("timestamp") >= cutoff))


def current_table(log: DataFrame) -> DataFrame:
    """Live rows only: the newest value per key, without deleted keys."""
    return compact_latest(log).where(F.col("value").isNotNull())


def restore_full(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replay a changelog from its start: the state, and per partition what the replay cost."""
    return current_table(log), _restore_report(log, None)


def restore_checkpoint(log: DataFrame, stored: DataFrame, checkpoints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep the stored state and apply only records from each partition's checkpoint on.

    ``stored`` has the changelog's columns. ``checkpoints`` holds ``topic, partition,
    position``, one row per partition with a checkpoint; a partition without one is rebuilt
    from its start and its stored rows are dropped.
    """
    marks = checked_broadcast(
        checkpoints.select("topic", "partition", F.col("position").alias("_from")), BROADCAST_PARTITIONS
    )
    delta = (
        log.join(marks, ["topic", "partition"], "left")
        .where(F.col("_from").isNull() | (F.col("offset") >= F.col("_from")))
        .drop("_from")
    )
    kept = stored.join(marks, ["topic", "partition"], "left_semi")
    state = current_table(kept.unionByName(delta.select(*stored.columns)))
    return state, _restore_report(log, marks)


def _restore_report(log: DataFrame, marks: DataFrame | None) -> DataFrame:
    """Records read, keys left live by them, and the offset range, per partition."""
    group = ["topic", "partition"]
    ends = fixed_bounds(log).withColumnRenamed("high", "to_offset")
    start = F.col("low")
    if marks is not None:
        ends = ends.join(marks, group, "left")
        start = F.greatest("low", F.coalesce("_from", "low"))
    ends = ends.select(*group, start.alias("from_offset"), "to_offset")
    read = log.select(*group, "key", "offset", F.col("value").isNotNull().alias("live")).join(
        F.broadcast(ends.select(*group, "from_offset")), group
    ).where(F.col("offset") >= F.col("from_offset"))
    # Whether a key ends live: its newest record is even (live) or odd (deleted) in this code.
    coded = F.max(F.col("offset") * 2 + (~F.col("live")).cast("int"))
    per_key = read.groupBy(*group, "key").agg(coded.alias("last"), F.count(F.lit(1)).alias("n"))
    cost = per_key.groupBy(*group).agg(
        F.sum("n").alias("records"), F.count_if(F.col("last") % 2 == 0).alias("keys")
    )
    zero = F.lit(0).cast("bigint")
    return ends.join(cost, group, "left").select(
        *group, F.coalesce("records", zero).alias("records"), F.coalesce("keys", zero).alias("keys"),
        "from_offset", "to_offset",
    )


def rebuild_partitions(log: DataFrame, state_path: str, touched: Sequence[tuple[str, int]]) -> DataFrame:
    """Discard and rebuild the state of the touched partitions only; the others stay on disk."""
    pick = F.lit(False)
    for topic, partition in touched:
        pick = pick | ((F.col("topic") == topic) & (F.col("partition") == partition))
    write_state(compact_latest(log.where(pick)), state_path)
    return read_state(log.sparkSession, state_path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Live rows of a written state table."""
    return spark.read.parquet(path).where(F.col("value").isNotNull())


def write_state(state: DataFrame, path: str) -> None:
    """Write a state table by partition. Only partitions present in ``state`` are replaced.

    Deleted keys are written too, without a value, so a partition left with nothing alive
    still replaces its old rows.
    """
    state.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "topic", "partition"
    ).parquet(path)


def check_rebuild(guarantee: str, rebuild: str) -> None:
    """Refuse the pair that would skip the records an aborted write needs to be repaired."""
    if guarantee not in ("at_least_once", "exactly_once"):
        raise ValueError(f"unknown guarantee {guarantee!r}")
    if rebuild not in ("full", "checkpoint"):
        raise ValueError(f"unknown rebuild {rebuild!r}")
    if guarantee == "exactly_once" and rebuild == "checkpoint":
        raise ValueError(
            "exactly_once cannot be combined with a checkpoint rebuild: after an abort the stored "
            "state is ahead of the changelog, and the rebuild would skip its repair; use full"
        )
