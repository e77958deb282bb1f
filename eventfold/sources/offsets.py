"""Log positions: bounds, bounded reads, committed offsets, lag and resets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.plans.small import checked_broadcast, fixed

#: Bounds of up to this many partitions are broadcast; longer tables are joined with a shuffle.
BROADCAST_PARTITIONS = 200_000


def log_bounds(log: DataFrame) -> DataFrame:
    """``[low, high)`` per partition; empty partitions do not appear. Reads two columns."""
    return log.groupBy("topic", "partition").agg(
        F.min("offset").alias("low"), (F.max("offset") + 1).alias("high")
    )


def fixed_bounds(log: DataFrame) -> DataFrame:
    """Bounds as they stand now, detached from the log: later writes do not move them.

    One row per partition, written to the shared folder.
    """
    return fixed(log_bounds(log))


def message_count(bounds: DataFrame) -> DataFrame:
    """Messages a bounded read may see: the sum of end minus start."""
    return bounds.agg(F.sum(F.greatest(F.col("high") - F.col("low"), F.lit(0))).alias("messages"))


def read_bounded(log: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows inside the bounds, one row per partition as :func:`fixed_bounds` gives them."""
    b = checked_broadcast(
        bounds.select("topic", "partition", F.col("low").alias("_low"), F.col("high").alias("_high")), BROADCAST_PARTITIONS
    )
    inside = (F.col("offset") >= F.col("_low")) & (F.col("offset") < F.col("_high"))
    return log.join(b, ["topic", "partition"]).where(inside).select(*log.columns)


def read_partition_from(log: DataFrame, topic: str, partition: int, offset: int) -> DataFrame:
    """One partition from an offset on; the filter reaches the scan."""
    return log.where(
        (F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") >= offset)
    )


def print_limit(log: DataFrame, n: int) -> DataFrame:
    """The first ``n`` messages in read order, keys as text. Top-k, not a full sort."""
    from eventfold.functions.text import key_text

    return log.select(
        "partition", "offset", F.unix_millis("timestamp").alias("timestamp_ms"), key_text(F.col("key")).alias("key_text")
    ).orderBy("partition", "offset").limit(n)


def _at_time(log: DataFrame, moment: Column) -> DataFrame:
    return (
        log.where(F.col("timestamp") >= moment)
        .groupBy("topic", "partition")
        .agg(F.min("offset").alias("at_time"))
    )


def reset_offsets(
    committed: DataFrame,
    log: DataFrame,
    *,
    to: str,
    value=None,
    execute: bool = False,
) -> DataFrame:
    """Committed offsets after a reset, held inside the log's bounds.

    ``to`` is ``earliest``, ``latest``, ``shift`` (by ``value``), ``offset`` (``value``) or
    ``datetime`` (first offset at or after the timestamp column ``value``, else the end).
    A dry run keeps ``committed`` and shows ``new_offset`` next to it.
    """
    bounds = fixed_bounds(log)
    rows = committed.join(checked_broadcast(bounds, BROADCAST_PARTITIONS), ["topic", "partition"])
    low, high = F.col("low"), F.col("high")
    if to == "datetime":
        rows = rows.join(_at_time(log, value), ["topic", "partition"], "left")
    target = {
        "earliest": lambda: low,
        "latest": lambda: high,
        "shift": lambda: F.coalesce("committed", low) + F.lit(value),
        "offset": lambda: F.lit(value).cast("bigint"),
        "datetime": lambda: F.coalesce("at_time", high),
    }
    if to not in target:
        raise ValueError(f"unknown reset {to!r}")
    new = F.greatest(low, F.least(high, target[to]()))
    out = rows.select("group_id", "topic", "partition", "committed", new.alias("new_offset"))
    return out.withColumn("committed", F.col("new_offset")) if execute else out


def consumer_lag(log: DataFrame, committed: DataFrame, groups: Sequence[str]) -> DataFrame:
    """End of log minus committed, per group and partition; an uncommitted group lags from the start."""
    named = F.explode(F.array(*[F.lit(g) for g in groups])).alias("group_id")
    every = log_bounds(log).select("*", named)
    held = committed.select("group_id", "topic", "partition", "committed")
    return every.join(held, ["group_id", "topic", "partition"], "left").select(
        "group_id", "topic", "partition", "committed", F.col("high").alias("log_end"),
        (F.col("high") - F.coalesce("committed", "low")).alias("lag"),
    )


def key_partition(key: Column, partitions: int) -> Column:
    """Partition of a key by CRC-32, the same for every topic with this many partitions."""
    return F.pmod(F.crc32(key), F.lit(partitions)).cast("int")
