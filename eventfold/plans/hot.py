"""Find keys too large for one task and cut them into blocks of rows.

Nothing about the keys reaches the driver: counts are a written table, and hot rows are
range-partitioned and sorted in their own order. Blocks are runs of ``block_rows`` rows inside
such a partition, so short blocks need no partition each. The blocks are written too, so every
later read sees the same cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.plans.small import checked_broadcast
from eventfold.session import written

#: Rows of one key that one task may hold. Longer keys are cut into blocks of about this many.
BLOCK_ROWS = 1 << 20
#: Range partitions hold at least about this many hot rows; shorter blocks share one.
PART_ROWS = 1 << 16
#: Range partitions that the hot rows of one job are dealt into at most; they grow beyond.
MAX_BLOCKS = 1 << 16
#: Hot keys up to this many are broadcast; more of them are joined with a shuffle.
BROADCAST_KEYS = 1 << 16


def int_div(a: Column, b: int) -> Column:
    """Whole-number division on bigints, without a detour through double."""
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def hot_keys(rows: DataFrame, key: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Keys with more than ``block_rows`` rows and how many. Counts combine before the shuffle."""
    return written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block_rows), "hot-keys")


def split(rows: DataFrame, key: str, order: Sequence[str], block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and those of hot keys with a bigint ``block`` increasing along ``order``.

    ``rows`` should be a written table, as it is read twice. Without hot keys the second
    part is None and the first is ``rows``. A null key is an ordinary one.
    """
    keys = hot_keys(rows, key, block_rows)
    found, total = keys.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not found:
        return rows, None
    small = checked_broadcast(keys.select(F.col(key)), BROADCAST_KEYS)
    parts = min(MAX_BLOCKS, -(-total // max(block_rows, PART_ROWS)) + 1)
    hot = rows.join(small, key).select(*rows.columns)
    dealt = hot.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    # the id counts the rows of a partition in this order and grows from one partition to the next
    cut = dealt.withColumn("block", int_div(F.monotonically_increasing_id(), block_rows))
    return rows.join(small, key, "left_anti"), written(cut, "hot-rows")
