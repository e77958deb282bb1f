"""Running aggregates along a log partition, computed in two levels.

A log partition may hold a third of all rows, so a window over the whole of it would put
that third into one task. Here rows are cut into offset blocks, each block is scanned on
its own, and one small row per block carries the result across block borders.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventfold.plans.hot import BLOCK_ROWS, int_div

_MERGE = {"sum": lambda a, b: a + b, "max": F.greatest, "min": F.least}
_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def numbered(df: DataFrame, keys: Sequence[str], cells: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """Add a dense position from 0 per ``keys``, along ``cells`` and ``order`` inside them.

    ``cells`` cut the rows of a key into parts that fit a task. Parts are counted first, so
    no window spans a key's rows. ``cells`` must not be null.
    """
    sizes = df.groupBy(*keys, *cells).agg(F.count(F.lit(1)).alias("_n"))
    before = (F.sum("_n").over(Window.partitionBy(*keys).orderBy(*cells)) - F.col("_n")).alias("_before")
    inside = F.row_number().over(Window.partitionBy(*keys, *cells).orderBy(*order)) - 1
    placed = df.withColumn("_inside", inside).join(sizes.select(*keys, *cells, before), [*keys, *cells])
    return placed.select(*df.columns, (F.col("_before") + F.col("_inside")).alias(name))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    aggs: Mapping[str, tuple[str, Column]],
    block_rows: int = BLOCK_ROWS,
    summary: DataFrame | None = None,
) -> DataFrame:
    """Add running ``sum``/``max``/``min`` columns per ``keys`` along the bigint ``order``.

    ``order`` must be unique within ``keys``. Running values include the current row. Block
    summaries are taken from ``df``, or from ``summary`` when a cheaper source has the same
    rows with the columns they need.
    """
    block = "_block"
    names = list(aggs)

    def prepared(source: DataFrame) -> DataFrame:
        source = source.withColumn(block, int_div(F.col(order), block_rows))
        for name, (_, value) in aggs.items():
            source = source.withColumn(f"_in_{name}", value)
        return source

    rows = prepared(df)
    per_block = (rows if summary is None else prepared(summary)).groupBy(*keys, block).agg(
        *[_AGG[kind](f"_in_{name}").alias(f"_c_{name}") for name, (kind, _) in aggs.items()]
    )
    earlier = (
        Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = per_block.select(
        *keys,
        block,
        *[_AGG[kind](f"_c_{name}").over(earlier).alias(f"_c_{name}") for name, (kind, _) in aggs.items()],
    )

    inside = (
        Window.partitionBy(*keys, block)
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = rows.select(
        *df.columns,
        block,
        *[_AGG[kind](f"_in_{name}").over(inside).alias(f"_l_{name}") for name, (kind, _) in aggs.items()],
    )
    joined = local.join(carry, [*keys, block], "left")
    return joined.select(
        *df.columns,
        *[
            F.when(F.col(f"_c_{name}").isNull(), F.col(f"_l_{name}"))
            .when(F.col(f"_l_{name}").isNull(), F.col(f"_c_{name}"))
            .otherwise(_MERGE[aggs[name][0]](F.col(f"_c_{name}"), F.col(f"_l_{name}")))
            .alias(name)
            for name in names
        ],
    )
