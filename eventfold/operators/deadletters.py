"""Dead letters: bounded listing, and putting them back where they came from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.functions import headers as H
from eventfold.functions import text as X
from eventfold.operators.failures import NON_RETRYABLE


def inspect(dlq: DataFrame, service: str | None = None) -> DataFrame:
    """Dead letters in scope, each with its header fields and a readable line.

    Exploding a one-element array keeps filters on decoded headers above the decoding; pushed
    below it, each would repeat the decoding many times over.
    """
    m = F.col("headers_map")
    pick = lambda name: F.try_element_at(m, F.lit(name))
    rows = dlq.select("*", F.explode(F.array(H.decode_headers(F.col("headers")))).alias("headers_map")).select(
        "topic", "partition", "offset", "key", "value",
        pick(H.SERVICE).alias("service"),
        pick(H.CONSUMER_GROUP).alias("group_id"),
        pick(H.ATTEMPTS_MADE).alias("attempts_made"),
        pick(H.ERROR_CLASS).alias("error_class"),
        pick(H.ORIGINAL_TOPIC).alias("target"),
        X.render_dead_letter(F.col("key"), m).alias("line"),
    )
    return rows if service is None else rows.where(F.col("service") == service)


def excluded(error_class=None, include_poison: bool = False, non_retryable: Sequence[str] = NON_RETRYABLE):
    """Whether a dead letter is held back because replaying it cannot help."""
    if include_poison:
        return F.lit(False)
    column = F.col("error_class") if error_class is None else error_class
    return F.coalesce(column.isin(list(non_retryable)), F.lit(False))


def counts(dlq: DataFrame, service: str | None = None, include_poison: bool = False) -> DataFrame:
    """Read, matched and excluded totals of one run, in one pass."""
    m = H.decode_headers(F.col("headers"))
    rows = dlq.select(
        F.try_element_at(m, F.lit(H.SERVICE)).alias("service"),
        F.try_element_at(m, F.lit(H.ERROR_CLASS)).alias("error_class"),
    )
    hit = F.lit(True) if service is None else F.coalesce(F.col("service") == service, F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("read"),
        F.count_if(hit).alias("matched"),
        F.count_if(hit & excluded(include_poison=include_poison)).alias("excluded"),
    )


def first_matched(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` dead letters in read order; top-k, not a full sort."""
    return rows.orderBy("partition", "offset").limit(n)


def replay(
    dlq: DataFrame, service: str | None = None, include_poison: bool = False, limit: int = 0
) -> DataFrame:
    """Records to publish again: original key and value to the original topic, no headers.

    Records without a known origin are left out. With ``limit`` only the first matched
    dead letters are looked at.
    """
    rows = inspect(dlq, service)
    if limit:
        rows = first_matched(rows, limit)
    fit = rows.where(~excluded(include_poison=include_poison) & F.col("target").isNotNull() & (F.col("target") != ""))
    return fit.select(
        F.col("target").alias("topic"),
        "partition",
        "offset",
        "key",
        "value",
        F.lit(None).cast("array<struct<key:string,value:binary>>").alias("headers"),
    )


def depth(dlq: DataFrame) -> DataFrame:
    """Dead letters per topic, service and error class."""
    m = H.decode_headers(F.col("headers"))
    return (
        dlq.select(
            "topic",
            F.try_element_at(m, F.lit(H.SERVICE)).alias("service"),
            F.try_element_at(m, F.lit(H.ERROR_CLASS)).alias("error_class"),
        )
        .groupBy("topic", "service", "error_class")
        .agg(F.count(F.lit(1)).alias("n"))
    )
