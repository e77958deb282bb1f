"""Broadcasts whose size has been checked first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventfold.session import written


def fixed(df: DataFrame) -> DataFrame:
    """A table as it stands now, detached from its source by writing it."""
    return written(df, "fixed")


def checked_broadcast(df: DataFrame, cap: int) -> DataFrame:
    """A table marked for broadcast if it has at most ``cap`` rows, and left to a shuffled join if not."""
    return F.broadcast(df) if df.limit(cap + 1).count() <= cap else df
