"""Positions for records appended to log tables by streams.

A log table has no broker that numbers its records, so its writers do. Each writer keeps the
next free position of every target partition in a small table beside its output, one version
per batch. The log is read once, for its ends, when the writer begins; later batches read
the version before them, so a repeated batch gives the same positions. Several writers of one
log interleave: each takes every n-th position, so no two can meet, and holes mean nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.plans.scan import numbered
from eventfold.sources.offsets import log_bounds

ENDS = "topic string, partition int, next bigint"


class Sequencer:
    """Next free positions below ``path``. ``log`` gives the logs as they stand before the first batch."""

    def __init__(self, path: str, log: Callable[[], DataFrame] | None = None, writer: int = 0, writers: int = 1):
        if not 0 <= writer < writers:
            raise ValueError(f"writer {writer} of {writers}")
        self.path, self.log, self.writer, self.writers = path, log, writer, writers
        self.last: int | None = None

    def _version(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        """The newest ends of batches before this one: known from the last batch, else from the folder's names."""
        if self.last is None or self.last >= batch_id:
            folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
            files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
            names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
            earlier = [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")]
            self.last = max((b for b in earlier if b < batch_id), default=None)
        return None if self.last is None else spark.read.schema(ENDS).parquet(f"{self.path}/batch={self.last}")

    def _ends(self, spark: SparkSession, batch_id: int) -> DataFrame:
        found = self._version(spark, batch_id)
        if found is None:
            start = spark.createDataFrame([], ENDS)
            if self.log is not None:
                start = log_bounds(self.log()).select("topic", "partition", (F.col("high") + self.writer).cast("bigint").alias("next"))
            start.write.mode("overwrite").parquet(f"{self.path}/batch=-1")
            self.last = -1
            found = spark.read.schema(ENDS).parquet(f"{self.path}/batch=-1")
        return found

    def place(self, records: DataFrame, cells: Sequence[str], order: Sequence[str], batch_id: int) -> DataFrame:
        """``records`` (topic, partition, ...) with ``offset``: the next free positions, along ``cells`` and ``order``.

        Pass a written table: it is read for its counts and again for its rows.
        """
        spark, keys = records.sparkSession, ["topic", "partition"]
        ends = self._ends(spark, batch_id)
        counts = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        first = F.coalesce("next", F.lit(self.writer).cast("bigint"))
        moved = ends.join(counts, keys, "full").select(*keys, (first + F.coalesce("_n", F.lit(0)) * self.writers).alias("next"))
        moved.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        self.last = batch_id
        ranked = numbered(records, keys, cells, order).join(ends, keys, "left")
        return ranked.select(*records.columns, (first + F.col("rank") * self.writers).alias("offset"))
