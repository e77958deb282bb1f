"""Several logs written as one batch: all of it can be read, or none.

Each log gets its rows in a folder named by the batch; a commit record naming the logs and
their row counts is written last. Readers take the batches that have one. A batch that broke
off is written again under its id, one that was committed is left as it is.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from eventfold.plans.small import checked_broadcast
from eventfold.sources.sinks import write_batch

COMMIT = "log string, n bigint, batch bigint"
#: Committed batches up to this many are broadcast to the readers.
BATCHES = 1 << 16


@dataclass(frozen=True)
class Outbox:
    spark: SparkSession
    path: str

    def committed(self) -> DataFrame:
        """Commit records (log, n, batch)."""
        try:
            return self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits")
        except AnalysisException:
            return self.spark.createDataFrame([], COMMIT)

    def batch(self, batch_id: int) -> DataFrame | None:
        """The commit records of a batch, None before it is committed."""
        mine = self.committed().where(F.col("batch") == batch_id)
        return None if mine.isEmpty() else mine

    def publish(self, batch_id: int, logs: Mapping[str, DataFrame]) -> DataFrame:
        """Write ``logs`` in the order given and commit them. Returns the batch's commit records."""
        if (done := self.batch(batch_id)) is not None:
            return done
        counts = None
        for name, rows in logs.items():
            write_batch(rows, f"{self.path}/{name}", batch_id)
            n = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}/batch={batch_id}").agg(F.lit(name).alias("log"), F.count(F.lit(1)).alias("n"))
            counts = n if counts is None else counts.union(n)
        write_batch(counts.coalesce(1), f"{self.path}/commits", batch_id)
        return self.committed().where(F.col("batch") == batch_id)

    def read(self, name: str, schema: str) -> DataFrame:
        """Rows of one log, of committed batches only; the batch comes last."""
        rows = self.spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.path}/{name}")
        done = self.committed().where(F.col("log") == name).select("batch")
        return rows.join(checked_broadcast(done, BATCHES), "batch", "left_semi").select(*[c for c in rows.columns if c != "batch"], "batch")
