"""Replay runs of a dead-letter log: bounded, repeatable, and dry unless told to publish.

A run has a number. Its bounds, the ends of the dead-letter partitions, are written before
anything is published, so dead letters that the replay itself provokes belong to a later run.
What it publishes goes into one batch folder named by the run, and its ledger (which dead
letter became which record) is closed by a commit record written last. A run that is started
again under its number uses the same bounds: uncommitted, it rewrites the same folder;
committed, it publishes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from eventfold.operators import deadletters as DL
from eventfold.plans.small import checked_broadcast
from eventfold.schemas import LOG_SCHEMA
from eventfold.session import written
from eventfold.sources.offsets import BROADCAST_PARTITIONS, key_partition, log_bounds
from eventfold.sources.sinks import NO_HEADERS, write_batch
from eventfold.streaming.sequence import Sequencer

BOUNDS = "topic string, partition int, low bigint, high bigint"
LEDGER = "dead_topic string, dead_partition int, dead_offset bigint, topic string, partition int, offset bigint"
COMMIT = "run bigint, read bigint, matched bigint, excluded bigint, skipped bigint, published bigint"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A table as an earlier attempt left it, or None. An attempt that broke off left no success mark."""
    try:
        spark.read.text(f"{path}/_SUCCESS")
    except AnalysisException:
        return None
    return spark.read.schema(schema).parquet(path)


@dataclass(frozen=True)
class ReplayRun:
    """One run over the log that ``dead_letters`` reads. ``partitions`` is the number of partitions of the target topics."""

    number: int
    dead_letters: Callable[[], DataFrame]
    ledger: str
    partitions: int
    service: str | None = None
    include_poison: bool = False
    limit: int = 0

    def _path(self, name: str) -> str:
        return f"{self.ledger}/run={self.number}/{name}"

    def bounds(self, keep: bool) -> DataFrame:
        """Low and high offset per partition: those of the first attempt, else of now, kept if ``keep``."""
        dead = self.dead_letters()
        found = _table(dead.sparkSession, self._path("bounds"), BOUNDS)
        if found is not None:
            return found
        now = log_bounds(dead).select("topic", "partition", "low", "high")
        if not keep:
            return now
        now.write.mode("overwrite").parquet(self._path("bounds"))
        return dead.sparkSession.read.schema(BOUNDS).parquet(self._path("bounds"))

    def scope(self, bounds: DataFrame) -> DataFrame:
        """Dead letters inside the bounds."""
        ends = checked_broadcast(bounds.select("topic", "partition", "high"), BROADCAST_PARTITIONS)
        return self.dead_letters().join(ends, ["topic", "partition"]).where(F.col("offset") < F.col("high")).drop("high")

    def _judged(self, scope: DataFrame) -> DataFrame:
        """Matched dead letters with ``fate``: publish, excluded, or skipped for want of a target."""
        rows = DL.inspect(scope, self.service)
        if self.limit:
            rows = DL.first_matched(rows, self.limit)
        lost = F.coalesce(F.col("target") == "", F.lit(True))
        return rows.withColumn(
            "fate", F.when(DL.excluded(include_poison=self.include_poison), "excluded").when(lost, "skipped").otherwise("publish")
        )

    def _summary(self, scope: DataFrame, judged: DataFrame, published: bool) -> DataFrame:
        n = lambda fate: F.count_if(F.col("fate") == fate)
        sent = n("publish") if published else F.lit(0).cast("bigint")
        found = judged.agg(F.count(F.lit(1)).alias("matched"), n("excluded").alias("excluded"), n("skipped").alias("skipped"), sent.alias("published"))
        return found.select(
            F.lit(self.number).cast("bigint").alias("run"), F.lit(scope.count()).cast("bigint").alias("read"), "matched", "excluded", "skipped", "published"
        )

    def dry(self) -> DataFrame:
        """What a publishing run would find now. Nothing is written."""
        scope = self.scope(self.bounds(keep=False))
        return self._summary(scope, self._judged(scope), False)

    def publish(self, out: str, sequencer: Sequencer) -> DataFrame:
        """Publish below ``out`` and return the run's commit record. Original key and value, no headers, partition by key."""
        spark = self.dead_letters().sparkSession
        done = _table(spark, self._path("commit"), COMMIT)
        if done is not None:
            return done
        scope = self.scope(self.bounds(keep=True))
        judged = written(self._judged(scope), "replay-judged")
        records = judged.where("fate = 'publish'").select(
            F.col("target").alias("topic"), F.coalesce(key_partition(F.col("key"), self.partitions), F.lit(0)).cast("int").alias("partition"),
            F.col("topic").alias("dead_topic"), F.col("partition").alias("dead_partition"), F.col("offset").alias("dead_offset"), "key", "value",
        )
        placed = written(sequencer.place(records, ["dead_topic", "dead_partition"], ["dead_offset"], self.number), "replay-placed")
        log = placed.select("topic", "partition", "offset", F.current_timestamp().alias("timestamp"), "key", "value", F.lit(None).cast(NO_HEADERS).alias("headers"))
        write_batch(log, out, self.number)
        placed.select("dead_topic", "dead_partition", "dead_offset", "topic", "partition", "offset").write.mode("overwrite").parquet(self._path("sent"))
        self._summary(scope, judged, True).write.mode("overwrite").parquet(self._path("commit"))
        return spark.read.schema(COMMIT).parquet(self._path("commit"))


def sent(spark: SparkSession, ledger: str, number: int) -> DataFrame:
    """The ledger of a committed run; no rows before its commit."""
    if _table(spark, f"{ledger}/run={number}/commit", COMMIT) is None:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{ledger}/run={number}/sent")


def published(spark: SparkSession, out: str, ledger: str) -> DataFrame:
    """Replayed records of committed runs only."""
    rows = spark.read.schema(f"{LOG_SCHEMA}, batch bigint").parquet(out)
    commits = spark.read.schema(f"{COMMIT}").option("basePath", ledger).parquet(f"{ledger}/run=*/commit").select(F.col("run").alias("batch"))
    return rows.join(checked_broadcast(commits, BROADCAST_PARTITIONS), "batch", "left_semi").drop("batch")
