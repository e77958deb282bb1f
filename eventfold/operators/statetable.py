"""A state table in key buckets: deltas merge bucket by bucket, point reads open one bucket.

The rows are the newest changelog record of every key, deleted keys included, in folders by
topic, partition and bucket of the key. A merge reads and replaces the folders that its
delta touches, so its work follows the delta and not the state. A folder is replaced whole
from a written table, so a merge that broke off can be run again with the same delta.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.operators.changelog import compact_latest
from eventfold.plans.small import checked_broadcast
from eventfold.session import written
from eventfold.sources.offsets import BROADCAST_PARTITIONS

COLUMNS = ("topic", "partition", "offset", "timestamp", "key", "value")
SCHEMA = "topic string, partition int, offset bigint, timestamp timestamp, key binary, value binary, bucket int"
_PLACE = ["topic", "partition", "bucket"]
#: Touched folders up to this many are named in the scan; more of them are joined.
NAMED = 4096


@dataclass(frozen=True)
class StateTable:
    """State below ``path``; ``buckets`` per partition of the changelog, fixed for the table's life."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def _put(self, rows: DataFrame) -> None:
        dealt = rows.repartition(*_PLACE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        dealt.partitionBy(*_PLACE).parquet(self.path)

    def create(self, changelog: DataFrame) -> None:
        """Start the table from a changelog, or from a part of it that reaches up to a checkpoint."""
        rows = compact_latest(changelog.select(*COLUMNS))
        self._put(rows.withColumn("bucket", self.bucket(F.col("key"))))

    def only(self, places: DataFrame) -> DataFrame:
        """Stored rows of some folders (topic, partition, bucket); other folders are not opened."""
        few = places.distinct().limit(NAMED + 1).collect()
        if len(few) > NAMED:
            return self._stored().join(places.distinct(), _PLACE, "left_semi")
        by: dict[tuple[str, int], list[int]] = {}
        for r in few:
            by.setdefault((r.topic, r.partition), []).append(r.bucket)
        pick = F.lit(False)
        for (topic, partition), buckets in by.items():
            pick = pick | ((F.col("topic") == topic) & (F.col("partition") == partition) & F.col("bucket").isin(buckets))
        return self._stored().where(pick)

    def merge(self, changelog: DataFrame, checkpoints: DataFrame) -> None:
        """Apply what the changelog holds from each partition's checkpoint on.

        ``checkpoints`` holds ``topic, partition, position``. A partition without one is
        rebuilt from its start: keys stored for it that its log does not name are emptied.
        """
        marks = checked_broadcast(checkpoints.select("topic", "partition", F.col("position").alias("_from")), BROADCAST_PARTITIONS)
        log = changelog.select(*COLUMNS).join(marks, ["topic", "partition"], "left")
        delta = log.where(F.col("_from").isNull() | (F.col("offset") >= F.col("_from"))).drop("_from").withColumn("bucket", self.bucket(F.col("key")))
        delta = written(delta, "state-delta")
        stale = self._stored().join(marks, ["topic", "partition"], "left_anti")
        named = delta.select("topic", "partition", "key").distinct()
        emptied = stale.join(named, ["topic", "partition", "key"], "left_anti").withColumn("value", F.lit(None).cast("binary"))
        touched = delta.where(F.col("key").isNotNull()).select(*_PLACE).distinct()
        stored = self.only(touched.join(marks.select("topic", "partition"), ["topic", "partition"], "left_semi"))
        # a repeated merge finds its own records; they come with the delta again
        kept = stored.join(marks, ["topic", "partition"]).where(F.col("offset") < F.col("_from")).drop("_from")
        merged = compact_latest(kept.unionByName(delta)).unionByName(emptied)
        self._put(written(merged, "state-merged"))

    def live(self) -> DataFrame:
        """Current rows, without deleted keys."""
        return self._stored().where(F.col("value").isNotNull()).select(*COLUMNS)

    def get(self, topic: str, key: bytes) -> DataFrame:
        """The current row of one key, or none. Opens the key's bucket only, in each partition of the topic."""
        wanted = F.lit(bytearray(key))
        bucket = self.spark.range(1).select(self.bucket(wanted).alias("b")).first()["b"]
        found = self._stored().where((F.col("topic") == topic) & (F.col("bucket") == bucket) & (F.col("key") == wanted))
        return found.where(F.col("value").isNotNull()).select(*COLUMNS)
