"""The bucketed state table: merges touch only their buckets, lookups open one."""

import glob
import os

from pyspark.sql import functions as F

from eventfold.operators import changelog as C
from eventfold.operators.statetable import COLUMNS, StateTable
from helpers import log_of, record

TOPIC = "order-fold.inventory-service"


def entry(i, key, value, partition=0):
    return record(i, value, key=key, topic=TOPIC, partition=partition)


def changelog(spark):
    rows = [entry(i, b"k%d" % (i % 40), b"v%d" % i, partition=i % 40 % 3) for i in range(0, 120)]
    rows += [entry(200, b"k3", None), entry(201, b"k6", b"new"), entry(202, b"k99", b"first"), entry(203, None, b"no key")]
    return log_of(spark, rows)


def files(path):
    return {f.removeprefix(path): os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*/*/part-*")}


def rows(df):
    return sorted((r.partition, r.offset, bytes(r.key), bytes(r.value)) for r in df.collect())


def test_a_merge_replaces_touched_buckets_only(spark, tmp_path):
    log, path = changelog(spark), str(tmp_path / "state")
    table = StateTable(spark, path, 16)
    table.create(log.where("offset < 150"))
    before = files(path)
    marks = spark.createDataFrame([(TOPIC, p, 150) for p in range(3)], "topic string, partition int, position bigint")
    table.merge(log, marks)
    after = files(path)
    kept = {os.path.dirname(f) for f in before if after.get(f) == before[f]}
    changed = {os.path.dirname(f) for f in after} - kept
    touched = log.where("offset >= 150 and key is not null").select(table.bucket(F.col("key")).alias("b")).distinct().collect()
    assert {int(d.rsplit("=", 1)[1]) for d in changed} == {r.b for r in touched} and len(kept) > 10
    assert rows(table.live()) == rows(C.current_table(log))
    table.merge(log, marks)  # the same delta again
    assert rows(table.live()) == rows(C.current_table(log))


def test_a_partition_without_a_checkpoint_is_rebuilt(spark, tmp_path):
    log, table = changelog(spark), StateTable(spark, str(tmp_path / "state"), 4)
    spoiled = log.where("offset < 150").select(*COLUMNS).withColumn("value", F.when(F.col("partition") == 1, F.encode(F.lit("spoiled"), "UTF-8")).otherwise(F.col("value")))
    lost = log_of(spark, [entry(7, b"never logged", b"x", partition=1)])
    table.create(spoiled.unionByName(lost.select(*COLUMNS)))
    marks = spark.createDataFrame([(TOPIC, p, 150) for p in (0, 2)], "topic string, partition int, position bigint")
    table.merge(log, marks)
    assert rows(table.live()) == rows(C.current_table(log))


def test_a_lookup_opens_one_bucket(spark, tmp_path):
    log, table = changelog(spark), StateTable(spark, str(tmp_path / "state"), 16)
    table.create(log)
    found = table.get(TOPIC, b"k6")
    assert [bytes(r.value) for r in found.collect()] == [b"new"]
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in scan[scan.index("PartitionFilters") :].split("PushedFilters")[0] and "Exchange" not in scan
    assert table.get(TOPIC, b"k3").count() == 0 and table.get(TOPIC, b"unknown").count() == 0
