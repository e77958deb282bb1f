"""Plan shapes that must hold at any size."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventfold.operators import changelog as C
from eventfold.operators import commands as CM
from eventfold.operators import deadletters as DL
from eventfold.operators import fold as O
from eventfold.operators.decode import parse_event
from eventfold.plans.hot import split
from eventfold.registry import commands as RC
from eventfold.session import written
from eventfold.sources import offsets as P
from eventfold.sources.logs import read_log
from eventfold.sources.order_log import fixture_handler, lifecycle_log

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "table")
    lifecycle_log(spark, SF).write.partitionBy("topic").parquet(path)
    return read_log(spark, path, "order-lifecycle")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df) -> int:
    return len(re.findall(r"(?<!Broadcast)Exchange (?:hash|range|Single|Round)", plan(df)))


def test_fold_and_findings_take_one_shuffle(log):
    hist = O.history(O.deliveries(log, handler=fixture_handler, find_hot=False))
    for out in (O.final_folds(hist), O.violations(O.judge(hist)), O.changelog(hist), O.tombstones(hist)):
        assert shuffles(out) == 1
        assert "Join" not in plan(out)
        assert "Python" not in plan(out)


def test_no_window_over_everything(log):
    hist = O.history(O.deliveries(log, handler=fixture_handler, block_rows=4))
    assert "SinglePartition" not in plan(O.final_folds(hist))


def test_hot_orders_spread_over_blocks(spark, log):
    """The hot path partitions rows by order and block, so one order is many tasks' work."""
    rows = O.deliveries(log, block_rows=4)
    text = plan(O.final_folds(O.history(rows)))
    assert re.search(r"hashpartitioning\(order_id#\d+, block#", text)
    cold = O.history(O.Deliveries(rows.cold))
    assert shuffles(O.final_folds(cold)) == 1 and "SortMergeJoin" not in plan(cold)


def test_decode_is_narrow_and_prunes(log):
    narrow = parse_event(log, with_payload=False).select("order_id", "sequence")
    assert shuffles(narrow) == 0
    schema = re.search(r"ReadSchema: (\S+)", plan(narrow)).group(1)
    assert "value" in schema and "headers" not in schema and "key" not in schema


def test_compaction_aggregates_by_hash(log):
    text = plan(C.compact_latest(log))
    assert "HashAggregate" in text and "SortAggregate" not in text and "ObjectHash" not in text


def test_partition_read_reaches_the_scan(log):
    text = plan(P.read_partition_from(log, "order-lifecycle", 1, 500))
    assert "PartitionFilters" in text and "topic" in re.search(r"PartitionFilters: \[(.*?)\]", text).group(1)
    assert "GreaterThanOrEqual(offset,500)" in text and "EqualTo(partition,1)" in text


def test_bounds_read_two_columns(log):
    schema = re.search(r"ReadSchema: (\S+)", plan(P.log_bounds(log))).group(1)
    assert "value" not in schema and "headers" not in schema


def test_bounded_read_broadcasts_the_bounds(log):
    text = plan(P.read_bounded(log, P.fixed_bounds(log)))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_guard_shuffles_commands_once(spark, tmp_path):
    RC.commands(spark, SF).write.parquet(str(tmp_path / "c"))
    table = spark.read.parquet(str(tmp_path / "c"))
    assert shuffles(CM.guard(table, find_hot=False)) == 1
    text = plan(CM.guard(table, block_rows=8))
    assert "SinglePartition" not in text


def test_orders_are_dealt_before_their_records_are_built(spark):
    """A table of one file comes as one task; its records are built and decoded by many."""
    assert lifecycle_log(spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_header_filters_stay_above_the_decoding(log):
    text = plan(DL.replay(log, service="analytics", include_poison=True))
    assert len(re.findall(r"map_from_entries", text)) == 1


def test_short_blocks_share_a_partition(spark):
    """Blocks of a few rows: each holds no more, along the order, without a file for each."""
    rows = written(spark.range(20000).selectExpr("id % 100 AS k", "id AS at"), "rows")
    _, hot = split(rows, "k", ["at"], 4)
    assert len(hot.inputFiles()) <= 4
    sizes = hot.groupBy("block").count().agg({"count": "max"}).first()[0]
    ends = hot.groupBy("k", "block").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    after = F.lead("low").over(Window.partitionBy("k").orderBy("block"))
    assert sizes == 4 and hot.count() == 20000 and ends.withColumn("after", after).where("after <= high").isEmpty()


def test_fold_tasks_grow_with_the_rows(log, monkeypatch):
    monkeypatch.setattr(O, "TASK_ROWS", 16)
    assert re.search(r"hashpartitioning\(order_id#\d+, \d{3,}\)", plan(O.final_folds(O.history(O.deliveries(log)))))


def test_fold_sorts_by_a_number_first(log):
    """Order and group ids begin alike; as the first sort key they are compared whole each time."""
    hist = O.history(O.deliveries(log, handler=fixture_handler, find_hot=False))
    sorts = re.findall(r"Sort \[(\w+)#", plan(hist))
    assert sorts and set(sorts) == {"_hash"}


def test_fold_scans_an_order_once_for_all_groups(log):
    """Rows fan out behind the windows; no window sorts or splits by group."""
    text = plan(O.final_folds(O.history(O.deliveries(log, handler=fixture_handler, find_hot=False))))
    windows = re.findall(r"windowspecdefinition\(([^)]*)", text)
    assert windows and not any("group_id" in w for w in windows)


def test_merged_positions_are_dense_over_many_ranges(spark):
    """One sort numbers the changelog: no window over its records and no join that shuffles them."""
    log = lifecycle_log(spark, SF)
    hist = O.history(O.deliveries(log, handler=fixture_handler, merge_topics=("order-lifecycle",)), order=O.MERGED)
    placed = O.merged_changelog(hist, block_rows=500)
    assert "SortMergeJoin" not in plan(placed)
    ends = placed.groupBy("topic", "partition").agg(F.count("*").alias("n"), F.count_distinct("offset").alias("d"), F.max("offset").alias("m"))
    assert ends.where("n <> d OR m <> n - 1").isEmpty() and ends.count() == 9


def test_ranges_of_the_merged_changelog_follow_its_rows():
    """Short blocks no longer make a range each: 470 million records in blocks of 5,000 rows were 94,000 ranges."""
    assert O.range_count(470_000_000, 5_000) == 7_172
    assert O.range_count(470_000_000, 1 << 20) == 1_793  # a range is what a task sorts, not more
    assert O.range_count(128_000, 5_000) == 26 and O.range_count(0, 500) == 1


def test_two_topic_restore_reads_the_written_ranges(spark, monkeypatch):
    """The changelog lies in written ranges, so it is not written a second time, and they leave the merged order out."""
    from eventfold import session
    from eventfold.registry import changelogs

    names = []

    def noted(df, name):
        names.append((name, set(df.columns)))
        return session.written(df, name)

    monkeypatch.setattr(O, "written", noted)
    monkeypatch.setattr(changelogs, "written", noted)
    assert not changelogs.restore_two_topics(spark, SF).isEmpty()
    ranges = [columns for name, columns in names if name == "changelog-ranges"]
    assert len(ranges) == 1 and not ranges[0] & set(O.MERGED) and "changelog" not in dict(names)
