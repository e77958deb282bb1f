"""The per-order fold and everything read off it.

One shuffle serves all outputs: rows are partitioned and sorted by order once, running
aggregates along each order give the state of every group before and after a record, and
only then are the rows fanned out to the groups. Orders too long for one task take a second path: they are cut into
blocks of rows, and one row per block carries the state over, see :func:`_carry_blocks`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventfold.functions import text as X
from eventfold.lifecycle import ORDER_LIFECYCLE, Lifecycle
from eventfold.operators.decode import parse_event
from eventfold.operators.routing import OUTCOME, divided, per_service, with_delivery
from eventfold.operators.services import DEFAULT_SERVICES, Handler, ServiceSpec
from eventfold.plans.hot import BLOCK_ROWS, PART_ROWS, split
from eventfold.plans.scan import running
from eventfold.plans.small import checked_broadcast
from eventfold.schemas import FOLD_VALUE_TYPE, SNAPSHOT_TOPIC
from eventfold.session import written
from eventfold.sources.offsets import BROADCAST_PARTITIONS

GUARDED = "guarded"
LAST_WRITE = "last_write"
#: Rows that a task of the fold gets before the fan-out to the groups.
TASK_ROWS = 1 << 18
#: Ranges of the merged changelog that may be shorter than ``PART_ROWS``.
SHORT_RANGES = 64
#: Order columns of a log read from several topics.
MERGED = ("arrival", "topic_rank", "offset")

_SLIM = [
    "topic", "partition", "offset", "timestamp", "order_id", "sequence", "event_type", "event_id",
    "is_tombstone", "is_poison", "attempt", "retry_target",
]


@dataclass(frozen=True)
class Reset:
    """From this offset on, a group starts without memory of a partition."""

    group_id: str
    topic: str
    partition: int
    offset: int


@dataclass(frozen=True)
class Deliveries:
    """Rows of ordinary orders, and those of hot ones with their blocks (None: no hot order).

    ``undivided`` are the same two before the fan-out, with the outcome for each of the
    ``services`` (``per_service``), for whoever scans an order once for all groups.
    """

    cold: DataFrame
    hot: DataFrame | None = None
    undivided: tuple[DataFrame, DataFrame | None] | None = None
    services: Sequence[ServiceSpec] = DEFAULT_SERVICES


def deliveries(
    log: DataFrame,
    services: Sequence[ServiceSpec] = DEFAULT_SERVICES,
    handler: Handler | None = None,
    *,
    find_hot: bool = True,
    block_rows: int = BLOCK_ROWS,
    merge_topics: Sequence[str] = (),
    extra: Sequence[str] = (),
    order: Sequence[str] = ("offset",),
    lifecycle: Lifecycle = ORDER_LIFECYCLE,
    snapshot_topic: str = SNAPSHOT_TOPIC,
) -> Deliveries:
    """Rows that touch a fold: events with their handler's outcome, and tombstones.

    Decodes once, drops the payload and writes the narrow rows, which count the rows of each
    decoded order id. Rows shuffle once by order (hot ones by order and block); they fan out
    to the groups behind the scan of :func:`history`. Without ``find_hot`` nothing is written and no order is cut, for
    logs known to hold no order of more than ``block_rows`` records.

    Offsets order the records of one topic. When deletes arrive on a topic of their own,
    ``merge_topics`` names the topics, and :func:`merged_order` interleaves them; pass
    ``MERGED`` as the order of :func:`history` then. Otherwise ``order`` is the one that
    :func:`history` gets; it may use the log's ``extra`` columns.
    """
    decoded = with_delivery(parse_event(log, with_payload=False, lifecycle=lifecycle))
    slim = decoded.withColumn(
        "order_id", F.when(F.col("is_tombstone"), X.key_text(F.col("key"))).otherwise(F.col("order_id"))
    ).select(*_SLIM, *extra)
    if merge_topics:
        slim = merged_order(slim, merge_topics, block_rows, log)
    slim = slim.where(~F.col("is_poison") & (F.col("is_tombstone") | (F.col("topic") != snapshot_topic)))
    cold, hot, tasks = slim, None, []
    if find_hot:
        along = MERGED if merge_topics else (*order, "topic", "partition")
        kept = written(slim, "deliveries")
        cold, hot = split(kept, "order_id", along, block_rows)
        tasks = [max(2 * log.sparkSession.sparkContext.defaultParallelism, -(-kept.count() // TASK_ROWS))]

    def delivered(rows: DataFrame) -> DataFrame:
        return per_service(rows, services, handler, snapshot_topic).drop("is_poison")

    whole = (delivered(cold.repartition(*tasks, "order_id")), None if hot is None else delivered(hot.repartition("order_id", "block")))
    return Deliveries(*[None if rows is None else _mine(divided(rows, services)) for rows in whole], whole, services)


def merged_order(
    rows: DataFrame, topics: Sequence[str], block_rows: int = BLOCK_ROWS, log: DataFrame | None = None
) -> DataFrame:
    """Add the columns of ``MERGED``, one order over several topics that keeps each topic's own.

    A record counts as arriving no earlier than those before it in its partition, which is
    a running maximum of timestamps. Equal arrivals go by the topics' order given. ``log``,
    when ``rows`` were decoded from it, supplies the block summaries without the decoding.
    """
    rank = F.array_position(F.array(*[F.lit(t) for t in topics]), F.col("topic"))
    timed = running(
        rows, ["topic", "partition"], "offset", {"arrival": ("max", F.unix_micros("timestamp"))}, block_rows, log
    )
    return timed.withColumn("topic_rank", rank)


def history(
    rows: Deliveries,
    mode: str = GUARDED,
    *,
    resets: Sequence[Reset] = (),
    order: Sequence[str] = ("offset",),
    lifecycle: Lifecycle = ORDER_LIFECYCLE,
) -> DataFrame:
    """State of each order before (``prev``, ``prev_handled``) and after (``cur``, ``handled``) every row.

    ``guarded``: the highest sequence wins and, among equals, the first delivery, so the fold
    never moves back. ``last_write``: the latest delivery wins. A tombstone ends the order's
    memory. ``is_last`` marks the newest row of an order in its group. Ordinary orders need
    no join; hot ones have a plan of their own, and both results are put together.
    """
    once = rows.undivided is not None and not resets
    cold, hot = rows.undivided if once else (rows.cold, rows.hot)
    services = rows.services if once else None
    out = _history(cold, services, mode, resets, order, lifecycle)
    if hot is None:
        return out
    return out.unionByName(_history(hot, services, mode, resets, order, lifecycle).drop("block"))


def _mine(rows: DataFrame) -> DataFrame:
    """Rows that touch the fold of their group; a tombstone is no event for its handler."""
    keep = ~F.col("is_tombstone")
    return rows.where(F.col("route").isin("event", "tombstone")).withColumn(
        "error_class", F.when(keep, F.col("error_class"))
    ).withColumn("handler_ok", keep & F.col("handler_ok"))


def _history(
    rows: DataFrame, services: Sequence[ServiceSpec] | None, mode: str, resets: Sequence[Reset], order: Sequence[str], lifecycle: Lifecycle
) -> DataFrame:
    """History of undivided rows with their ``services``, or of divided ones."""
    if mode == GUARDED:
        ranks = [F.col("sequence").alias("r")] + [(-F.col(c)).alias(f"p{i}") for i, c in enumerate(order)]
    elif mode == LAST_WRITE:
        ranks = [F.col(c).alias(f"p{i}") for i, c in enumerate(order)]
    else:
        raise ValueError(f"unknown fold mode {mode!r}")
    value = F.struct(
        *ranks,
        F.col("sequence").alias("sequence"),
        lifecycle.resulting(F.col("event_type")).alias("state"),
        F.col("event_id").alias("event_id"),
    )
    blocks = ["block"] if "block" in rows.columns else []
    if services is None:
        local = _by_group(rows, value, resets, order, blocks)
    else:
        local = _by_order(rows, services, value, order, blocks)
    keys = ["group_id", "order_id", "lost"]
    whole = _carry_blocks(local, keys) if blocks else local.withColumn("is_last", F.col("_next").isNull())
    stone = F.col("is_tombstone")
    best = (
        F.when(F.col("_v").isNull(), F.col("prev"))
        .when(F.col("prev").isNull() | (F.col("_v") > F.col("prev")), F.col("_v"))
        .otherwise(F.col("prev"))
    )
    # A reset empties the whole partition, so only what came after the last one is still held.
    last_life = F.lit(0)
    for r in resets:
        hit = (F.col("group_id") == r.group_id) & (F.col("topic") == r.topic) & (F.col("partition") == r.partition)
        last_life = last_life + hit.cast("int")
    counted = {f"_{name}{i}" for name in OUTCOME for i in range(len(services or ()))}
    plain = [c for c in rows.columns if c not in {*counted, "service", "group_id", *OUTCOME}]
    return whole.select(
        *plain, "service", "group_id", *OUTCOME,
        "prev",
        "prev_handled",
        F.when(~stone, best).alias("cur"),
        F.when(stone, F.lit(0)).otherwise(F.col("prev_handled") + F.col("handler_ok").cast("bigint")).cast("bigint").alias("handled"),
        (F.col("is_last") & (F.col("lost") == last_life)).alias("is_last"),
    )


def _by_order(rows: DataFrame, services: Sequence[ServiceSpec], value: Column, order: Sequence[str], blocks: Sequence[str]) -> DataFrame:
    """The state before every row for all groups at once, then a row per group.

    An order is sorted and scanned once and not once per group. Every group sees every
    tombstone, so the groups share the epochs.
    """
    every = range(len(services))
    along = Window.partitionBy("_hash", "order_id", *blocks).orderBy(*order)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    total = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stone = F.col("is_tombstone")
    mine = [F.col(f"_route{i}").isin("event", "tombstone").cast("bigint") for i in every]
    done = [(F.col(f"_route{i}") == "event") & F.col(f"_handler_ok{i}") for i in every]
    # The hash sorts as a number. Order ids begin alike, so as first key they cost a whole
    # comparison each time.
    counted = rows.withColumn("_hash", F.xxhash64("order_id")).withColumn("_v", value).withColumns(
        {
            "_epoch": F.coalesce(F.sum(stone.cast("int")).over(before), F.lit(0)),
            **{f"_done{i}": F.coalesce(F.sum(done[i].cast("bigint")).over(before), F.lit(0)) for i in every},
            **{f"_come{i}": F.coalesce(F.sum(mine[i]).over(before), F.lit(0)) for i in every},
            **{f"_all{i}": F.sum(mine[i]).over(total) for i in every},
        }
    )
    # An epoch ends with its tombstone. The struct leads with the epoch, so the running
    # maximum forgets older epochs without sorting the rows a second time.
    tagged = F.struct(F.col("_epoch").alias("e"), F.col("_v").alias("v"))
    known = counted.withColumns(
        {
            **{f"_top{i}": F.max(F.when(done[i], tagged)).over(before) for i in every},
            **{f"_spent{i}": F.coalesce(F.max(F.when(stone, F.col(f"_done{i}"))).over(before), F.lit(0)) for i in every},
        }
    )
    each = {}
    for i in every:
        each[f"_prev{i}"] = F.when(F.col(f"_top{i}.e") == F.col("_epoch"), F.col(f"_top{i}.v"))
        each[f"_prev_handled{i}"] = F.col(f"_done{i}") - F.col(f"_spent{i}")
        each[f"_next{i}"] = F.when(F.col(f"_all{i}") > F.col(f"_come{i}") + 1, F.lit(1))
    out = known.select(*rows.columns, "_epoch", "_v", *[c.alias(name) for name, c in each.items()])
    return (
        _mine(divided(out, services, (*OUTCOME, "prev", "prev_handled", "next")))
        .withColumnRenamed("next", "_next")
        .withColumn("_v", F.when(F.col("handler_ok"), F.col("_v")))
        .withColumn("lost", F.lit(0))
    )


def _by_group(rows: DataFrame, value: Column, resets: Sequence[Reset], order: Sequence[str], blocks: Sequence[str]) -> DataFrame:
    """The same row by row of each group, for groups that lose their memory at places of their own."""
    keys = ["group_id", "order_id", "lost"]
    lost = F.lit(0)
    for r in resets:
        hit = (
            (F.col("group_id") == r.group_id)
            & (F.col("topic") == r.topic)
            & (F.col("partition") == r.partition)
            & (F.col("offset") >= r.offset)
        )
        lost = lost + hit.cast("int")
    # The hash sorts as a number. Order and group ids begin alike, so as first keys they cost a
    # whole comparison each time.
    along = Window.partitionBy("_hash", *keys, *blocks).orderBy(*order)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    stone = F.col("is_tombstone")

    # An epoch ends with its tombstone. The struct leads with the epoch, so the running
    # maximum forgets older epochs without sorting the rows a second time.
    staged = (
        rows.withColumn("lost", lost)
        .withColumn("_hash", F.xxhash64("order_id", "group_id"))
        .withColumn("_epoch", F.coalesce(F.sum(stone.cast("int")).over(before), F.lit(0)))
        .withColumn("_ok", F.coalesce(F.sum(F.col("handler_ok").cast("bigint")).over(before), F.lit(0)))
        .withColumn("_v", F.when(F.col("handler_ok"), value))
        .withColumn("_tagged", F.when(F.col("handler_ok"), F.struct(F.col("_epoch").alias("e"), F.col("_v").alias("v"))))
        .withColumn("_top", F.max("_tagged").over(before))
        .withColumn("_spent", F.coalesce(F.max(F.when(stone, F.col("_ok"))).over(before), F.lit(0)))
        .withColumn("_next", F.lead(F.lit(1)).over(along))
    )
    return staged.withColumn("prev", F.when(F.col("_top.e") == F.col("_epoch"), F.col("_top.v"))).withColumn(
        "prev_handled", F.col("_ok") - F.col("_spent")
    )


def _carry_blocks(local: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring the state of earlier blocks into each block of a hot order.

    One row per block (its last) says whether it holds a tombstone and what is live at its
    end. A running pass over these rows gives the state entering each block.
    """
    tail = F.col("_next").isNull()
    stone = F.col("is_tombstone")
    live = (
        F.when(stone, F.lit(None))
        .when(F.col("_v").isNull(), F.col("prev"))
        .when(F.col("prev").isNull() | (F.col("_v") > F.col("prev")), F.col("_v"))
        .otherwise(F.col("prev"))
    )
    ends = local.where(tail).select(
        *keys,
        "block",
        ((F.col("_epoch") > 0) | stone).cast("int").alias("_ended"),
        live.alias("_live"),
        F.when(stone, F.lit(0)).otherwise(F.col("prev_handled") + F.col("handler_ok").cast("bigint")).alias("_live_n"),
    )
    by_block = Window.partitionBy(*keys).orderBy("block")
    upto = by_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    span = Window.partitionBy(*keys, "_span").orderBy("block").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    entering = (
        ends.withColumn("_span", F.sum("_ended").over(upto))
        .withColumn("_acc", F.max("_live").over(span))
        .withColumn("_acc_n", F.sum("_live_n").over(span))
        .select(
            *keys,
            "block",
            F.lag("_acc").over(by_block).alias("_in"),
            F.lag("_acc_n").over(by_block).alias("_in_n"),
            F.lead(F.lit(1)).over(by_block).isNotNull().alias("_more"),
        )
    )
    joined = local.join(entering, [*keys, "block"], "left")
    fresh = F.col("_epoch") == 0
    return (
        joined.withColumn(
            "prev",
            F.when(
                fresh & F.col("_in").isNotNull() & (F.col("prev").isNull() | (F.col("_in") > F.col("prev"))),
                F.col("_in"),
            ).otherwise(F.col("prev")),
        )
        .withColumn(
            "prev_handled",
            F.col("prev_handled") + F.when(fresh, F.coalesce("_in_n", F.lit(0))).otherwise(F.lit(0)),
        )
        .withColumn("is_last", tail & ~F.coalesce("_more", F.lit(False)))
    )


def judge(hist: DataFrame, lifecycle: Lifecycle = ORDER_LIFECYCLE) -> DataFrame:
    """Per event: whether it is a redelivery, leaves a gap, or breaks the lifecycle.

    A redelivery is a repeat and reports nothing else. Violations are found before the
    handler runs, so a delivery that then fails has reported them already.
    """
    seq, prev_seq, prev_state = F.col("sequence"), F.col("prev.sequence"), F.col("prev.state")
    repeat = F.coalesce(seq <= prev_seq, F.lit(False))
    expected = F.coalesce(prev_seq, F.lit(0)) + 1
    events = hist.where(~F.col("is_tombstone"))
    return (
        events.withColumn("redelivery", repeat)
        .withColumn("expected_sequence", expected)
        .withColumn("seq_gap", ~repeat & (seq != expected))
        .withColumn("illegal", ~repeat & ~lifecycle.is_legal(F.col("event_type"), prev_state))
    )


def violations(judged: DataFrame, lifecycle: Lifecycle = ORDER_LIFECYCLE) -> DataFrame:
    """One row per finding, tagged with where it was seen."""
    prev_state = F.col("prev.state")
    gap = F.when(
        F.col("seq_gap"),
        F.struct(
            F.lit("SEQUENCE_GAP").alias("type"),
            F.col("expected_sequence").cast("string").alias("expected"),
            F.col("sequence").cast("string").alias("observed"),
        ),
    )
    step = F.when(
        F.col("illegal"),
        F.struct(
            F.lit("ILLEGAL_TRANSITION").alias("type"),
            lifecycle.expected_text(prev_state).alias("expected"),
            F.concat(F.col("event_type"), F.lit(" after "), F.coalesce(prev_state, F.lit("None"))).alias("observed"),
        ),
    )
    found = judged.where(F.col("seq_gap") | F.col("illegal")).select(
        "group_id", "order_id", "sequence", "partition", "offset",
        F.explode(F.array_compact(F.array(gap, step))).alias("v"),
    )
    return found.select(
        "group_id", "v.type", "order_id", "sequence", "v.expected", "v.observed", "partition", "offset"
    )


def duplicates_absorbed(judged: DataFrame) -> DataFrame:
    """Handled deliveries that did not move the fold, with what was stored and the count so far."""
    return judged.where(F.col("redelivery") & F.col("handler_ok")).select(
        "group_id", "order_id", "sequence", "partition", "offset",
        F.col("cur.sequence").alias("stored_sequence"),
        F.col("handled").alias("handled_count"),
    )


def final_folds(hist: DataFrame) -> DataFrame:
    """Current fold per group and order: the newest row of each. No further shuffle."""
    return hist.where(F.col("is_last") & F.col("cur").isNotNull()).select(
        "group_id",
        "order_id",
        F.col("cur.sequence").alias("last_sequence"),
        F.col("cur.state").alias("state"),
        F.col("cur.event_id").alias("last_event_id"),
        F.col("handled").alias("handled_count"),
    )


def residue(folds: DataFrame) -> DataFrame:
    """Folds handled more often than their sequence says."""
    return folds.where(F.col("handled_count") > F.col("last_sequence"))


def tombstones(hist: DataFrame) -> DataFrame:
    """Deletes as each group saw them, and whether there was a fold to erase."""
    return hist.where(F.col("is_tombstone")).select(
        "group_id", "order_id", "topic", "partition", "offset", F.col("prev").isNotNull().alias("deleted")
    )


def encode_fold(sequence: Column, state: Column, event_id: Column, handled: Column) -> Column:
    """Stored form of a fold as JSON text; a NULL state is written out."""
    return F.to_json(
        F.struct(
            sequence.alias("last_sequence"),
            state.alias("state"),
            event_id.alias("last_event_id"),
            handled.alias("handled_count"),
        ),
        {"ignoreNullFields": "false"},
    )


def decode_fold(value: Column, lifecycle: Lifecycle = ORDER_LIFECYCLE) -> Column:
    """Stored form back to a struct. A value of another shape stops the job."""
    parsed = F.from_json(value, FOLD_VALUE_TYPE)
    known = parsed["state"].isNull() | parsed["state"].isin(lifecycle.states)
    ok = (
        parsed["last_sequence"].isNotNull() & parsed["last_event_id"].isNotNull()
        & parsed["handled_count"].isNotNull() & known
    )
    return F.when(value.isNull() | ok, parsed).otherwise(
        F.raise_error(F.concat(F.lit("undecodable stored fold: "), value))
    )


def changelog(hist: DataFrame, order: Sequence[str] = ("offset",)) -> DataFrame:
    """Every change of a fold as a changelog record; a delete has no value even if nothing existed.

    Changelog offsets are the source offsets: increasing within a group and partition,
    with holes where nothing was written. For a log of several topics see ``merged_changelog``,
    which takes the columns of its ``order`` along.
    """
    changed = hist.where(F.col("is_tombstone") | F.col("handler_ok"))
    value = F.when(
        ~F.col("is_tombstone"),
        encode_fold(F.col("cur.sequence"), F.col("cur.state"), F.col("cur.event_id"), F.col("handled")),
    )
    return changed.select(
        F.concat(F.lit("order-fold."), F.col("group_id")).alias("topic"),
        "group_id", "partition", *order, "timestamp",
        F.encode("order_id", "UTF-8").alias("key"),
        F.encode(value, "UTF-8").alias("value"),
    )


def range_count(rows: int, block_rows: int) -> int:
    """Ranges for so many rows: short blocks share one beyond ``SHORT_RANGES``, long ones are what a task sorts at most.

    Each costs a task and a block of every map task's shuffle file, so their number follows the rows.
    """
    return min(rows // min(block_rows, TASK_ROWS), max(SHORT_RANGES, rows // PART_ROWS)) + 1


def merged_changelog(hist: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The changelog of a fold over several topics, with positions of its own.

    Source offsets of two topics overlap and say nothing about each other. Positions here are
    dense in each changelog partition and follow the merged order. The records are
    range-partitioned and sorted along it once; the rows before a range and the place inside
    it add up, so no window spans a partition. Both reads see the same written cut.
    """
    records, keys = written(changelog(hist, MERGED), "changelog-records"), ["topic", "partition"]
    dealt = records.repartitionByRange(range_count(records.count(), block_rows), *keys, *MERGED).sortWithinPartitions(*keys, *MERGED)
    # the id counts the rows of a range in this order; its upper bits number the ranges
    placed_by = dealt.withColumn("_at", F.monotonically_increasing_id()).drop(*MERGED)
    cut = written(placed_by, "changelog-ranges").withColumn("_range", F.shiftright("_at", 33))
    sizes = cut.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n")
    small = checked_broadcast(sizes.select(*keys, "_range", (before - F.col("_first")).alias("_shift")), BROADCAST_PARTITIONS)
    placed = cut.join(small, [*keys, "_range"]).withColumn("position", F.col("_at") + F.col("_shift"))
    return placed.select("topic", "group_id", "partition", F.col("position").alias("offset"), "timestamp", "key", "value")


def lookup(folds: DataFrame, group_id: str, order_id: str) -> DataFrame:
    """One stored fold; no row when the order has never been seen."""
    return folds.where((F.col("group_id") == group_id) & (F.col("order_id") == order_id))
