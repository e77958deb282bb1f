"""The command side: order creation, the per-order transition guard, deletes and lookups.

A lifecycle in a line makes the guard a set of running minima. The order reaches step r at
the first good command for r after it reached step r-1, whatever else came between. So the
state before any command follows from a handful of positions per order, and its sequence
number from a running count. No order's commands are ever gathered into one value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventfold.functions.validate import PAYLOAD_TYPES, command_payload_reasons, line_total
from eventfold.lifecycle import ORDER_LIFECYCLE, PAYMENT_METHODS, Lifecycle
from eventfold.plans.hot import BLOCK_ROWS, BROADCAST_KEYS, hot_keys
from eventfold.plans.scan import running
from eventfold.plans.small import checked_broadcast
from eventfold.session import written


def check_creates(headers: DataFrame, lines: DataFrame) -> DataFrame:
    """Validate creation requests held as a header table and a line table.

    Lines are combined per command before they meet the headers, so a command may have any
    number of lines. Adds ``total_amount``, ``payload_ok`` and ``payload_reason``.
    """
    item = F.struct("qty", "unit_price")
    bad = ~F.coalesce(
        (F.length("sku") >= 1) & (F.col("qty") > 0) & (F.col("unit_price") > 0), F.lit(False)
    )
    summed = lines.groupBy("cmd_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), F.try_sum(line_total(item)).alias("total_amount")
    )
    c = F.col
    filled = F.coalesce(c("n"), F.lit(0)) > 0
    reason = (
        F.when(~F.coalesce(F.length("customer_id") >= 1, F.lit(False)), F.lit("customer_id is empty"))
        .when(~filled, F.lit("items is empty"))
        .when(c("bad") > 0, F.lit("an item is invalid"))
        .when(
            ~F.coalesce(
                c("method").isin(*PAYMENT_METHODS) & (F.length("reference") >= 1) & (c("amount") >= 0), F.lit(False)
            ),
            F.lit("payment is invalid"),
        )
        .when(c("total_amount").isNull(), F.lit("total_amount is out of range"))
        .when(
            c("amount") != c("total_amount"),
            F.format_string("payment.amount %d does not equal total_amount %d", c("amount"), c("total_amount")),
        )
    )
    checked = headers.join(summed, "cmd_id", "left").withColumn("payload_reason", reason)
    return checked.withColumn("payload_ok", c("payload_reason").isNull()).select(
        *headers.columns, "total_amount", "payload_ok", "payload_reason"
    )


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def _reach(lifecycle: Lifecycle):
    """Name and condition of each position to find, in order; a condition may use earlier ones."""
    good = F.col("payload_ok") & F.col("publish_ok")
    out = [("t1", _is("create") & good)]
    after_birth = F.col("cmd_id") > F.col("t1")
    out.append(("gone", _is("delete") & F.col("publish_ok") & after_birth))
    living = F.coalesce(F.col("cmd_id") < F.col("gone"), F.lit(True))
    for rank in range(2, len(lifecycle.steps) + 1):
        event = lifecycle.steps[rank - 1][0]
        step = _is("advance") & good & (F.col("event_type") == event)
        out.append((f"t{rank}", step & living & (F.col("cmd_id") > F.col(f"t{rank - 1}"))))
    return out


def _marks_by_window(commands: DataFrame, lifecycle: Lifecycle) -> DataFrame:
    whole = (
        Window.partitionBy("order_id")
        .orderBy("cmd_id")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    for name, condition in _reach(lifecycle):
        commands = commands.withColumn(name, F.min(F.when(condition, F.col("cmd_id"))).over(whole))
    return commands


def _marks_by_join(commands: DataFrame, lifecycle: Lifecycle, few: bool) -> DataFrame:
    """The same positions for hot orders: one combined aggregate per position, broadcast
    where the hot orders were counted and are few."""
    for name, condition in _reach(lifecycle):
        found = commands.groupBy("order_id").agg(F.min(F.when(condition, F.col("cmd_id"))).alias(name))
        commands = commands.join(F.broadcast(found) if few else found, "order_id", "left")
    return commands


def check_advances(commands: DataFrame, lifecycle: Lifecycle = ORDER_LIFECYCLE) -> DataFrame:
    """Check the payloads of advance commands before any sequence is reserved. Narrow.

    Where the commands have ``payload``, JSON text, it decides ``payload_ok`` and
    ``payload_reason`` of each advance; other kinds keep theirs. Text that is no JSON breaks
    every rule of its type; a missing payload counts as an empty object.
    """
    if "payload" not in commands.columns:
        return commands
    # Each step is its own projection, so a payload is parsed once, and only where it has rules.
    advance, broken = F.col("kind") == "advance", F.col("_broken")
    parsed = F.coalesce(F.try_parse_json(F.coalesce("payload", F.lit("{}"))), F.parse_json(F.lit("null")))
    text = F.when(F.size(broken) > 0, F.concat(F.array_join(broken, ", "), F.when(F.size(broken) > 1, " are empty").otherwise(" is empty")))
    return (
        commands.withColumn("_parsed", F.when(advance & F.col("event_type").isin(*PAYLOAD_TYPES), parsed))
        .withColumn("_broken", F.when(advance, command_payload_reasons(F.col("event_type"), F.col("_parsed"), lifecycle)))
        .withColumn("payload_reason", F.when(advance, text).otherwise(F.col("payload_reason")))
        .withColumn("payload_ok", F.when(advance, F.size(broken) == 0).otherwise(F.col("payload_ok")))
        .drop("payload", "_parsed", "_broken")
    )


def guard(
    commands: DataFrame,
    lifecycle: Lifecycle = ORDER_LIFECYCLE,
    *,
    find_hot: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Run every command against its order, in ``cmd_id`` order, and say what came of it.

    Input: ``cmd_id`` (unique), ``kind`` (create, advance, delete), ``order_id``,
    ``event_type``, ``force``, ``publish_ok``, the ``payload`` of advances, see
    ``check_advances``, and ``payload_ok``, ``payload_reason`` as ``check_creates`` gives them. Adds
    ``status``, ``sequence``, ``state_before``, ``state_after`` and ``reason``. Rules apply
    in this order: unknown order 404, bad payload 422, illegal step 409 unless forced, then
    the next sequence is taken. A failed publish (502) keeps the sequence and not the state.
    A forced illegal step takes a sequence and leaves the state.

    The commands are written once and orders with more than ``block_rows`` of them take the
    path without a window over the order. Without ``find_hot`` none is looked for.
    """
    if not lifecycle.is_linear:
        raise ValueError("the batch guard needs a lifecycle in a line; stream a branching one")
    steps = len(lifecycle.steps)
    pos = F.col("cmd_id")
    commands = check_advances(commands, lifecycle)

    def judged(rows: DataFrame) -> DataFrame:
        alive = F.coalesce(pos > F.col("t1"), F.lit(False)) & F.coalesce(pos <= F.col("gone"), F.lit(True))
        rank = F.when(
            alive,
            F.lit(1) + sum(
                (F.coalesce(pos > F.col(f"t{r}"), F.lit(False)).cast("int") for r in range(2, steps + 1)), F.lit(0)
            ),
        ).otherwise(0)
        legal = F.coalesce(lifecycle.rank(F.col("event_type")) == F.col("rank") + 1, F.lit(False))
        return (
            rows.withColumn("alive", alive)
            .withColumn("rank", rank)
            .withColumn("legal", legal)
            .withColumn(
                "reserved",
                F.col("alive") & _is("advance") & F.col("payload_ok") & (F.col("force") | F.col("legal")),
            )
        )

    def counted_by_window(rows: DataFrame) -> DataFrame:
        upto = Window.partitionBy("order_id").orderBy("cmd_id").rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        return rows.withColumn("taken", F.sum(F.col("reserved").cast("bigint")).over(upto))

    def counted_by_block(rows: DataFrame) -> DataFrame:
        return running(
            rows, ["order_id"], "cmd_id", {"taken": ("sum", F.col("reserved").cast("bigint"))}, block_rows
        )

    columns = commands.columns
    if find_hot:
        commands = written(commands, "commands")
        keys = hot_keys(commands, "order_id", block_rows).select("order_id")
        n = keys.count()
    if not find_hot or not n:
        counted = counted_by_window(judged(_marks_by_window(commands, lifecycle)))
    else:
        small = checked_broadcast(keys, BROADCAST_KEYS)
        cold = counted_by_window(judged(_marks_by_window(commands.join(small, "order_id", "left_anti"), lifecycle)))
        hot = written(commands.join(small, "order_id").select(*columns), "hot-commands")
        big = counted_by_block(judged(_marks_by_join(hot, lifecycle, n <= BROADCAST_KEYS)))
        counted = cold.unionByName(big)
    return _outcome(counted, columns, lifecycle)


def _outcome(rows: DataFrame, columns: Sequence[str], lifecycle: Lifecycle) -> DataFrame:
    c = F.col
    state = F.get(F.array(*[F.lit(s) for s in lifecycle.states]), c("rank") - 1)
    create, advance, delete = _is("create"), _is("advance"), _is("delete")
    again = create & F.coalesce(c("cmd_id") > c("t1"), F.lit(False))
    status = (
        F.when(again, 409)
        .when(create & ~c("payload_ok"), 422)
        .when(create, F.when(c("publish_ok"), 201).otherwise(502))
        .when(~c("alive"), 404)
        .when(delete, F.when(c("publish_ok"), 204).otherwise(502))
        .when(~c("payload_ok"), 422)
        .when(~c("reserved"), 409)
        .otherwise(F.when(c("publish_ok"), 200).otherwise(502))
    )
    expected = lifecycle.expected_next(c("state_before"))
    illegal = F.when(
        expected.isNotNull(),
        F.format_string(
            "order %s is %s; expected %s but got %s", c("order_id"), c("state_before"), expected, c("event_type")
        ),
    ).otherwise(
        F.format_string(
            "order %s is %s and its lifecycle is complete; %s cannot follow",
            c("order_id"), c("state_before"), c("event_type"),
        )
    )
    reason = (
        F.when(c("status") == 404, F.concat(F.lit("no order "), c("order_id")))
        .when(c("status") == 422, c("payload_reason"))
        .when((c("status") == 409) & create, F.concat(F.lit("order exists "), c("order_id")))
        .when(c("status") == 409, illegal)
        .when(c("status") == 502, F.lit("publish failed"))
    )
    sequence = F.when(c("status") == 201, F.lit(1).cast("bigint")).when(c("reserved"), c("taken") + 1)
    after = (
        F.when(c("status") == 201, F.lit(lifecycle.states[0]))
        .when((c("status") == 200) & c("legal"), lifecycle.resulting(c("event_type")))
        .when(c("status") == 204, F.lit(None))
        .otherwise(c("state_before"))
    )
    return (
        rows.withColumn("status", status)
        .withColumn("state_before", F.when(c("alive"), state))
        .select(
            *columns,
            "status",
            sequence.alias("sequence"),
            "state_before",
            after.alias("state_after"),
            reason.alias("reason"),
        )
    )


def accepted_events(results: DataFrame) -> DataFrame:
    """Events that reached the log."""
    return results.where(F.col("status").isin(200, 201)).select(
        "cmd_id", "order_id", "sequence",
        F.when(_is("create"), F.lit("ORDER_CREATED")).otherwise(F.col("event_type")).alias("event_type"),
        "state_after",
        (F.col("force") & _is("advance")).alias("forced"),
    )


def burned_sequences(results: DataFrame) -> DataFrame:
    """Sequence numbers spent on publishes that failed. Readers will see a gap there."""
    return results.where((F.col("status") == 502) & F.col("sequence").isNotNull()).select(
        "cmd_id", "order_id", "sequence", "event_type", "state_after"
    )


def deletes(results: DataFrame) -> DataFrame:
    """Orders removed, each one a tombstone to publish."""
    return results.where(F.col("status") == 204).select("cmd_id", "order_id", "state_before")


def rejections(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") >= 400).select("cmd_id", "kind", "order_id", "status", "reason")


def orders_after(results: DataFrame, lifecycle: Lifecycle = ORDER_LIFECYCLE) -> DataFrame:
    """Where every live order stands. Combined before the shuffle."""
    place = F.array_position(F.array(*[F.lit(s) for s in lifecycle.states]), F.col("state_after"))
    summed = results.groupBy("order_id").agg(
        F.max(F.coalesce(place, F.lit(0).cast("bigint"))).alias("rank"),
        F.max("sequence").alias("last_sequence"),
        F.max((F.col("status") == 204).cast("int")).alias("gone"),
    )
    state = F.get(F.array(*[F.lit(s) for s in lifecycle.states]), (F.col("rank") - 1).cast("int"))
    return summed.where((F.col("rank") > 0) & (F.col("gone") == 0)).select(
        "order_id",
        state.alias("state"),
        "last_sequence",
        lifecycle.expected_next(state).alias("expected_next_event"),
    )
