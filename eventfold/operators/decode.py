"""Bytes to events: decode, defaults, validation, with the reasons a record is poison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventfold.functions import jsonlax as J
from eventfold.functions import text as X
from eventfold.functions import validate as V
from eventfold.lifecycle import ORDER_LIFECYCLE, Lifecycle
from eventfold.schemas import ITEMS_TYPE, PAYMENT_TYPE


_BODY = "$[0]"
#: The shape a producer writes. A document that survives parsing into it and printing
#: again byte for byte is that shape exactly: right types, nothing missing, nothing extra.
_EXACT_TYPE = (
    "struct<event_id:string,order_id:string,sequence:bigint,event_type:string,occurred_at:string,"
    f"payload:struct<customer_id:string,items:{ITEMS_TYPE},total_amount:bigint,payment:{PAYMENT_TYPE},"
    "carrier:string,tracking_number:string>>"
)
_FIELDS = ("event_id", "order_id", "sequence", "event_type", "occurred_at", "payload")


def _event_reasons(lifecycle: Lifecycle) -> Column:
    c = F.col
    return F.array_compact(
        F.array(
            F.when(c("raw_event_id").isNotNull() & c("_event_id").isNull(), F.lit("event_id")),
            F.when(c("_order_id").isNull(), F.lit("order_id")),
            F.when(~F.coalesce(c("_sequence") >= 1, F.lit(False)), F.lit("sequence")),
            F.when(~F.coalesce(lifecycle.is_known(c("_event_type")), F.lit(False)), F.lit("event_type")),
            F.when(c("_has_time") & c("_occurred_at").isNull(), F.lit("occurred_at")),
            F.when(c("raw_payload").isNotNull() & ~J.is_object(c("raw_payload")), F.lit("payload")),
        )
    )


def _view(quick: Column, *names: str) -> Column:
    return F.struct(*[quick["payload"][name].alias(name) for name in names])


def _sound(quick: Column, at: Column, lifecycle: Lifecycle) -> Column:
    """Whether a document in the producer's own form breaks no rule."""
    kind, payload = quick["event_type"], quick["payload"]
    return (
        quick["order_id"].isNotNull()
        & (quick["sequence"] >= 1)
        & lifecycle.is_known(kind)
        & (quick["occurred_at"].isNull() | at.isNotNull())
        & F.when(kind == "ORDER_CREATED", V.created_ok(payload)).when(kind == "SHIPPED", V.shipped_ok(payload)).otherwise(F.lit(True))
    )


def parse_event(
    log: DataFrame, with_payload: bool = True, lifecycle: Lifecycle = ORDER_LIFECYCLE
) -> DataFrame:
    """Decode every record's value; narrow, no shuffle.

    Adds ``event_id, order_id, sequence, event_type, occurred_at``, ``reasons`` (rules the
    record breaks) and ``is_tombstone``/``is_poison``. With ``with_payload`` the typed
    payload views ``created`` and ``shipped`` and the raw ``payload`` stay in the result.
    Fields of a poison record are NULL.

    Valid documents in the producer's own compact form take the cheap typed parse, and none of
    the steps behind it is worked out for them. All others (extra or reordered fields, lenient
    types, broken rules, junk) go through a VARIANT. Both give the same result. Each step is
    its own projection, so a parsed value is computed once.
    """
    columns = [c for c in log.columns if c not in ("value",)]
    doc, quick, fast = F.col("doc"), F.col("_quick"), F.col("_fast")
    made_id = X.new_event_id(F.col("topic"), F.col("partition"), F.col("offset"))
    views = {
        "created": F.when(quick["event_type"] == "ORDER_CREATED", _view(quick, "customer_id", "items", "total_amount", "payment")),
        "shipped": F.when(quick["event_type"] == "SHIPPED", _view(quick, "carrier", "tracking_number")),
    }
    # From here on a document in the producer's own form is its fields and no text: every step
    # copies its rows, and the parsed payload is most of one.
    given = F.struct(
        F.coalesce(quick["event_id"], made_id).alias("event_id"),
        *[quick[name].alias(name) for name in ("order_id", "sequence", "event_type")],
        F.coalesce("_quick_at", "timestamp").alias("occurred_at"),
        *([view.alias(name) for name, view in views.items()] if with_payload else []),
    )
    kept = [*columns, "is_tombstone", *(["_text"] if with_payload else [])]
    parsed = (
        log.withColumn("is_tombstone", F.col("value").isNull())
        .withColumn("_text", F.try_validate_utf8(F.col("value").cast("string")))
        .withColumn("_quick", F.from_json("_text", _EXACT_TYPE))
        .withColumn("_quick_at", J.iso_time(quick["occurred_at"]))
        .withColumn("_fast", F.coalesce(_sound(quick, F.col("_quick_at"), lifecycle) & (F.to_json("_quick") == F.col("_text")), F.lit(False)))
        .select(*kept, "_fast", F.when(fast, given).alias("_given"), F.when(~fast, F.col("_text")).alias("_slow"))
        .withColumn("_seal", F.when(F.col("_slow").isNotNull(), F.xxhash64("_slow").cast("string")))
        .withColumn("doc", J.sealed(F.col("_slow"), F.col("_seal")))
        .withColumn("_whole", J.unsealed(doc, F.col("_slow"), F.col("_seal")))
    )
    raw = parsed.select(
        *kept, "_fast", "_given", "doc", "_whole",
        *[J.at(doc, f"{_BODY}.{name}").alias(f"raw_{name}") for name in _FIELDS],
    )
    whole = F.col("_whole")
    typed = raw.select(
        "*",
        F.when(whole, J.text(F.col("raw_event_id"))).alias("_event_id"),
        F.when(whole, J.text(F.col("raw_order_id"))).alias("_order_id"),
        F.when(whole, J.integer(F.col("raw_sequence"))).alias("_sequence"),
        F.when(whole, J.text(F.col("raw_event_type"))).alias("_event_type"),
        F.when(whole, J.time(F.col("raw_occurred_at"))).alias("_occurred_at"),
        F.col("raw_occurred_at").isNotNull().alias("_has_time"),
    )
    typed = typed.withColumn(
        "_created", F.when(F.col("_event_type") == "ORDER_CREATED", V.as_order_created(doc, f"{_BODY}.payload"))
    ).withColumn("_shipped", F.when(F.col("_event_type") == "SHIPPED", V.as_shipped(doc, f"{_BODY}.payload")))
    typed = typed.withColumn("_own", F.when(whole, _event_reasons(lifecycle))).withColumn(
        "_shape", F.when(whole, V.payload_reasons(F.col("_event_type"), F.col("_created"), F.col("_shipped")))
    )
    reasons = (
        F.when(F.col("is_tombstone") | fast, F.array().cast("array<string>"))
        .when(~whole, F.array(F.lit("not_json_object")))
        .when(F.size("_own") > 0, F.col("_own"))
        .otherwise(F.col("_shape"))
    )
    judged = typed.withColumn("reasons", reasons).withColumn("is_poison", F.size("reasons") > 0)
    good = ~F.col("is_poison") & ~F.col("is_tombstone")

    def pick(name: str, slow_value: Column) -> Column:
        return F.when(fast, F.col("_given")[name]).when(good, slow_value).alias(name)

    event = F.struct(
        "is_poison",
        "reasons",
        pick("event_id", F.coalesce("_event_id", made_id)),
        *[pick(name, F.col(f"_{name}")) for name in ("order_id", "sequence", "event_type")],
        pick("occurred_at", F.coalesce("_occurred_at", "timestamp")),
        *([pick(name, F.col(f"_{name}")) for name in views] if with_payload else []),
    )
    # Exploding a one-element array ends the projection chain here. Otherwise every filter or
    # join key on a decoded field is traced back through it, and the plan repeats the parse.
    made = judged.select(*kept, event.alias("_event"))
    out = made.select(*kept, F.explode(F.array("_event")).alias("e")).select(*kept, "e.*")
    if not with_payload:
        return out
    given = F.try_variant_get(F.try_parse_json("_text"), "$.payload", "variant")
    payload = F.when(F.col("order_id").isNotNull(), F.coalesce(given, F.parse_json(F.lit("{}"))))
    return out.select(*[c for c in out.columns if c != "_text"], payload.alias("payload"))


def poison_message(reasons: Column) -> Column:
    """Error text of an undecodable record."""
    return F.concat(F.lit("undecodable message: "), F.array_join(reasons, ", "))
