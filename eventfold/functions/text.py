"""Keys, identifiers and fixed-format report lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error text longer than this is cut, with an ellipsis.
MAX_ERROR_CHARS = 500


def key_text(key: Column) -> Column:
    """A record key as text, with placeholders for a missing or undecodable one."""
    as_text = key.cast("string")
    return (
        F.when(key.isNull(), F.lit("<null>"))
        .when(F.is_valid_utf8(as_text), as_text)
        .otherwise(F.lit("<undecodable-key>"))
    )


def strict_key_text(key: Column) -> Column:
    """A record key as text; a missing or undecodable key stops the job."""
    as_text = key.cast("string")
    return F.when(key.isNotNull() & F.is_valid_utf8(as_text), as_text).otherwise(
        F.raise_error(F.lit("record without a readable key"))
    )


def new_order_id(seed: Column) -> Column:
    """Twelve hex digits behind a prefix, repeatable for one command."""
    return F.concat(F.lit("ord-"), F.substring(F.sha2(seed.cast("string"), 256), 1, 12))


def new_event_id(topic: Column, partition: Column, offset: Column) -> Column:
    """Identifier for an event that carries none. Derived from its place in the log, so a
    re-read or a retried task gives the same one."""
    return F.sha2(F.concat_ws("/", topic, partition.cast("string"), offset.cast("string")), 256)


def describe_error(message: Column) -> Column:
    """One line of error text, trimmed and cut."""
    flat = F.regexp_replace(F.replace(F.coalesce(message, F.lit("")), F.lit("\n"), F.lit(" ")), r"^\s+|\s+$", "")
    shown = F.when(flat == "", F.lit("<no message>")).otherwise(flat)
    return F.when(
        F.length(shown) > MAX_ERROR_CHARS,
        F.concat(F.substring(shown, 1, MAX_ERROR_CHARS), F.lit("…")),
    ).otherwise(shown)


def pad_right(value: Column, width: int) -> Column:
    """Pad without ever cutting, unlike ``rpad``."""
    return F.rpad(value, F.greatest(F.lit(width), F.length(value)), F.lit(" "))


def pad_left(value: Column, width: int, fill: str = "0") -> Column:
    """Pad in front without ever cutting, unlike ``lpad``."""
    return F.lpad(value, F.greatest(F.lit(width), F.length(value)), F.lit(fill))


def render_violation(kind: Column, order_id: Column, sequence: Column, expected: Column, observed: Column) -> Column:
    return F.format_string(
        "VIOLATION type=%s order_id=%s seq=%d expected=%s observed=%s",
        kind, order_id, sequence, expected, observed,
    )


def render_dead_letter(key: Column, headers_map: Column) -> Column:
    """Two-line listing of a dead letter; missing headers show as a question mark."""
    from eventfold.functions import headers as H

    def h(name, default="?"):
        return F.coalesce(F.try_element_at(headers_map, F.lit(name)), F.lit(default))

    shown_key = F.when(key.isNull() | (F.length(key) == 0), F.lit("<null>")).otherwise(
        F.make_valid_utf8(key.cast("string"))
    )
    return F.concat(
        F.lit("  "), pad_right(shown_key, 24),
        F.lit(" service="), pad_right(h(H.SERVICE), 13),
        F.lit(" group="), pad_right(h(H.CONSUMER_GROUP), 22),
        F.lit(" attempts="), pad_right(h(H.ATTEMPTS_MADE), 2),
        F.lit(" origin="), h(H.ORIGINAL_TOPIC),
        F.lit("-"), h(H.ORIGINAL_PARTITION), F.lit("@"), h(H.ORIGINAL_OFFSET),
        F.lit("\n      "), h(H.ERROR_CLASS), F.lit(": "), h(H.ERROR_MESSAGE, "<no message>"),
    )


def target_orders(order_id: Column, listed: str | None) -> Column:
    """Whether an order is in a comma list; an empty list means every order."""
    names = [part.strip() for part in (listed or "").split(",") if part.strip()]
    return order_id.isin(names) if names else F.lit(True)
