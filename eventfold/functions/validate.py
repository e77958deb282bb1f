"""Payload and command checks as boolean columns over typed structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventfold.functions import jsonlax as J
from eventfold.lifecycle import ORDER_LIFECYCLE, PAYMENT_METHODS, Lifecycle


#: Event types whose payload has rules.
PAYLOAD_TYPES = ("ORDER_CREATED", "SHIPPED")


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def line_total(item: Column) -> Column:
    """Quantity times unit price in minor units; NULL instead of an overflowed value."""
    return F.try_multiply(item["qty"], item["unit_price"])


def order_total(items: Column) -> Column:
    """Sum of the line totals; NULL when one line, or the sum, leaves the bigint range."""
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda acc, it: F.try_add(acc, line_total(it)))


def as_order_created(root: Column, path: str = "$") -> Column:
    """Typed view of the ORDER_CREATED payload at ``path``; fields that do not fit are NULL."""
    items = F.try_variant_get(
        root, f"{path}.items", "array<struct<sku:variant,qty:variant,unit_price:variant>>"
    )
    return F.struct(
        J.text(J.at(root, f"{path}.customer_id")).alias("customer_id"),
        F.transform(
            items,
            lambda it: F.struct(
                J.text(it["sku"]).alias("sku"),
                J.integer(it["qty"]).alias("qty"),
                J.integer(it["unit_price"]).alias("unit_price"),
            ),
        ).alias("items"),
        J.integer(J.at(root, f"{path}.total_amount")).alias("total_amount"),
        F.struct(
            J.text(J.at(root, f"{path}.payment.method")).alias("method"),
            J.text(J.at(root, f"{path}.payment.reference")).alias("reference"),
            J.integer(J.at(root, f"{path}.payment.amount")).alias("amount"),
        ).alias("payment"),
    )


def as_shipped(root: Column, path: str = "$") -> Column:
    """Typed view of the SHIPPED payload at ``path``."""
    return F.struct(
        J.text(J.at(root, f"{path}.carrier")).alias("carrier"),
        J.text(J.at(root, f"{path}.tracking_number")).alias("tracking_number"),
    )


def item_ok(item: Column) -> Column:
    return _yes((F.length(item["sku"]) >= 1) & (item["qty"] > 0) & (item["unit_price"] > 0))


def payment_ok(payment: Column) -> Column:
    return _yes(
        payment["method"].isin(*PAYMENT_METHODS)
        & (F.length(payment["reference"]) >= 1)
        & (payment["amount"] >= 0)
    )


def created_reasons(created: Column) -> Column:
    """Names of the ORDER_CREATED rules a typed payload breaks; empty when valid.

    The two total rules are checked only once every field is well formed.
    """
    items, total, payment = created["items"], created["total_amount"], created["payment"]
    customer = _yes(F.length(created["customer_id"]) >= 1)
    filled = _yes(F.size(items) >= 1)
    lines = _yes(F.forall(items, item_ok))
    shape = customer & filled & lines & total.isNotNull() & payment_ok(payment)
    return F.array_compact(
        F.array(
            F.when(~customer, F.lit("customer_id")),
            F.when(~filled, F.lit("items")),
            F.when(filled & ~lines, F.lit("item")),
            F.when(total.isNull(), F.lit("total_amount")),
            F.when(~payment_ok(payment), F.lit("payment")),
            F.when(shape & ~order_total(items).eqNullSafe(total), F.lit("total_mismatch")),
            F.when(
                shape & order_total(items).eqNullSafe(total) & ~payment["amount"].eqNullSafe(total),
                F.lit("payment_mismatch"),
            ),
        )
    )


def created_ok(created: Column) -> Column:
    """Whether ``created_reasons`` would be empty."""
    items, total, payment = created["items"], created["total_amount"], created["payment"]
    return _yes(
        (F.length(created["customer_id"]) >= 1)
        & (F.size(items) >= 1)
        & F.forall(items, item_ok)
        & payment_ok(payment)
        & (payment["amount"] == total)
        & (order_total(items) == total)
    )


def shipped_ok(shipped: Column) -> Column:
    """Whether ``shipped_reasons`` would be empty."""
    return _yes((F.length(shipped["carrier"]) >= 1) & (F.length(shipped["tracking_number"]) >= 1))


def shipped_reasons(shipped: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(~_yes(F.length(shipped["carrier"]) >= 1), F.lit("carrier")),
            F.when(~_yes(F.length(shipped["tracking_number"]) >= 1), F.lit("tracking_number")),
        )
    )


def payload_reasons(event_type: Column, created: Column, shipped: Column) -> Column:
    """Pick the rules by event type; types without a declared payload accept any object."""
    none = F.array().cast("array<string>")
    return (
        F.when(event_type == "ORDER_CREATED", created_reasons(created))
        .when(event_type == "SHIPPED", shipped_reasons(shipped))
        .otherwise(none)
    )


def command_payload_reasons(
    event_type: Column, payload: Column, lifecycle: Lifecycle = ORDER_LIFECYCLE
) -> Column:
    """The same dispatch straight from an untyped payload."""
    return payload_reasons(event_type, as_order_created(payload), as_shipped(payload))
