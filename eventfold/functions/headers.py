"""Record headers: array of (key, bytes) to a string map and back, and the fields they carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventfold.functions import jsonlax as J

#: Header names, fixed values.
SERVICE = "x-service"
CONSUMER_GROUP = "x-consumer-group"
ORIGINAL_TOPIC = "x-original-topic"
ORIGINAL_PARTITION = "x-original-partition"
ORIGINAL_OFFSET = "x-original-offset"
ORIGINAL_TIMESTAMP = "x-original-timestamp"
ATTEMPT = "x-attempt"
RETRY_TARGET = "x-retry-target"
RETRY_AT = "x-retry-at"
ATTEMPTS_MADE = "x-attempts-made"
ERROR_CLASS = "x-error-class"
ERROR_MESSAGE = "x-error-message"
FAILED_AT = "x-failed-at"

_PY_INT = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"


def _readable(headers: Column) -> Column:
    return F.filter(
        F.coalesce(headers, F.array().cast("array<struct<key:string,value:binary>>")),
        lambda h: h["value"].isNotNull() & F.is_valid_utf8(h["value"].cast("string")),
    )


def decode_headers(headers: Column) -> Column:
    """Map of readable headers. Null and non-UTF-8 values are dropped; the last duplicate wins."""
    good = _readable(headers)
    names = F.array_distinct(F.transform(good, lambda h: h["key"]))
    return F.map_from_entries(
        F.transform(
            names,
            lambda n: F.struct(
                n.alias("key"),
                F.element_at(F.filter(good, lambda h: h["key"] == n), -1)["value"]
                .cast("string")
                .alias("value"),
            ),
        )
    )


def header(headers: Column, name: str) -> Column:
    """One header's text, without building the whole map."""
    hits = F.filter(_readable(headers), lambda h: h["key"] == name)
    return F.try_element_at(hits, F.lit(-1))["value"].cast("string")


def encode_headers(mapping: Column) -> Column:
    return F.transform(
        F.map_entries(mapping),
        lambda e: F.struct(e["key"].alias("key"), F.encode(e["value"], "UTF-8").alias("value")),
    )


def int_header(value: Column, default: int) -> Column:
    """Whole number from a header, or ``default`` when it is absent or malformed."""
    parsed = F.when(value.rlike(_PY_INT), F.regexp_replace(F.trim(value), "_", "").try_cast("bigint"))
    return F.coalesce(parsed, F.lit(default).cast("bigint"))


def attempt_of(value: Column) -> Column:
    """Attempt a delivery spends; never below 1."""
    return F.greatest(F.lit(1).cast("bigint"), int_header(value, 1))


def due_time(value: Column) -> Column:
    """When a waiting record becomes due; NULL (due now) if absent or malformed."""
    return J.iso_time(value)


def iso_text(ts: Column) -> Column:
    """UTC ISO-8601 with microseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def message_ts_iso(ts: Column) -> Column:
    return F.coalesce(F.when(F.unix_micros(ts) > 0, iso_text(ts)), F.lit("unknown"))


def origin_of(headers_map: Column, topic: Column, partition: Column, offset: Column, ts: Column) -> Column:
    """Where a record was first published: from its headers, else from the record itself."""
    known = F.try_element_at(headers_map, F.lit(ORIGINAL_TOPIC)).isNotNull()

    def pick(name, fallback, default):
        return F.when(known, F.coalesce(F.try_element_at(headers_map, F.lit(name)), F.lit(default))).otherwise(
            F.coalesce(fallback, F.lit(default))
        )

    return F.struct(
        pick(ORIGINAL_TOPIC, topic, "unknown").alias("topic"),
        pick(ORIGINAL_PARTITION, partition.cast("string"), "-1").try_cast("int").alias("partition"),
        pick(ORIGINAL_OFFSET, offset.cast("string"), "-1").try_cast("bigint").alias("offset"),
        pick(ORIGINAL_TIMESTAMP, message_ts_iso(ts), "unknown").alias("timestamp"),
    )


def provenance(service: Column, group_id: Column, origin: Column) -> list[Column]:
    """Key/value columns carried on every hop."""
    return [
        F.lit(SERVICE), service,
        F.lit(CONSUMER_GROUP), group_id,
        F.lit(ORIGINAL_TOPIC), origin["topic"],
        F.lit(ORIGINAL_PARTITION), origin["partition"].cast("string"),
        F.lit(ORIGINAL_OFFSET), origin["offset"].cast("string"),
        F.lit(ORIGINAL_TIMESTAMP), origin["timestamp"],
    ]
