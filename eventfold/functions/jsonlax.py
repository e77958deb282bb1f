"""Read typed fields out of a VARIANT with the lenient coercions of the event contract.

Numbers may arrive as JSON text or as an integral float; strings must be JSON strings.
Every helper returns NULL for a value that does not fit, so a NULL result next to a
non-missing field means "wrong type".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = r"^\d{1,18}$"
_INT_TEXT = r"^\s*[+-]?[0-9]+(\.0*)?\s*$"
_ISO_TEXT = r"^\d{4}-\d\d-\d\d([T ][0-9:.]{5,18}(Z|z|[+-]\d\d:?\d\d)?)?$"
_NUMBER_TEXT = r"^[+-]?\d+(\.\d+)?$"
#: Unix numbers above this are milliseconds.
_MILLIS_FROM = 2e10


def at(variant: Column, path: str) -> Column:
    return F.try_variant_get(variant, path, "variant")


def kind(variant: Column) -> Column:
    return F.schema_of_variant(variant)


def text(variant: Column) -> Column:
    return F.when(kind(variant) == "STRING", F.try_variant_get(variant, "$", "string"))


def integer(variant: Column) -> Column:
    """Whole number from an integer, an integral float, digits in a string, or a boolean."""
    shown = F.try_variant_get(variant, "$", "string")
    as_double = F.try_variant_get(variant, "$", "double")
    return (
        F.when(shown.rlike(_DIGITS), shown.cast("bigint"))
        .when(
            shown.rlike(_INT_TEXT),
            F.regexp_replace(F.trim(shown), r"\.0*$", "").try_cast("bigint"),
        )
        .when(kind(variant) == "BOOLEAN", F.try_variant_get(variant, "$", "boolean").cast("bigint"))
        .when((kind(variant) == "DOUBLE") & (as_double == F.floor(as_double)), as_double.try_cast("bigint"))
    )


def iso_time(value: Column) -> Column:
    """ISO-8601 text to a timestamp; text without an offset is read as UTC."""
    return F.when(value.rlike(_ISO_TEXT), value.try_cast("timestamp"))


def time(variant: Column) -> Column:
    """Timestamp from ISO text or from Unix seconds or milliseconds."""
    shown = F.try_variant_get(variant, "$", "string")
    number = shown.try_cast("double")
    seconds = F.when(F.abs(number) > _MILLIS_FROM, number / 1000).otherwise(number)
    return F.when(kind(variant) == "STRING", iso_time(shown)).otherwise(
        F.when(shown.rlike(_NUMBER_TEXT), F.timestamp_micros((seconds * 1000000).try_cast("bigint")))
    )


def is_object(variant: Column) -> Column:
    return F.coalesce(kind(variant).startswith("OBJECT"), F.lit(False))


def sealed(document: Column, seal: Column) -> Column:
    """Parse JSON text wrapped in an array with a seal behind it.

    The parser stops after the first complete value. Junk after a document then moves or
    hides the seal, so :func:`unsealed` finds it missing.
    """
    return F.try_parse_json(F.concat(F.lit("["), document, F.lit(',"'), seal, F.lit('"]')))


def unsealed(wrapped: Column, document: Column, seal: Column) -> Column:
    """Whether ``document`` is exactly one JSON object."""
    opens = document.rlike(r"^\s*\{")
    return F.coalesce(opens & (F.try_variant_get(wrapped, "$[1]", "string") == seal), F.lit(False))
