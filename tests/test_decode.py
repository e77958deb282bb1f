"""Which bytes are events, and what they decode to."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from eventfold.operators.decode import parse_event
from helpers import CREATED, event_bytes, log_of, record

GOOD = event_bytes("o", 3, "PACKED").decode()


def doc(**change):
    base = json.loads(GOOD)
    base.update(change)
    return json.dumps({k: v for k, v in base.items() if v != "DROP"})


CASES = [
    (GOOD, 3, ""),
    (" \n" + GOOD + "\t", 3, ""),
    (doc(), 3, ""),
    (doc(sequence="3"), 3, ""),
    (doc(sequence=" 3 "), 3, ""),
    (doc(sequence=3.0), 3, ""),
    (doc(sequence=True), 1, ""),
    (doc(extra={"a": [1, 2]}), 3, ""),
    (doc(event_id="DROP", occurred_at="DROP", payload="DROP"), 3, ""),
    (doc(occurred_at=1767225600), 3, ""),
    (doc(occurred_at="2026-01-01 10:00:00+02:00"), 3, ""),
    (doc(order_id=""), 3, ""),
    ('{"order_id":"x",' + GOOD[1:], 3, ""),
    (doc(sequence=0), None, "sequence"),
    (doc(sequence=3.5), None, "sequence"),
    (doc(sequence=None), None, "sequence"),
    (doc(order_id=5), None, "order_id"),
    (doc(event_id=None), None, "event_id"),
    (doc(event_type="packed"), None, "event_type"),
    (doc(occurred_at="yesterday"), None, "occurred_at"),
    (doc(payload=None), None, "payload"),
    (doc(payload=[]), None, "payload"),
    (GOOD + " x", None, "not_json_object"),
    (GOOD + GOOD, None, "not_json_object"),
    (GOOD + "," + GOOD, None, "not_json_object"),
    (GOOD + '],[{"a":1}', None, "not_json_object"),
    ("[" + GOOD + "]", None, "not_json_object"),
    ("null", None, "not_json_object"),
    ("3", None, "not_json_object"),
    ("", None, "not_json_object"),
    (GOOD.replace('"', "'"), None, "not_json_object"),
    (GOOD[:-1], None, "not_json_object"),
    ("﻿" + GOOD, None, "not_json_object"),
]


def test_cases(spark):
    rows = [record(i, text.encode()) for i, (text, _, _) in enumerate(CASES)] + [
        record(100, b"\xff\xfe"), record(101, None)
    ]
    got = {r.offset: r for r in parse_event(log_of(spark, rows)).collect()}
    for i, (text, sequence, why) in enumerate(CASES):
        assert (got[i].sequence, ", ".join(got[i].reasons)) == (sequence, why), text
    assert got[100].is_poison and got[100].reasons == ["not_json_object"]
    assert got[101].is_tombstone and not got[101].is_poison


def test_times_and_defaults(spark):
    rows = [
        record(0, doc(occurred_at="2026-01-01T10:00:00+02:00").encode()),
        record(1, doc(occurred_at="2026-01-01T08:00:00").encode()),
        record(2, doc(occurred_at=1767254400000).encode()),
        record(3, doc(occurred_at="DROP", event_id="DROP", payload="DROP").encode(), at=dt.datetime(2026, 1, 1, 8)),
    ]
    got = parse_event(log_of(spark, rows)).select(
        F.unix_millis("occurred_at").alias("t"), "event_id", F.to_json("payload").alias("p")
    ).collect()
    assert {r.t for r in got} == {1767254400000}
    assert len({r.event_id for r in got}) == 2
    assert got[3].p == "{}"


@pytest.mark.parametrize("compact", [True, False])
def test_both_parsers_agree(spark, compact):
    """The exact-shape parse and the lenient one give the same typed payload."""
    flaws = [
        {}, {"customer_id": ""}, {"items": []}, {"total_amount": 1001}, {"payment": {**CREATED["payment"], "amount": 1}},
        {"payment": {**CREATED["payment"], "method": "CASH"}}, {"items": [{"sku": "", "qty": 1, "unit_price": 1000}]},
        {"items": [{"sku": "A", "qty": 0, "unit_price": 1000}]},
        {"items": [{"sku": "A", "qty": 2, "unit_price": 15000}, {"sku": "B", "qty": 1, "unit_price": 4500}],
         "total_amount": 34500, "payment": {"method": "NAGAD", "reference": "r", "amount": 34500}},
    ]
    rows = [
        record(i, event_bytes("o", 1, "ORDER_CREATED", compact=compact, payload={**CREATED, **f}))
        for i, f in enumerate(flaws)
    ]
    got = {r.offset: r for r in parse_event(log_of(spark, rows)).collect()}
    whys = ["", "customer_id", "items", "total_mismatch", "payment_mismatch", "payment", "item", "item", ""]
    assert [", ".join(got[i].reasons) for i in range(len(flaws))] == whys
    assert got[8].created.total_amount == 34500 and len(got[8].created["items"]) == 2


def test_quick_rules_agree_with_reasons(spark):
    """The check that lets a document take the typed parse says what the list of broken rules says."""
    from pyspark.sql import functions as F

    from eventfold.functions import validate as V
    from eventfold.schemas import CREATED_TYPE, SHIPPED_TYPE

    good = {"customer_id": "c", "items": [("PEN", 1, 5)], "total_amount": 5, "payment": ("CARD", "p", 5)}
    changes = [
        {}, {"customer_id": ""}, {"customer_id": None}, {"items": []}, {"items": None}, {"items": [("PEN", 0, 5)]}, {"items": [("", 1, 5)]},
        {"items": [("PEN", 1 << 62, 5)]}, {"total_amount": 6}, {"total_amount": None}, {"payment": None}, {"payment": ("CASH", "p", 5)},
        {"payment": ("CARD", "", 5)}, {"payment": ("CARD", "p", 6)}, {"payment": ("CARD", "p", None)}, {"items": [None]},
    ]
    rows = [(tuple({**good, **c}.values()),) for c in changes] + [(None,)]
    c = F.col("v")
    seen = spark.createDataFrame(rows, f"v {CREATED_TYPE}").select(V.created_ok(c).alias("ok"), (F.size(V.created_reasons(c)) == 0).alias("none")).collect()
    assert [r.ok for r in seen] == [r.none for r in seen] == [True] + [False] * (len(rows) - 1)
    rows = [((a, b),) for a in ("x", "", None) for b in ("x", "", None)]
    seen = spark.createDataFrame(rows, f"v {SHIPPED_TYPE}").select(V.shipped_ok(c).alias("ok"), (F.size(V.shipped_reasons(c)) == 0).alias("none")).collect()
    assert [r.ok for r in seen] == [r.none for r in seen] == [True] + [False] * 8
