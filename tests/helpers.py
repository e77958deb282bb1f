"""Small hand-made logs, and sequential models of the fold and the guard."""

from __future__ import annotations

import datetime as dt
import json

from eventfold.schemas import LOG_SCHEMA

TYPES = ["ORDER_CREATED", "PACKED", "SHIPPED", "DELIVERED"]
LEADS_TO = dict(zip(TYPES, ["CREATED", "PACKED", "SHIPPED", "DELIVERED"]))
BEFORE = dict(zip(TYPES, [None, "CREATED", "PACKED", "SHIPPED"]))
T0 = dt.datetime(2026, 1, 1)

CREATED = {
    "customer_id": "c", "items": [{"sku": "PEN", "qty": 1, "unit_price": 1000}], "total_amount": 1000,
    "payment": {"method": "CARD", "reference": "p", "amount": 1000},
}
PAYLOADS = {"ORDER_CREATED": CREATED, "SHIPPED": {"carrier": "Pathao", "tracking_number": "PT-1"}}


def event_bytes(order_id, sequence, event_type, event_id="e", compact=True, **extra):
    doc = {
        "event_id": event_id, "order_id": order_id, "sequence": sequence, "event_type": event_type,
        "occurred_at": "2026-01-01T00:00:00Z", "payload": PAYLOADS.get(event_type, {}), **extra,
    }
    return json.dumps(doc, separators=(",", ":") if compact else None).encode()


def record(offset, value, key=b"o", partition=0, topic="order-lifecycle", headers=None, at=None):
    moment = at or T0 + dt.timedelta(milliseconds=offset)
    return (topic, partition, offset, moment, key, value, headers)


def log_of(spark, rows):
    return spark.createDataFrame(rows, LOG_SCHEMA)


def sequential_fold(rows, guarded=True, resets=()):
    """rows: dicts in offset order with order_id, offset, kind, sequence, event_type, event_id, ok."""
    folds, out = {}, []
    pending = sorted(resets)
    for r in rows:
        while pending and r["offset"] >= pending[0]:
            pending.pop(0)
            folds.clear()
        key, old = r["order_id"], folds.get(r["order_id"])
        if r["kind"] == "tombstone":
            folds.pop(key, None)
            out.append((r["offset"], old is not None, None, None, None, None))
            continue
        again = old is not None and r["sequence"] <= old[0]
        gap = not again and r["sequence"] != (old[0] if old else 0) + 1
        illegal = not again and BEFORE[r["event_type"]] != (old[1] if old else None)
        if r["ok"]:
            n = (old[3] if old else 0) + 1
            if old is None or not guarded or r["sequence"] > old[0]:
                folds[key] = (r["sequence"], LEADS_TO[r["event_type"]], r["event_id"], n)
            else:
                folds[key] = (*old[:3], n)
        now = folds.get(key)
        out.append((r["offset"], None, again, gap, illegal, now))
    while pending:
        pending.pop(0)
        folds.clear()
    return out, folds


def sequential_guard(commands):
    state, last, born, out = {}, {}, set(), []
    for c in commands:
        o, was, seq = c["order_id"], state.get(c["order_id"]), None
        if c["kind"] == "create":
            if o in born:
                status = 409
            elif not c["payload_ok"]:
                status = 422
            elif c["publish_ok"]:
                status, seq, state[o], last[o] = 201, 1, "CREATED", 1
                born.add(o)
            else:
                status = 502
        elif was is None:
            status = 404
        elif c["kind"] == "delete":
            status = 204 if c["publish_ok"] else 502
            if c["publish_ok"]:
                state.pop(o)
        elif not c["payload_ok"]:
            status = 422
        else:
            legal = BEFORE[c["event_type"]] == was
            if not legal and not c["force"]:
                status = 409
            else:
                last[o] += 1
                seq, status = last[o], 200 if c["publish_ok"] else 502
                if legal and c["publish_ok"]:
                    state[o] = LEADS_TO[c["event_type"]]
        out.append((c["cmd_id"], status, seq, was, state.get(o)))
    return out
