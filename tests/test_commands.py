"""The transition guard against a sequential model, windowed and in blocks."""

import random

import pytest

from eventfold.operators import commands as O
from helpers import TYPES, sequential_guard

SCHEMA = (
    "cmd_id bigint, kind string, order_id string, event_type string, force boolean, publish_ok boolean, "
    "payload_ok boolean, payload_reason string"
)


def random_commands(seed, n=700):
    rng, out = random.Random(seed), []
    for i in range(n):
        order = "big" if rng.random() < 0.4 else f"o{rng.randrange(25)}"
        kind = rng.choices(["create", "advance", "delete"], [3, 9, 0.4])[0]
        ok = rng.random() > 0.1
        out.append(
            dict(cmd_id=i * 3, kind=kind, order_id=order, event_type=rng.choice(TYPES[1:]) if kind == "advance" else None,
                 force=rng.random() < 0.15, publish_ok=rng.random() > 0.1, payload_ok=ok, payload_reason=None if ok else "bad")
        )
    return out


@pytest.mark.parametrize("block_rows", [1 << 20, 50, 9])
def test_guard_equals_sequential_model(spark, block_rows):
    for seed in range(3):
        commands = random_commands(seed)
        df = spark.createDataFrame([tuple(c.values()) for c in commands], SCHEMA)
        got = O.guard(df, block_rows=block_rows).collect()
        seen = sorted((r.cmd_id, r.status, r.sequence, r.state_before, r.state_after) for r in got)
        assert seen == sorted(sequential_guard(commands))


def test_payment_must_match_the_items(spark):
    headers = spark.createDataFrame(
        [(1, "cust", "CARD", "p", 9999), (2, "cust", "CARD", "p", 15000), (3, "cust", "CARD", "p", 0)],
        "cmd_id bigint, customer_id string, method string, reference string, amount bigint",
    )
    lines = spark.createDataFrame(
        [(1, "A", 1, 15000), (2, "A", 1, 15000)], "cmd_id bigint, sku string, qty bigint, unit_price bigint"
    )
    got = {r.cmd_id: (r.payload_ok, r.payload_reason) for r in O.check_creates(headers, lines).collect()}
    assert got[1] == (False, "payment.amount 9999 does not equal total_amount 15000")
    assert got[2] == (True, None)
    assert got[3] == (False, "items is empty")


def test_rejection_texts(spark):
    rows = [
        (1, "create", "o", None, False, True, True, None),
        (2, "advance", "o", "SHIPPED", False, True, True, None),
        (3, "advance", "x", "PACKED", False, True, True, None),
    ]
    got = O.rejections(O.guard(spark.createDataFrame(rows, SCHEMA), find_hot=False)).collect()
    assert {r.reason for r in got} == {"order o is CREATED; expected PACKED but got SHIPPED", "no order x"}
