"""Shared table expressions for the comparison SQL.

They state the derived log and its expected outcomes from the tables directly, without
bytes, headers or JSON, so they check the decoding as well as the operators.
"""

from __future__ import annotations

_CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    _CTE[name] = (needs, body)


def using(query: str, *needs: str) -> str:
    """Prefix ``query`` with the expressions it needs, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for n in _CTE[name][0]:
            visit(n)
        order.append(name)

    for n in needs:
        visit(n)
    heads = ",\n".join(f"{n} AS ({_CTE[n][1]})" for n in order)
    return f"WITH {heads}\n{query}"


cte(
    "base",
    """SELECT o_orderkey AS k, o_custkey AS ck, CAST(floor(o_totalprice) AS BIGINT) AS price, o_orderdate AS ordered,
    CASE o_orderstatus WHEN 'F' THEN 4 WHEN 'P' THEN 3 ELSE 1 + o_orderkey % 2 END AS n FROM orders""",
)
cte(
    "recs",
    """SELECT *, 0 AS slot, 'not_json' AS kind, CAST(NULL AS BIGINT) AS s, CAST(NULL AS VARCHAR) AS ty FROM base WHERE k % 31 = 13
    UNION ALL SELECT *, 1, 'bad_schema', NULL, NULL FROM base WHERE k % 41 = 19
    UNION ALL SELECT *, 2, 'event', 1, 'ORDER_CREATED' FROM base
    UNION ALL SELECT *, 3, 'event', 1, 'ORDER_CREATED' FROM base WHERE k % 19 = 5
    UNION ALL SELECT *, CASE WHEN k % 29 = 11 THEN 8 ELSE 4 END, 'event', 2,
        CASE WHEN k % 23 = 7 THEN 'DELIVERED' ELSE 'PACKED' END FROM base WHERE n >= 2 AND k % 17 <> 3
    UNION ALL SELECT *, 5, 'event', 2, 'PACKED' FROM base WHERE n >= 2 AND k % 19 = 5
    UNION ALL SELECT *, 6, 'event', 3, 'SHIPPED' FROM base WHERE n >= 3
    UNION ALL SELECT *, 7, 'event', 3, 'SHIPPED' FROM base WHERE n >= 3 AND k % 19 = 5
    UNION ALL SELECT *, 9, 'event', 4, 'DELIVERED' FROM base WHERE n >= 4
    UNION ALL SELECT *, 10, 'event', 4, 'DELIVERED' FROM base WHERE n >= 4 AND k % 19 = 5
    UNION ALL SELECT *, 11, 'tombstone', NULL, NULL FROM base WHERE k % 37 = 17
    UNION ALL SELECT *, 12, 'event', 1, 'ORDER_CREATED' FROM base WHERE k % 74 = 17""",
    "base",
)
cte(
    "log",
    """SELECT *, CAST(k % 3 AS INTEGER) AS p, (((k // 3) // 1024) * 16 + slot) * 1024 + (k // 3) % 1024 AS off,
    1767225600000 + (((k // 3) // 1024) * 16 + slot) * 1024 + (k // 3) % 1024 AS ms,
    'ord-' || lpad(CAST(k AS VARCHAR), 12, '0') AS order_id,
    CASE WHEN kind = 'event' THEN 'evt-' || k || '-' || s || CASE WHEN slot = 12 THEN '-again' ELSE '' END END AS event_id,
    (k // 41) % 6 AS flaw,
    CASE WHEN kind = 'tombstone' THEN 1 WHEN k % 10 = 3 THEN 2 WHEN k % 10 = 7 THEN 3 ELSE 1 END AS att,
    CASE WHEN slot IN (3, 5, 7, 10) AND k % 2 = 0 THEN 'notification' END AS target,
    CASE ty WHEN 'ORDER_CREATED' THEN 'CREATED' ELSE ty END AS leads_to,
    CASE ty WHEN 'PACKED' THEN 'CREATED' WHEN 'SHIPPED' THEN 'PACKED' WHEN 'DELIVERED' THEN 'SHIPPED' END AS needs_state
    FROM recs""",
    "recs",
)
#: Line items of a created order, one row each.
cte(
    "lines",
    """SELECT k, i, 'P-' || ((k * 7 + i * 13) % 2000) AS sku, 1 + (k + i) % 5 AS qty, 100 + price % 9000 + i * 10 AS unit_price
    FROM base CROSS JOIN (VALUES (0), (1), (2)) AS t(i) WHERE i <= k % 3""",
    "base",
)
cte("totals", "SELECT k, CAST(sum(qty * unit_price) AS BIGINT) AS total FROM lines GROUP BY k", "lines")
cte(
    "services",
    """SELECT service, service || '-service' AS group_id, ord FROM (VALUES ('inventory', 0), ('notification', 1), ('analytics', 2)) AS t(service, ord)""",
)
#: Deliveries of attempt 1 with their handler outcome, and tombstones.
cte(
    "dlv",
    """SELECT log.*, services.service, services.group_id, services.ord,
    kind = 'tombstone' AS stone,
    CASE WHEN kind <> 'event' OR (service = 'inventory' AND ty IN ('PACKED', 'DELIVERED')) THEN NULL WHEN (k + s) % 47 = 0 THEN 'NonRetryableError'
         WHEN (k + s) % 43 = 0 AND service = 'notification' THEN 'RetryableError' END AS err,
    CASE WHEN kind <> 'event' OR (service = 'inventory' AND ty IN ('PACKED', 'DELIVERED')) THEN NULL
         WHEN (k + s) % 47 = 0 THEN 'HANDLER_FAILURE_MODE=poison: ' || order_id || ' seq ' || s || ' can never be processed'
         WHEN (k + s) % 43 = 0 AND service = 'notification'
         THEN 'HANDLER_FAILURE_MODE=transient: ' || order_id || ' seq ' || s || ' failed attempt ' || att || ' of 3' END AS err_text
    FROM log CROSS JOIN services WHERE kind IN ('event', 'tombstone') AND (target IS NULL OR target = service)""",
    "log",
    "services",
)


def fold_ctes(prefix: str, source: str, needs: tuple[str, ...], guarded: bool = True, reset: str = "0") -> None:
    """Register ``<prefix>_hist`` (state before and after each row) and ``<prefix>_fold``."""
    rank = "{'a': s, 'b': -off, 's': s, 'st': leads_to, 'e': event_id}" if guarded else (
        "{'a': off, 'b': 0, 's': s, 'st': leads_to, 'e': event_id}"
    )
    cte(
        f"{prefix}_epochs",
        f"""SELECT *, NOT stone AND err IS NULL AS ok, {reset} AS lost,
        coalesce(sum(CASE WHEN stone THEN 1 ELSE 0 END) OVER (PARTITION BY group_id, k, {reset} ORDER BY off
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM {source}""",
        *needs,
    )
    w = "PARTITION BY group_id, k, lost, epoch ORDER BY off ROWS BETWEEN UNBOUNDED PRECEDING AND"
    cte(
        f"{prefix}_hist",
        f"""SELECT *, max({rank}) FILTER (WHERE ok) OVER ({w} 1 PRECEDING) AS prev,
        max({rank}) FILTER (WHERE ok) OVER ({w} CURRENT ROW) AS cur,
        count(*) FILTER (WHERE ok) OVER ({w} CURRENT ROW) AS handled,
        row_number() OVER (PARTITION BY group_id, k ORDER BY off DESC) AS back
        FROM {prefix}_epochs""",
        f"{prefix}_epochs",
    )
    cte(
        f"{prefix}_fold",
        f"""SELECT group_id, k, order_id, cur.s AS last_sequence, cur.st AS state, cur.e AS last_event_id,
        handled AS handled_count FROM {prefix}_hist WHERE back = 1 AND NOT stone AND cur IS NOT NULL""",
        f"{prefix}_hist",
    )
    cte(
        f"{prefix}_judged",
        f"""SELECT *, coalesce(s <= prev.s, false) AS redelivery,
        NOT coalesce(s <= prev.s, false) AND s <> coalesce(prev.s, 0) + 1 AS seq_gap,
        NOT coalesce(s <= prev.s, false) AND needs_state IS DISTINCT FROM prev.st AS illegal
        FROM {prefix}_hist WHERE NOT stone""",
        f"{prefix}_hist",
    )
    nxt = """CASE WHEN prev.st IS NULL THEN 'ORDER_CREATED' WHEN prev.st = 'CREATED' THEN 'PACKED'
        WHEN prev.st = 'PACKED' THEN 'SHIPPED' WHEN prev.st = 'SHIPPED' THEN 'DELIVERED'
        ELSE 'nothing (lifecycle complete)' END"""
    cte(
        f"{prefix}_viol",
        f"""SELECT group_id, 'SEQUENCE_GAP' AS type, k, order_id, s AS sequence, CAST(coalesce(prev.s, 0) + 1 AS VARCHAR) AS expected,
        CAST(s AS VARCHAR) AS observed, p AS "partition", off AS "offset" FROM {prefix}_judged WHERE seq_gap
        UNION ALL SELECT group_id, 'ILLEGAL_TRANSITION', k, order_id, s, {nxt}, ty || ' after ' || coalesce(prev.st, 'None'), p, off
        FROM {prefix}_judged WHERE illegal""",
        f"{prefix}_judged",
    )


fold_ctes("g", "dlv", ("dlv",))
fold_ctes("w", "dlv", ("dlv",), guarded=False)
#: Inventory loses its memory of partition 1 from offset 20000 on.
fold_ctes(
    "r", "dlv", ("dlv",), guarded=False,
    reset="CASE WHEN group_id = 'inventory-service' AND p = 1 AND off >= 20000 THEN 1 ELSE 0 END",
)

cte(
    "reasons",
    """SELECT *, CASE WHEN kind = 'not_json' THEN 'not_json_object' WHEN kind = 'bad_schema' THEN
    CASE flaw WHEN 0 THEN 'sequence, event_type' WHEN 1 THEN 'sequence' WHEN 2 THEN 'not_json_object'
    WHEN 3 THEN 'payment_mismatch' WHEN 4 THEN 'carrier' ELSE 'payload' END ELSE '' END AS why FROM log""",
    "log",
)
#: Failed deliveries with where they go.
cte(
    "failed",
    """SELECT k, p, off, ms, order_id, s, att, service, group_id, ord, err, err_text, why FROM (SELECT dlv.*, '' AS why FROM dlv)
    WHERE err IS NOT NULL
    UNION ALL SELECT k, p, off, ms, order_id, NULL, att, service, group_id, ord, 'NonRetryableError',
    'undecodable message: ' || why, why FROM reasons CROSS JOIN services WHERE kind IN ('not_json', 'bad_schema')""",
    "dlv",
    "reasons",
    "services",
)
cte(
    "routed",
    """SELECT *, ms + 1000 AS failed_ms, off * 3 + ord AS pos,
    CASE WHEN err = 'RetryableError' AND 3 > att THEN 'retry' ELSE 'dlq' END AS destination,
    CASE WHEN err = 'RetryableError' AND 3 > att THEN 'RETRY_SCHEDULED' WHEN err = 'RetryableError' THEN 'RETRY_EXHAUSTED'
         ELSE 'POISON_MESSAGE' END AS marker,
    CASE WHEN err = 'RetryableError' AND 3 > att THEN att + 1 END AS next_attempt,
    CASE att + 1 WHEN 2 THEN 30 ELSE 120 END AS wait_s FROM failed""",
    "failed",
)
cte("lane", "SELECT *, failed_ms + wait_s * 1000 AS due_ms FROM routed WHERE destination = 'retry'", "routed")
cte("dlq", "SELECT * FROM routed WHERE destination = 'dlq'", "routed")


def iso(ms: str) -> str:
    """DuckDB expression printing epoch milliseconds as UTC ISO-8601 with microseconds."""
    return f"strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"

#: The log as one reader without failures sees it.
cte(
    "own",
    """SELECT log.*, 'orders-service' AS group_id, kind = 'tombstone' AS stone, CAST(NULL AS VARCHAR) AS err
    FROM log WHERE kind IN ('event', 'tombstone') AND target IS NULL""",
    "log",
)
fold_ctes("t", "own", ("own",))
