"""Runs of failure routing, the retry lane and dead letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventfold.functions import headers as H
from eventfold.functions import text as X
from eventfold.operators import deadletters as DL
from eventfold.operators import failures as O
from eventfold.operators import retry as R
from eventfold.operators.replaying import ReplayRun, published, sent
from eventfold.registry import register
from eventfold.registry.sql import cte, iso, using
from eventfold.schemas import DLQ_TOPIC, LOG_SCHEMA, RETRY_TOPIC
from eventfold.session import work_dir, written
from eventfold.sources.order_log import START_MILLIS, fixture_handler, lifecycle_log, order_number
from eventfold.streaming.sequence import Sequencer

#: Log time at which the due gates are read: 100 seconds in.
NOW_MS = START_MILLIS + 100_000


def now():
    return F.timestamp_millis(F.lit(NOW_MS))


def failed(spark, d):
    return O.failed_deliveries(lifecycle_log(spark, d), handler=fixture_handler)


def routed(spark, d):
    ordinal = F.when(F.col("service") == "inventory", 0).when(F.col("service") == "notification", 1).otherwise(2)
    return (
        O.route_failures(failed(spark, d))
        .withColumn("position", F.col("offset") * 3 + ordinal)
        .withColumn("moment", F.col("timestamp") + F.make_dt_interval(secs=F.lit(1)))
    )


def retry_lane(spark, d):
    keep = ["position", "moment"]
    records = O.to_retry(routed(spark, d), F.col("moment"), keep=keep)
    return R.as_log(records, F.col("position"), F.col("moment"))


def dead_letters(spark, d):
    keep = ["position", "moment"]
    records = O.to_dead_letter(routed(spark, d), F.col("moment"), keep=keep)
    return R.as_log(records, F.col("position"), F.col("moment"))


def flat(log, *names):
    """Log rows with the named headers as columns."""
    m = log.withColumn("m", H.decode_headers(F.col("headers")))
    return m.select(
        "topic", "partition", "offset", X.key_text(F.col("key")).alias("key_text"),
        *[F.try_element_at("m", F.lit(n)).alias(n[2:].replace("-", "_")) for n in names],
    )


PROVENANCE = (
    H.SERVICE, H.CONSUMER_GROUP, H.ORIGINAL_TOPIC, H.ORIGINAL_PARTITION, H.ORIGINAL_OFFSET, H.ORIGINAL_TIMESTAMP,
)
PROVENANCE_SQL = f"""service, group_id AS consumer_group, 'order-lifecycle' AS original_topic,
    CAST(p AS VARCHAR) AS original_partition, CAST(off AS VARCHAR) AS original_offset, {iso('ms')} AS original_timestamp"""


@register(
    "classify_failure",
    using(
        """SELECT err AS error_class, CASE WHEN err = 'NonRetryableError' THEN 'poison' ELSE 'retryable' END AS failure_kind,
        count(*) AS n FROM failed GROUP BY 1, 2""",
        "failed",
    ),
)
def classify_failure(spark, d):
    return failed(spark, d).groupBy("error_class", O.classify(F.col("error_class")).alias("failure_kind")).agg(
        F.count(F.lit(1)).alias("n")
    )


@register(
    "attempt_budget",
    using(
        """SELECT service, order_id, p AS "partition", off AS "offset", CAST(att AS BIGINT) AS attempts_made, destination, marker,
        CAST(next_attempt AS BIGINT) AS next_attempt FROM routed""",
        "routed",
    ),
)
def attempt_budget(spark, d):
    return routed(spark, d).select(
        "service", "order_id", "partition", "offset", "attempts_made", "destination", "marker", "next_attempt"
    )


@register(
    "backoff",
    using(
        """SELECT o_orderkey % 6 AS attempt, CAST(CASE WHEN o_orderkey % 6 < 2 THEN 0 WHEN o_orderkey % 6 = 2 THEN 30 ELSE 120 END AS DOUBLE) AS seconds,
        count(*) AS n FROM orders GROUP BY 1, 2""",
        "base",
    ),
)
def backoff(spark, d):
    a = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") % 6).alias("attempt"))
    return a.groupBy("attempt", O.backoff(F.col("attempt")).alias("seconds")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "to_retry",
    using(
        f"""SELECT 'order-lifecycle.retry' AS topic, p AS "partition", pos AS "offset", order_id AS key_text, {PROVENANCE_SQL},
        CAST(next_attempt AS VARCHAR) AS attempt, {iso('due_ms')} AS retry_at, err AS error_class, err_text AS error_message,
        {iso('failed_ms')} AS failed_at FROM lane""",
        "lane",
    ),
)
def to_retry(spark, d):
    return flat(
        retry_lane(spark, d), *PROVENANCE, H.ATTEMPT, H.RETRY_AT, H.ERROR_CLASS, H.ERROR_MESSAGE, H.FAILED_AT
    )


@register(
    "to_dead_letter",
    using(
        f"""SELECT 'order-lifecycle.dlq' AS topic, p AS "partition", pos AS "offset", order_id AS key_text, {PROVENANCE_SQL},
        CAST(att AS VARCHAR) AS attempts_made, err AS error_class, err_text AS error_message,
        {iso('failed_ms')} AS failed_at FROM dlq""",
        "dlq",
    ),
)
def to_dead_letter(spark, d):
    return flat(
        dead_letters(spark, d), *PROVENANCE, H.ATTEMPTS_MADE, H.ERROR_CLASS, H.ERROR_MESSAGE, H.FAILED_AT
    )


def waiting(spark, d):
    return R.with_retry_fields(retry_lane(spark, d))


def _gate_sql(keys: str) -> str:
    return using(
        f"""SELECT "partition", "offset", attempt, release_ms, release_ms <= {NOW_MS} AS released FROM (
        SELECT p AS "partition", pos AS "offset", CAST(next_attempt AS BIGINT) AS attempt,
        max(greatest(due_ms, failed_ms)) OVER (PARTITION BY {keys} ORDER BY pos) AS release_ms FROM lane)""",
        "lane",
    )


def _gate(rows):
    return rows.select(
        "partition", "offset", "attempt", F.unix_millis("release_at").alias("release_ms"), "released"
    )


@register("due_gate_hol", _gate_sql("p"))
def due_gate_hol(spark, d):
    lane = R.with_retry_fields(written(retry_lane(spark, d), "lane"))
    return _gate(R.due_gate_hol(lane, now(), block_rows=4096))


@register("due_gate_tiered", _gate_sql("p, next_attempt"))
def due_gate_tiered(spark, d):
    lane = R.with_retry_fields(written(retry_lane(spark, d), "lane"))
    return _gate(R.due_gate_tiered(lane, now(), block_rows=4096))


cte(
    "due",
    f"""SELECT * FROM (SELECT *, max(greatest(due_ms, failed_ms)) OVER (PARTITION BY p ORDER BY pos) AS release_ms FROM lane)
    WHERE release_ms <= {NOW_MS}""",
    "lane",
)
cte("ends", "SELECT p AS ep, max(off) + 1 AS high FROM log GROUP BY p", "log")
cte("dead_ends", "SELECT p AS ep, max(pos) + 1 AS high FROM dlq GROUP BY p", "dlq")
APPENDED = """CAST(coalesce(high, 0) + row_number() OVER (PARTITION BY p ORDER BY pos) - 1 AS BIGINT)"""


def failure_records(spark, d):
    """Retry lane and dead letters as one written table, so the log is decoded once for both."""
    records = O.to_failure_logs(routed(spark, d), F.col("moment"), keep=["position", "moment"])
    return written(R.as_log(records, F.col("position"), F.col("moment")), "failure-records")


def logs(spark, d, records=None):
    """The logs that released records are appended to; ``records`` are the ``failure_records``, where written already."""
    return lifecycle_log(spark, d).unionByName(failure_records(spark, d) if records is None else records)


def released(spark, d, change=None):
    """The batch release of the retry lane, as ``change`` makes it."""
    records = failure_records(spark, d)
    lane = records.where(F.col("topic") == RETRY_TOPIC)
    return R.release_due(lane if change is None else written(change(spark, d, lane), "lane"), logs(spark, d, records), now(), block_rows=4096)


@register(
    "to_source",
    using(
        f"""SELECT 'order-lifecycle' AS topic, p AS "partition", {APPENDED} AS "offset", order_id AS key_text, {PROVENANCE_SQL},
        CAST(next_attempt AS VARCHAR) AS attempt, service AS retry_target FROM due LEFT JOIN ends ON p = ep""",
        "due",
        "ends",
    ),
)
def to_source(spark, d):
    back, _ = released(spark, d)
    return flat(back, *PROVENANCE, H.ATTEMPT, H.RETRY_TARGET)


@register(
    "retry_waiting",
    using(
        """SELECT p AS "partition", pos AS "offset", order_id AS key_text FROM lane
        WHERE (p, pos) NOT IN (SELECT (p, pos) FROM due)""",
        "lane",
        "due",
    ),
)
def retry_waiting(spark, d):
    """What the gate keeps back."""
    _, left = released(spark, d)
    return left.select("partition", "offset", X.key_text(F.col("key")).alias("key_text"))


def damaged_lane(spark, d, lane=None):
    """The retry lane with some records addressed to nobody or holding bad bytes."""
    k = order_number(X.key_text(F.col("key")))
    without = F.filter("headers", lambda h: h["key"] != H.SERVICE)
    other = F.array(F.struct(F.lit(H.SERVICE).alias("key"), F.encode(F.lit("billing"), "UTF-8").alias("value")))
    return (
        (retry_lane(spark, d) if lane is None else lane)
        .withColumn("headers", F.when(k % 7 == 0, F.concat(without, other)).when(k % 11 == 0, without).otherwise(F.col("headers")))
        .withColumn("value", F.when(k % 13 == 0, F.encode(F.lit("{"), "UTF-8")).otherwise(F.col("value")))
    )


@register(
    "retry_give_up",
    using(
        f"""SELECT p AS "partition", {APPENDED} AS "offset", order_id AS key_text,
        CASE WHEN k % 7 = 0 THEN 'billing' WHEN k % 11 = 0 THEN '<unset>' ELSE service END AS service,
        CASE WHEN k % 7 = 0 THEN 'billing-service' WHEN k % 11 = 0 THEN '<unset>-service' ELSE group_id END AS consumer_group,
        CAST(next_attempt AS VARCHAR) AS attempts_made,
        CASE WHEN k % 7 = 0 THEN 'x-service header ''billing'' names no registered service (known: analytics, inventory, notification)'
             WHEN k % 11 = 0 THEN 'x-service header '''' names no registered service (known: analytics, inventory, notification)'
             ELSE 'undecodable message: not_json_object' END AS error_message
        FROM due LEFT JOIN dead_ends ON p = ep WHERE k % 7 = 0 OR k % 11 = 0 OR k % 13 = 0""",
        "due",
        "dead_ends",
    ),
)
def retry_give_up(spark, d):
    out, _ = released(spark, d, damaged_lane)
    dead = out.where(F.col("topic") == DLQ_TOPIC)
    return flat(dead, H.SERVICE, H.CONSUMER_GROUP, H.ATTEMPTS_MADE, H.ERROR_MESSAGE).drop("topic")


cte(
    "letters",
    """SELECT *, '  ' || order_id || repeat(' ', 24 - length(order_id)) || ' service=' || rpad(service, 13, ' ')
    || ' group=' || rpad(group_id, 22, ' ') || ' attempts=' || att || '  origin=order-lifecycle-' || p || '@' || off
    || chr(10) || '      ' || err || ': ' || err_text AS line FROM dlq""",
    "dlq",
)


@register(
    "dlq_inspect",
    using(
        """SELECT p AS "partition", pos AS "offset", service, CAST(att AS VARCHAR) AS attempts_made, err AS error_class
        FROM letters WHERE service = 'notification'""",
        "letters",
    ),
)
def dlq_inspect(spark, d):
    return DL.inspect(dead_letters(spark, d), "notification").select(
        "partition", "offset", "service", "attempts_made", "error_class"
    )


@register(
    "dlq_counts",
    using(
        """SELECT count(*) AS read, count(*) FILTER (WHERE service = 'notification') AS matched,
        count(*) FILTER (WHERE service = 'notification' AND err = 'NonRetryableError') AS excluded FROM dlq""",
        "dlq",
    ),
)
def dlq_counts(spark, d):
    return DL.counts(dead_letters(spark, d), "notification")


@register(
    "render_dead_letter",
    using('SELECT p AS "partition", pos AS "offset", line FROM letters', "letters"),
)
def render_dead_letter(spark, d):
    return DL.inspect(dead_letters(spark, d)).select("partition", "offset", "line")


@register(
    "dlq_replay",
    using(
        """SELECT 'order-lifecycle' AS topic, p AS "partition", pos AS "offset", order_id AS key_text, true AS bare
        FROM dlq WHERE err <> 'NonRetryableError'""",
        "dlq",
    ),
)
def dlq_replay(spark, d):
    """A publishing run over a dead-letter table that grows meanwhile; read back through its ledger."""
    dead, ledger, out = (work_dir(spark, n) for n in ("dead", "ledger", "replayed"))
    dead_letters(spark, d).write.parquet(dead)
    run = ReplayRun(0, lambda: spark.read.schema(LOG_SCHEMA).parquet(dead), ledger, 3)
    run.bounds(keep=True)
    late = run.dead_letters().withColumn("offset", F.col("offset") + 1_000_000_000)
    written(late, "late").write.mode("append").parquet(dead)
    ends = Sequencer(f"{out}-ends", lambda: lifecycle_log(spark, d))
    for _ in range(2):  # the second finds the first committed
        run.publish(out, ends)
    back = published(spark, out, ledger).select("topic", "partition", "offset", "key", F.col("headers").isNull().alias("bare"))
    return sent(spark, ledger, 0).join(back, ["topic", "partition", "offset"]).select(
        "topic", F.col("dead_partition").alias("partition"), F.col("dead_offset").alias("offset"), X.key_text(F.col("key")).alias("key_text"), "bare"
    )


@register(
    "dlq_replay_include_poison",
    using(
        """SELECT 'order-lifecycle' AS topic, p AS "partition", pos AS "offset", order_id AS key_text
        FROM dlq WHERE service = 'analytics'""",
        "dlq",
    ),
)
def dlq_replay_include_poison(spark, d):
    return DL.replay(dead_letters(spark, d), service="analytics", include_poison=True).select(
        "topic", "partition", "offset", X.key_text(F.col("key")).alias("key_text")
    )


@register(
    "dlq_limit",
    using(
        """SELECT p AS "partition", pos AS "offset", service, err AS error_class FROM dlq
        WHERE service = 'notification' ORDER BY p, pos LIMIT 25""",
        "dlq",
    ),
)
def dlq_limit(spark, d):
    return DL.first_matched(DL.inspect(dead_letters(spark, d), "notification"), 25).select(
        "partition", "offset", "service", "error_class"
    )


@register(
    "dlq_depth",
    using(
        """SELECT 'order-lifecycle.dlq' AS topic, service, err AS error_class, count(*) AS n FROM dlq GROUP BY 2, 3""",
        "dlq",
    ),
)
def dlq_depth(spark, d):
    return DL.depth(dead_letters(spark, d))


@register(
    "decode_headers",
    using(
        f"""SELECT p AS "partition", pos AS "offset", name, value FROM (
        SELECT p, pos, unnest(['x-service', 'x-consumer-group', 'x-original-topic', 'x-original-partition', 'x-original-offset',
        'x-original-timestamp', 'x-attempt', 'x-retry-at', 'x-error-class', 'x-error-message', 'x-failed-at']) AS name,
        unnest([service, group_id, 'order-lifecycle', CAST(p AS VARCHAR), CAST(off AS VARCHAR), {iso('ms')},
        CAST(next_attempt AS VARCHAR), {iso('due_ms')}, err, err_text, {iso('failed_ms')}]) AS value FROM lane)""",
        "lane",
    ),
)
def decode_headers(spark, d):
    return retry_lane(spark, d).select(
        "partition", "offset", F.explode(H.decode_headers(F.col("headers"))).alias("name", "value")
    )


@register(
    "encode_headers",
    using(
        """SELECT p AS "partition", pos AS "offset", 'notification' AS service,
        hex(encode(CAST(next_attempt AS VARCHAR))) AS attempt_hex FROM lane WHERE service = 'notification'""",
        "lane",
    ),
)
def encode_headers(spark, d):
    again = retry_lane(spark, d).withColumn("headers", H.encode_headers(H.decode_headers(F.col("headers"))))
    pick = lambda n: F.filter("headers", lambda h: h["key"] == n)[0]["value"]
    return again.select(
        "partition", "offset", pick(H.SERVICE).cast("string").alias("service"), F.hex(pick(H.ATTEMPT)).alias("attempt_hex")
    )


@register(
    "attempt_of",
    using("SELECT CAST(att AS BIGINT) AS attempt, count(*) AS n FROM log WHERE kind <> 'tombstone' GROUP BY 1", "log"),
)
def attempt_of(spark, d):
    log = lifecycle_log(spark, d).where("value is not null")
    return log.groupBy(H.attempt_of(H.header(F.col("headers"), H.ATTEMPT)).alias("attempt")).agg(
        F.count(F.lit(1)).alias("n")
    )


@register(
    "due_time",
    using('SELECT p AS "partition", pos AS "offset", due_ms FROM lane', "lane"),
)
def due_time(spark, d):
    return waiting(spark, d).select("partition", "offset", F.unix_millis("due_at").alias("due_ms"))


@register(
    "origin_of",
    using(
        f"""SELECT pos AS "offset", 'order-lifecycle' AS topic, p AS "partition", off AS origin_offset, {iso('ms')} AS origin_time
        FROM lane""",
        "lane",
    ),
)
def origin_of(spark, d):
    return waiting(spark, d).select(
        "offset", "origin.topic", "origin.partition", F.col("origin.offset").alias("origin_offset"),
        F.col("origin.timestamp").alias("origin_time"),
    )


@register(
    "describe_error",
    using(
        r"""SELECT doc_id, CASE WHEN t = '' THEN '<no message>' WHEN length(t) > 500 THEN substr(t, 1, 500) || '…' ELSE t END AS shown
        FROM (SELECT doc_id, regexp_replace(replace(text, chr(10), ' '), '^\s+|\s+$', '', 'g') AS t FROM documents)""",
        "base",
    ),
)
def describe_error(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", X.describe_error(F.col("text")).alias("shown"))
