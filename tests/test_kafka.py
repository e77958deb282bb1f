"""Options and column mapping of the Kafka source; the connector itself is not here."""

import json

from eventfold.schemas import LOG_COLUMNS, LOG_SCHEMA
from eventfold.sources import logs as L

#: Columns of the Kafka source with headers, in its order.
RAW = (
    "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, timestampType int, "
    "headers array<struct<key:string,value:binary>>"
)


def test_a_subscription_reads_from_the_start_and_commits_only():
    got = L.kafka_options("b1:9092,b2:9092", ["order-lifecycle", "order-snapshot"])
    assert got == {
        "kafka.bootstrap.servers": "b1:9092,b2:9092", "subscribe": "order-lifecycle,order-snapshot", "startingOffsets": "earliest",
        "includeHeaders": "true", "failOnDataLoss": "true", "kafka.isolation.level": "read_committed",
    }


def test_bounds_are_offsets_per_partition():
    got = L.kafka_options("b:9092", ["t"], starting={"t": {0: 5, 2: -2}}, ending={"t": {0: 9, 2: -1}})
    assert json.loads(got["startingOffsets"]) == {"t": {"0": 5, "2": -2}}
    assert json.loads(got["endingOffsets"]) == {"t": {"0": 9, "2": -1}}
    assert L.kafka_options("b:9092", ["t"], starting="latest")["startingOffsets"] == "latest"
    assert "endingOffsets" not in L.kafka_options("b:9092", ["t"])


def test_an_assignment_takes_the_place_of_a_subscription():
    got = L.kafka_options("b:9092", ["t"], assign={"t": (1, 2)})
    assert json.loads(got["assign"]) == {"t": [1, 2]} and "subscribe" not in got


def test_trigger_bound_and_isolation():
    got = L.kafka_options("b:9092", ["t"], max_per_trigger=500, read_committed=False)
    assert got["maxOffsetsPerTrigger"] == "500" and got["kafka.isolation.level"] == "read_uncommitted"


def test_source_columns_become_log_columns(spark):
    raw = spark.createDataFrame([], RAW)
    mapped = L._log_columns(raw)
    assert mapped.columns == list(LOG_COLUMNS)
    assert [f.dataType for f in mapped.schema] == [f.dataType for f in spark.createDataFrame([], LOG_SCHEMA).schema]
