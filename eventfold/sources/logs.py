"""Reading logs, batch and streaming, from Parquet tables or from Kafka."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.schemas import LOG_COLUMNS, LOG_SCHEMA


def read_log(spark: SparkSession, path: str, topic: str | None = None) -> DataFrame:
    """A log table. A topic filter prunes the folders of the other topics."""
    log = spark.read.schema(LOG_SCHEMA).parquet(path)
    return log if topic is None else log.where(F.col("topic") == topic)


def stream_log(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """The same table as a stream of new files."""
    reader = spark.readStream.schema(LOG_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def kafka_options(
    servers: str,
    topics: Sequence[str],
    *,
    starting: str | Mapping[str, Mapping[int, int]] = "earliest",
    ending: Mapping[str, Mapping[int, int]] | None = None,
    assign: Mapping[str, Sequence[int]] | None = None,
    read_committed: bool = True,
    max_per_trigger: int | None = None,
) -> dict[str, str]:
    """Options of the Kafka source for a subscription, an assignment, or a bounded read."""

    def positions(spec):
        if isinstance(spec, str):
            return spec
        return json.dumps({t: {str(p): o for p, o in parts.items()} for t, parts in spec.items()})

    out = {
        "kafka.bootstrap.servers": servers,
        "startingOffsets": positions(starting),
        "includeHeaders": "true",
        "failOnDataLoss": "true",
        "kafka.isolation.level": "read_committed" if read_committed else "read_uncommitted",
    }
    if assign:
        out["assign"] = json.dumps({t: list(p) for t, p in assign.items()})
    else:
        out["subscribe"] = ",".join(topics)
    if ending is not None:
        out["endingOffsets"] = positions(ending)
    if max_per_trigger:
        out["maxOffsetsPerTrigger"] = str(max_per_trigger)
    return out


def _log_columns(raw: DataFrame) -> DataFrame:
    return raw.select(*[F.col(c) for c in LOG_COLUMNS])


def read_kafka(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    """A bounded batch read; needs the Kafka connector on the classpath."""
    return _log_columns(spark.read.format("kafka").options(**options).load())


def stream_kafka(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    return _log_columns(spark.readStream.format("kafka").options(**options).load())
