"""Shared pieces of the text operators: table reading, batches, labels' folds, registration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.session import ship, written  # noqa: F401  written is re-exported for the operators

RUNS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Rows and bytes of one Arrow batch. Texts vary from one word to megabytes, so a batch is
#: limited by bytes as well as by rows.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def register(name: str, sql: str | None = None):
    """Add a query under ``name``; ``sql`` is the statement its rows must equal."""

    def add(fn):
        RUNS[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def ready(spark: SparkSession) -> SparkSession:
    """Limit the Arrow batches that carry texts to Python workers, and send the package there."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels must not be learned from; a null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a text column without decoding; null becomes empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def over_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def rows_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
