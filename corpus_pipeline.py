"""From documents to training sequences: five stages over the whole table.

Each stage takes (spark, docs, sf_dir), works on all rows it gets and returns a table that
is written and read again before the next. All but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.llm import decontam, linededup, nearcopies, packing, toxicity
from eventfold.llm.base import ready, table, written

#: No SQL: the toxicity model is learned, fingerprints need a hash SQL lacks, packing is greedy.
ORACLE_SQL = None


def _without(docs: DataFrame, found: DataFrame, how: str = "left_anti") -> DataFrame:
    """The documents whose id and text hash are not among the rows found; those that are with ``left_semi``."""
    drop = found.select(F.col("doc_id").alias("_d"), F.col("part").alias("_p")).distinct()
    kept = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    return kept.join(drop, (F.xxhash64("text") == F.col("_p")) & F.col("doc_id").eqNullSafe(F.col("_d")), how).select("_row.*")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = toxicity.scorer(model)
    return docs.where(score("text") < toxicity.THRESHOLD)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier one."""
    ready(spark)
    free = "removed" + "_" * max(map(len, docs.columns))
    return linededup.without_repeats(docs, short=True, into=free).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, five-word shingles at least 0.8 alike: the smallest id (null last), then the smallest text hash.

    Different texts with equal or null ids stay apart. Of rows with equal id and text, the
    one whose columns read smallest as JSON stays, so columns without an order, such as maps, do no harm.
    """
    ready(spark)
    found = written(nearcopies.near_groups(docs), "pipeline-components")
    place = F.struct(F.col("doc_id").isNull().alias("k"), "doc_id", "part")
    first = found.groupBy("root").agg(F.min(place).alias("first"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("part") == F.col("first.part"))
    left = _without(docs, found.join(first, "root").where(~same).select("doc_id", "part"))
    twice = written(found.groupBy("doc_id", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "pipeline-repeated")
    if twice.isEmpty():
        return left
    whole = F.struct(*docs.columns)
    one = _without(left, twice, "left_semi").groupBy(F.xxhash64("doc_id", "text").alias("_k"), F.col("doc_id").alias("_d")).agg(
        F.min_by(whole, F.to_json(whole, {"ignoreNullFields": "false"})).alias("_row")
    )
    return _without(left, twice).union(one.select("_row.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("n_hit > 0"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences: one row per piece of a document."""
    ready(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents."""
    docs = table(ready(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
