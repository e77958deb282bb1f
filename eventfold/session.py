"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: What the library relies on. UTC keeps log times comparable; duplicate keys in a JSON
#: object resolve to the last one, as most JSON readers do. The JVM does not compile methods of
#: more than 8,000 bytes, and decoding would run interpreted in one such method.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the defaults to a running session and make the package known to its executors."""
    for name, value in SESSION_CONF.items():
        spark.conf.set(name, value)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per Spark context.

    Spark's file server carries them, so executors need neither an installation nor a shared
    folder. With the package installed everywhere, or given by ``--py-files``, it is harmless.
    """
    context = spark.sparkContext
    if getattr(context, "_eventfold_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(package):  # else it came in an archive that the executors have already
        path = os.path.join(tempfile.mkdtemp(prefix="eventfold-"), "eventfold_src.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        archive.write(full, os.path.relpath(full, os.path.dirname(package)))
        context.addPyFile(path)
    context._eventfold_shipped = True


def build_session(app: str = "eventfold", master: str | None = None, **conf) -> SparkSession:
    """Build a session with the defaults; extra settings use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # Call-site capture on every column expression slows down plan building.
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    for name, value in {**SESSION_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """Return a new path in the cluster's shared folder.

    The folder is the one ``spark.checkpoint.dir`` names. Where that is unset, a temporary
    folder takes its place on a local master; elsewhere executors could not see it, so it
    is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-eventfold-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write rows to the shared folder and read them back.

    For a narrow result of costly work that is read more than once, such as decoded
    columns: it is computed once, and a lost executor does not bring the work back.
    """
    path = work_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
