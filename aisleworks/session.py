"""Spark session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Join strategy is left to Catalyst and AQE: a side is broadcast only when its
#: estimated (or, at run time, measured) size is below the threshold, and skewed
#: shuffle partitions are split even where that costs another exchange.
DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # Methods above 8 kB of bytecode are never JIT-compiled; wide cleaning projections
    # would run interpreted. Past this limit Spark generates them in compilable pieces.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app_name: str = "aisleworks", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a folder below its warehouse; a cluster has to name one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to Python workers that would not find it: those started elsewhere than in its root."""
    root = Path(__file__).resolve().parents[1]
    found = str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or Path.cwd() == root
    if not found and spark.sparkContext.applicationId not in _SHIPPED:
        _SHIPPED.add(spark.sparkContext.applicationId)
        archive = Path(tempfile.mkdtemp()) / "aisleworks"
        spark.sparkContext.addPyFile(shutil.make_archive(str(archive), "zip", root, "aisleworks"))


#: Spark keeps a query's shuffle files until the driver's memory is collected, however long that takes, unless this is set.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries built and run within the block delete their shuffle files when they end."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


#: Codec of tables that are written to be read again a few times.
CODEC = "zstd"


def materialize(df: DataFrame | list[DataFrame], label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    A table given in parts is written part by part, so that the shuffles of one lie on disk at a time.

    Cuts lineage with a table that outlives any executor, keeps column pruning
    and filter pushdown for its readers, and gives Catalyst real sizes. The caller
    owns the table and gives it to ``release`` when nothing reads it any more.
    """
    parts = [df] if isinstance(df, DataFrame) else df
    spark = parts[0].sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    for number, part in enumerate(parts):
        writer = part.write.mode("append" if number else "errorifexists").option("compression", CODEC)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with short_lived_shuffles(spark):
            writer.parquet(path)
    table = spark.read.schema(parts[0].schema).parquet(path)
    _WRITTEN[id(table)] = (table, path)
    return table


#: Tables written here and not yet released, with their folders.
_WRITTEN: dict[int, tuple[DataFrame, str]] = {}


def is_written(table: DataFrame) -> bool:
    """Whether ``materialize`` gave this very table, so that reading it again computes nothing."""
    known = _WRITTEN.get(id(table))
    return known is not None and known[0] is table


def release(table: DataFrame) -> None:
    """Delete the folder of a table that ``materialize`` wrote; a table it did not write is left alone."""
    known = _WRITTEN.pop(id(table), None)
    if known is not None:
        spark = table.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(known[1])
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def materialized(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``materialize`` for the time of a ``with`` block."""
    table = materialize(df, label)
    try:
        yield table
    finally:
        release(table)
