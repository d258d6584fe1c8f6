"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(cores: str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ionloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for key, value in {**RUNTIME_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings the operators rely on (UTC clock, adaptive plans)."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A local session (a test, the bench) that names none gets a folder of its own; on a
    cluster a folder of one machine would lose data, so that is an error.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


# Shuffle files of a write have no reader once its table is there.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_scopes = threading.local()


def _open() -> list[list[tuple[DataFrame, str]]]:
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    return _scopes.open


def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` as a table of its own in the shared folder, read back, and its path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path), path


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, read back; it survives the loss of executors.

    Files by column take a fraction of the disk of a checkpoint of rows, and their size is known
    to later joins. Inside a :func:`scratch` the table goes with it.
    """
    table, path = stored(df, "cut")
    if _open():
        _open()[-1].append((table, path))
    return table


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables cut inside are removed at the end, so that long jobs hold only what is still read.

    What leaves the block must be given to the function it yields: a table passes to the block around, anything else is cut first.
    """
    _open().append([])

    def keep(df: DataFrame) -> DataFrame:
        mine = _open()[-1]
        entry = next((e for e in mine if e[0] is df), None)
        if entry is None:
            entry = stored(df, "cut")
        else:
            mine.remove(entry)
        if len(_open()) > 1:
            _open()[-2].append(entry)
        return entry[0]

    try:
        yield keep
    finally:
        for _, path in _open().pop():
            forget(spark, path)


def release(df: DataFrame) -> None:
    """Removes a table of the open blocks before their end; any other ``df`` is left alone."""
    for mine in _open():
        for entry in [e for e in mine if e[0] is df]:
            mine.remove(entry)
            forget(df.sparkSession, entry[1])


def forget(spark: SparkSession, path: str) -> None:
    """Removes a table of ``stored`` that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
