"""Reading and writing the tables the operators exchange."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PEAKS = T.StructType(
    [
        T.StructField("sample_batch_name", T.StringType()),
        T.StructField("sample_item_id", T.StringType()),
        T.StructField("sample_item_name", T.StringType()),
        T.StructField("datetime_utc", T.TimestampType()),
        T.StructField("peak_id", T.StringType()),
        T.StructField("mz", T.DoubleType()),
        T.StructField("height", T.DoubleType()),
        T.StructField("area", T.DoubleType()),
        T.StructField("sparsity", T.DoubleType()),
    ]
)


def normalise(df: DataFrame, schema: T.StructType = PEAKS) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: absent ones as typed nulls, NaN as null."""
    out = []
    for field in schema:
        col = F.col(field.name) if field.name in df.columns else F.lit(None)
        col = col.cast(field.dataType)
        if isinstance(field.dataType, T.DoubleType):
            col = F.nanvl(col, F.lit(None).cast("double"))
        out.append(col.alias(field.name))
    return df.select(*out)


def load_peaks(spark: SparkSession, path: str, batch: str | None = None) -> DataFrame:
    """Peak table of one batch (or of all); the batch filter prunes partitions."""
    df = spark.read.parquet(path)
    if batch is not None:
        df = df.where(F.col("sample_batch_name") == batch)
    return normalise(df)


def batches_matching(peaks: DataFrame, pattern: str) -> DataFrame:
    """Peaks of every batch whose name matches a case-insensitive pattern."""
    return peaks.where(F.col("sample_batch_name").rlike("(?i)" + pattern))


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail early, on one row's worth of work, when a selection is empty."""
    if df.limit(1).count() == 0:
        raise ValueError(f"no rows for {what}")
    return df


def write_annotated(df: DataFrame, path: str, by: str = "sample_batch_name") -> None:
    """Annotated peaks, partitioned by batch; samples spread over the files of their batch."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def table_digest(df: DataFrame, digits: int = 6) -> DataFrame:
    """Row count and order-insensitive content hash of a table, as one row."""
    cols: Sequence = [
        F.round(c.name, digits).alias(c.name) if isinstance(c.dataType, T.DoubleType) else F.col(c.name)
        for c in df.schema
    ]
    row = F.xxhash64(F.to_json(F.struct(*cols)))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(row.cast("decimal(38,0)")).cast("string").alias("digest"),
    )


def append_registry(spark: SparkSession, path: str, run: dict, digest: DataFrame) -> DataFrame:
    """Append one run (its settings and the digest of its result) to a JSON-lines registry."""
    row = digest
    for name, value in sorted(run.items()):
        row = row.withColumn(name, F.lit(value))
    row.write.mode("append").json(path)
    return spark.read.json(path)


def regroup(samples: DataFrame, move: DataFrame | None = None, copy: DataFrame | None = None) -> DataFrame:
    """Samples moved to and copied into other batches.

    ``move`` and ``copy``: ``(sample_batch_name, sample_item_id, target)``, which
    are themselves the plan to look at before running.
    """
    key = ["sample_batch_name", "sample_item_id"]
    out = samples
    if move is not None:
        out = (
            out.join(move.select(*key, "target"), key, "left")
            .withColumn("sample_batch_name", F.coalesce("target", "sample_batch_name"))
            .drop("target")
            .select(*samples.columns)
        )
    if copy is not None:
        extra = (
            samples.join(copy.select(*key, "target"), key)
            .withColumn("sample_batch_name", F.col("target"))
            .select(*samples.columns)
        )
        out = out.unionByName(extra)
    return out


def rename(samples: DataFrame, names: DataFrame) -> DataFrame:
    """New sample names out of ``(sample_item_id, new_name)``."""
    return (
        samples.join(names.select("sample_item_id", "new_name"), "sample_item_id", "left")
        .withColumn("sample_item_name", F.coalesce("new_name", "sample_item_name"))
        .select(*samples.columns)
    )
