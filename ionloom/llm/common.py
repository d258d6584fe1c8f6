"""Helpers shared by the training-data operators: reading, shared tables, running totals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ionloom.session import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Slots of the filters that spare rows a shuffle; at most so many rows are broadcast.
SLOTS = 1 << 18
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: the lineage ends at files that
    outlive executors."""
    return stored(df, label)[0]


def in_files(docs: DataFrame) -> DataFrame:
    """``docs`` with a readable locator (file, row); rows that are not in files yet are written."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return docs
    except AnalysisException:
        return written(docs, "content")


def with_locator(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` (from ``in_files``) plus ``_ion_file`` and ``_ion_row``."""
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("_ion_file", "_ion_row")]
    return docs.select(*columns, F.col("_metadata.file_path").alias("_ion_file"), F.col("_metadata.row_index").alias("_ion_row"))


def _slot(on: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(SLOTS)).alias("_ion_slot")


def suspects(df: DataFrame, among: DataFrame, on: Sequence[str]) -> DataFrame:
    """The rows of ``df`` that may have a partner in ``among``: all that have one, few others.

    What is broadcast is a set of slots, at most ``SLOTS`` rows of one number whatever the
    size of ``among``. More partners than slots only let more rows through.
    """
    slots = F.broadcast(among.select(_slot(on)).distinct())
    return df.withColumn("_ion_slot", _slot(on)).join(slots, "_ion_slot", "left_semi").drop("_ion_slot")


def minus(df: DataFrame, gone: DataFrame, on: Sequence[str]) -> DataFrame:
    """``df`` without the rows that have a partner in ``gone``; the others mostly stay in place.

    Only suspects are shuffled with their columns, for the exact anti-join.
    """
    slots = F.broadcast(gone.select(_slot(on)).distinct())
    safe = df.withColumn("_ion_slot", _slot(on)).join(slots, "_ion_slot", "left_anti").drop("_ion_slot")
    return safe.unionByName(suspects(df, gone, on).join(gone.select(*on).distinct(), list(on), "left_anti").select(df.columns))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else. Plain ASCII texts take the built-in fast path."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    order: Sequence[str],
    out: str,
    hashed: Sequence[str] | None = None,
) -> DataFrame:
    """Adds ``out``: the total of ``value`` over the rows of the same keys that come before.

    The order is that of md5 of ``hashed`` (``order`` if not given), then ``order``, which must
    tell rows apart; ``keys`` must not be null. Two levels: a window over the totals of the
    4096 hash ranges of a key, and a window inside each range, so that a key with a third of
    all rows is spread over 4096 groups.
    """
    keys = list(keys)
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in hashed or order]).cast("binary"))
    rows = df.withColumn("_ion_hash", digest).withColumn("_ion_range", F.substring("_ion_hash", 1, 3)).withColumn("_ion_value", value)
    along = Window.partitionBy(*keys).orderBy("_ion_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = (
        rows.groupBy(*keys, "_ion_range")
        .agg(F.sum("_ion_value").alias("_ion_sum"))
        .select(*keys, "_ion_range", (F.sum("_ion_sum").over(along) - F.col("_ion_sum")).alias("_ion_base"))
    )
    inside = (
        Window.partitionBy(*keys, "_ion_range")
        .orderBy("_ion_hash", *order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.join(base, [*keys, "_ion_range"])
        .withColumn(out, F.col("_ion_base") + F.sum("_ion_value").over(inside) - F.col("_ion_value"))
        .drop("_ion_hash", "_ion_range", "_ion_value", "_ion_base")
    )


def text_slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of rows of about ``most_bytes``; null texts come as empty.

    A text is never cut: one longer than ``most_bytes`` is a run of its own.
    """
    array = batch.column(batch.schema.get_field_index(column))
    start, size, texts = 0, 0, []
    for row in range(len(array)):
        text = array[row].as_py() or ""
        if texts and size + len(text) > most_bytes:
            yield start, texts
            start, size, texts = row, 0, []
        texts.append(text)
        size += len(text)
    if texts:
        yield start, texts
