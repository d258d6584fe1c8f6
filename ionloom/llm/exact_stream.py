"""Exact deduplication by a stateful stream.

The stream keeps keyed state on disk (RocksDB) without expiry: digest -> group size and the
holder, i.e. the stable identifier and content locator (file and row) of the document that
stays. Only digests, identifiers and locators move; texts stay where they are, but for the
full-byte check of documents whose digest was met more than once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.llm.common import ascii_lower, in_files, minus, suspects, with_locator, written
from ionloom.session import shared_folder

# Settings of the stream: state on disk, many small stores without space set aside in advance.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


# Micro-batches of a run: every one but the first meets the state that the earlier ones left.
BATCHES = 4


def remember(records: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """Streams ``(digest, doc_id, file, row)`` through the keyed state, by default in ``BATCHES`` parts.

    Returns ``(digest, group_size, holder)`` with the holder of the largest doc_id. Both only
    grow, so the largest values seen are the final ones and a repeated micro-batch is harmless.
    """
    spark = records.sparkSession
    folder = f"{shared_folder(spark)}/dedup-{uuid.uuid4().hex}"
    records.write.parquet(f"{folder}/records")
    if files_per_batch is None:
        files_per_batch = max(1, -(-len(spark.read.schema(records.schema).parquet(f"{folder}/records").inputFiles()) // BATCHES))
    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", files_per_batch)
    state = (
        stream.parquet(f"{folder}/records")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "file", "row")).alias("holder"))
    )

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for k, v in STATE_SETTINGS.items():
        spark.conf.set(k, v)
    try:
        (
            state.writeStream.outputMode("update")
            .foreachBatch(keep)
            .option("checkpointLocation", f"{folder}/stream")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    seen = spark.read.schema(state.schema).parquet(f"{folder}/state")
    return seen.groupBy("digest").agg(F.max("group_size").alias("group_size"), F.max("holder").alias("holder"))


def deduplicate(
    docs: DataFrame, digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, digest`` and its locator.

    Texts are equal when their bytes are, after lower-casing A-Z only. The largest doc_id of
    equal texts stays (null is smallest); of rows that repeat an id exactly one is kept. Null
    counts as the empty text; an empty table gives no rows; extra columns are ignored.
    """
    docs = in_files(docs)
    text = ascii_lower(F.coalesce("text", F.lit("")))
    located = docs.select(
        "doc_id", text.alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    ).withColumn("digest", digest(F.col("text")))
    records = written(located.drop("text"), "dedup-records")
    state = written(remember(records, files_per_batch), "dedup-state")

    met = suspects(located, state.where("group_size > 1"), ["digest"])
    contents = met.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("copies"))
    clashes = written(contents.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "dedup-clash")

    columns = ["doc_id", "keep_id", "group_size", "kept", "digest", "file", "row"]

    def decided(rows: DataFrame) -> DataFrame:
        same = (F.col("file") == F.col("holder.file")) & (F.col("row") == F.col("holder.row"))
        return rows.select(
            "doc_id", F.col("holder.doc_id").alias("keep_id"), "group_size", same.alias("kept"), "digest", "file", "row"
        )

    if clashes.isEmpty():
        return decided(records.join(state, "digest")).select(columns)
    # Unequal texts under one digest: these few are told apart by their bytes.
    apart = located.join(clashes, "digest", "left_semi")
    whole = apart.groupBy("digest", "text").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "file", "row")).alias("holder")
    )
    plain = records.join(clashes, "digest", "left_anti").join(state, "digest")
    return decided(plain).unionByName(decided(apart.join(whole, ["digest", "text"]))).select(columns)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs = in_files(docs)
    dropped = deduplicate(docs).where(~F.col("kept")).select(F.col("file").alias("_ion_file"), F.col("row").alias("_ion_row"))
    return minus(with_locator(docs), dropped, ["_ion_file", "_ion_row"]).drop("_ion_file", "_ion_row")
