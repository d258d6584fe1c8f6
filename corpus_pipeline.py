"""The corpus pipeline: five stages over ``documents``, each written before the next reads it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ionloom.llm import bpe, exact_stream, mixing, resembling
from ionloom.llm import quality as classifier
from ionloom.llm.common import documents, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.score(docs, model, "_ion_score", "_ion_good").where("_ion_good = 1").drop("_ion_score", "_ion_good")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_stream.keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that resembles in five-word shingles the document with the smallest id stays."""
    return resembling.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, a row per copy that the mix takes; those it doesn't take go."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, token_ids, n_tokens`` of each row, in its place, and a digest of the text decoded from the ids."""
    rows = docs.select("doc_id", "lang", "source", "text")
    return bpe.encode(rows, public_tokenizers.path("byte_bpe_50k.json"), keep_text=False, check=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("encode", encode),
]

# The classifier is trained, which SQL cannot express; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
