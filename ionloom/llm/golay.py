"""Near-duplicates by SimHash, found with Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 22 bits. Seen as 23-bit words, the
segments are decoded to the codewords of the binary Golay code within distance 4: one if the
nearest is at distance 2 or less, otherwise six. Two words at distance 2 or less always share
one of these codewords.

Two errors fall on three segments such that some segment has none (pigeonhole), so a key is
a segment taken exactly together with one codeword of the next segment. Fingerprints that
share a key are candidates and verified bit by bit.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.llm.common import in_files, minus, with_locator, written
from ionloom.llm.components import components

WORDS = 3
SEED = 42
MOST_BITS = 2
# (lowest bit, width) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
# Generator polynomial of the (23, 12) code.
GENERATOR = 0xC75
# Buckets up to this size are paired directly, larger ones by way of midpoints.
PAIRED = 32
_BLOCK = 1 << 14


def fingerprint(text: bytes) -> int:
    """SimHash of the 3-word shingles of ``text``: a bit is set if over half the hashes set it."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < WORDS:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False))
    ones, total = np.zeros(64, np.int64), 0
    while block := [xxhash.xxh64_intdigest(s, SEED) for s in itertools.islice(shingles, _BLOCK)]:
        bits = np.unpackbits(np.array(block, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.uint32)
        total += len(block)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, _ion_file, _ion_row, fp`` with the fingerprint as a signed long; null text is empty."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            marks = [fingerprint(text.as_py() or b"") for text in batch.column(3)]
            fp = pa.array(np.array(marks, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], fp], names=["doc_id", "_ion_file", "_ion_row", "fp"])

    rows = with_locator(docs.select("doc_id", "text")).select("doc_id", "_ion_file", "_ion_row", F.col("text").cast("binary"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"doc_id {id_type}, _ion_file string, _ion_row long, fp long")


def _syndrome(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def decoding() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes by 12-bit halves of a word, and the error patterns by syndrome.

    A row of patterns holds the one of weight 3 or less first, then, if that has weight 3,
    the five of weight 4 of the same coset; unused places repeat the first.
    """
    columns = [_syndrome(1 << i) for i in range(23)]
    found: dict[int, list[int]] = {}
    for weight in range(5):
        for bits in itertools.combinations(range(23), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= columns[b]
            near = found.setdefault(syndrome, [])
            if weight < 4 or near[0].bit_count() == 3:
                near.append(sum(1 << b for b in bits))
    patterns = np.zeros((2048, 6), np.int64)
    for syndrome, near in found.items():
        patterns[syndrome] = near + near[:1] * (6 - len(near))
    low = np.array([_syndrome(i) for i in range(1 << 12)], np.int64)
    high = np.array([_syndrome(i << 12) for i in range(1 << 11)], np.int64)
    return low, high, patterns


def codewords(words: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """For each word six codeword indices (12 bits), all within distance 4, repeats included."""
    low, high, patterns = tables
    return (words[:, None] ^ patterns[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def fuzzy_keys(marks: DataFrame) -> DataFrame:
    """``key, fp`` for each distinct fingerprint in ``marks (fp)``: 3 to 18 keys each."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = decoding()
        for batch in it:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            parts = [(fp.view(np.uint64) >> np.uint64(lo) & np.uint64((1 << n) - 1)).astype(np.int64) for lo, n in SEGMENTS]
            for i, exact in enumerate(parts):
                near = codewords(parts[(i + 1) % 3], tables)
                keys = (i << 34 | exact << 12)[:, None] | near
                used = np.ones(near.shape, bool)
                used[:, 1:] = near[:, 1:] != near[:, :1]
                at = np.nonzero(used)[0]
                yield pa.RecordBatch.from_arrays([pa.array(keys[used]), pa.array(fp[at])], names=["key", "fp"])

    return marks.select("fp").mapInArrow(batches, "key long, fp long")


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(marks: DataFrame) -> DataFrame:
    """``(u, v)``: enough pairs of fingerprints at distance 2 or less to connect all that are.

    In a bucket of a few, all pairs are verified. Fingerprints of larger buckets meet at
    midpoints instead: two are at distance 2 or less exactly if some word is at distance 1 or
    less from both. At most 65 fingerprints share a midpoint, all of them are linked to each
    other, so linking them to the least is enough. That stays linear in the bucket's size.
    """
    keys = written(fuzzy_keys(marks), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(keys.join(sizes, "key"), "golay-shared")
    few = shared.where(F.col("n") <= PAIRED)
    near = (
        few.select("key", F.col("fp").alias("u"))
        .join(few.select("key", F.col("fp").alias("v")), "key")
        .where((F.col("u") < F.col("v")) & (_differ("u", "v") <= MOST_BITS))
        .select("u", "v")
    )
    many = shared.where(F.col("n") > PAIRED).select("fp").distinct()
    flips = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")) for b in range(64)]]
    stars = (
        many.select("fp", F.explode(F.array(*flips)).alias("mid"))
        .groupBy("mid")
        .agg(F.min("fp").alias("u"), F.collect_list("fp").alias("all"))
        .where(F.size("all") > 1)
        .select("u", F.explode("all").alias("v"))
        .where("u < v")
    )
    return near.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id`` and its locator, plus ``holder``.

    ``component_id`` is the smallest doc_id reachable over links, ``holder`` that row
    (``id, _ion_file, _ion_row``). Texts without words have fingerprint 0 and are linked like others;
    null ids count as largest; rows that repeat an id are separate documents; an empty table
    gives no rows; extra columns are ignored.
    """
    rows = written(fingerprints(in_files(docs)), "simhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "_ion_file", "_ion_row"))
    marks = written(rows.groupBy("fp").agg(first.alias("first")), "simhash-marks")
    roots = components(links(marks)).select(F.col("u").alias("fp"), "root")
    rooted = written(
        marks.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots"
    )
    holders = rooted.groupBy("root").agg(F.min("first").alias("holder"))
    owned = rooted.select("fp", "root").join(holders, "root").select("fp", "holder")
    return rows.join(owned, "fp").select("doc_id", "fp", F.col("holder.id").alias("component_id"), "_ion_file", "_ion_row", "holder")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component stays, the one with the smallest id, with all columns."""
    docs = in_files(docs)
    stays = (F.col("_ion_file") == F.col("holder._ion_file")) & (F.col("_ion_row") == F.col("holder._ion_row"))
    dropped = written(near_duplicates(docs).where(~stays).select("_ion_file", "_ion_row"), "simhash-dropped")
    return minus(with_locator(docs), dropped, ["_ion_file", "_ion_row"]).drop("_ion_file", "_ion_row")
