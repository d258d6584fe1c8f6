"""Vector codes: parts assigned to codebooks by slice-and-intersect bitmasks.

The coordinates of a codebook's entries are sorted per dimension, and every sorted place carries
the mask of the entries before it. A radius around a part selects a range of places per
dimension; the masks at its two ends give the entries of that slice, and the intersection of all
slices is exactly the set of entries in the box. The nearest of them is the nearest of all if it
lies within the radius; else the radius grows to its distance (or doubles) for those rows only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.llm.common import written
from ionloom.llm.vectors import fixed_point

#: Fixed point of components; parts of a vector; entries of a codebook; rounds of refinement.
SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows that are assigned at once, and the share of candidates from which one matrix product is cheaper.
BLOCK_ROWS, DENSE = 4096, 0.25

_SUMS = "part int, entry int, place int, n long, high long, low long"


@dataclass(frozen=True)
class Slices:
    """One codebook with its sorted coordinates and prefix masks."""

    entries: np.ndarray  # entry x place
    order: np.ndarray  # place x rank: coordinates, ascending
    masks: np.ndarray  # place x (rank + 1) x word: entries before that rank
    radius: int


def slices(entries: np.ndarray) -> Slices:
    """``entries`` (whole numbers) prepared for search; the initial radius is the median distance
    between an entry and its nearest other one."""
    count, width = entries.shape
    words = -(-count // 64)
    by = np.argsort(entries, axis=0, kind="stable").T
    masks = np.zeros((width, count + 1, words), np.uint64)
    for place in range(width):
        single = np.zeros((count, words), np.uint64)
        single[np.arange(count), by[place] // 64] = np.uint64(1) << (by[place] % 64).astype(np.uint64)
        masks[place, 1:] = np.bitwise_or.accumulate(single, axis=0)
    gaps = entries.astype(float)
    square = ((gaps[:, None] - gaps[None]) ** 2).sum(2) if count > 1 else np.zeros((1, 1))
    if count > 1:
        np.fill_diagonal(square, np.inf)
    radius = int(np.sqrt(np.median(square.min(1)))) + 1
    return Slices(entries, np.take_along_axis(entries.T, by, axis=1), masks, radius)


def boxes(book: Slices, parts: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Masks (row x word) of the entries within ``radius`` of each part in every dimension."""
    found = None
    for place in range(parts.shape[1]):
        low = np.searchsorted(book.order[place], parts[:, place] - radius, "left")
        high = np.searchsorted(book.order[place], parts[:, place] + radius, "right")
        inside = book.masks[place, high] & ~book.masks[place, low]
        found = inside if found is None else found & inside
    return found


def _wide(*arrays: np.ndarray) -> int:
    return max(max(abs(int(a.max())), abs(int(a.min()))) for a in arrays if a.size)


def _nearest(book: Slices, parts: np.ndarray, found: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Index and exact squared distance of the nearest candidate; -1 where a row has none."""
    count = len(book.entries)
    bits = np.unpackbits(np.ascontiguousarray(found).view(np.uint8), axis=1, bitorder="little")[:, :count].astype(bool)
    index, nearest = np.full(len(parts), -1), np.zeros(len(parts), parts.dtype)
    if room < 1 << 53 and bits.mean() > DENSE:
        p, e = parts.astype(float), book.entries.astype(float)
        square = (p * p).sum(1)[:, None] + (e * e).sum(1) - 2 * (p @ e.T)
        square[~bits] = np.inf
        some, best = bits.any(1), square.argmin(1)
        index[some] = best[some]
        nearest[some] = square[np.arange(len(parts)), best][some].astype(np.int64)
        return index, nearest
    row, entry = np.nonzero(bits)
    if len(row):
        gap = parts[row] - book.entries[entry].astype(parts.dtype)
        square = (gap * gap).sum(1)
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(square, starts)
        hit = np.flatnonzero(square == np.repeat(least, np.diff(np.r_[starts, len(row)])))
        first = hit[np.unique(row[hit], return_index=True)[1]]  # entries ascend within a row
        index[row[first]], nearest[row[first]] = entry[first], square[first]
    return index, nearest


def assign(book: Slices, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part and its squared distance; ties go to the lower index.

    Longs where all squares fit, unbounded whole numbers elsewhere.
    """
    room = 16 * parts.shape[1] * (_wide(parts, book.entries) + book.radius + 1) ** 2
    parts = parts.astype(np.int64 if room < 1 << 63 else object)
    index, square = np.zeros(len(parts), np.int64), np.zeros(len(parts), parts.dtype)
    left, radius = np.arange(len(parts)), np.full(len(parts), book.radius, parts.dtype)
    while len(left):
        at, distance = _nearest(book, parts[left], boxes(book, parts[left], radius), room)
        done = (at >= 0) & (distance <= radius * radius).astype(bool)
        index[left[done]], square[left[done]] = at[done], distance[done]
        # A candidate's own distance bounds the nearest; with none, look twice as far.
        reach = np.ceil(np.sqrt(distance.astype(float)) * (1 + 1e-9)).astype(parts.dtype) + 1
        if parts.dtype == object:
            reach = np.array([int(r) for r in reach], object)
        radius, left = np.where(at >= 0, reach, 2 * radius)[~done], left[~done]
    return index, square


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _assigned(books: list[Slices], x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    width = x.shape[1] // len(books)
    for part, book in enumerate(books):
        rows = x[:, part * width : (part + 1) * width]
        yield part, rows, *assign(book, rows)


def refined(x: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every entry becomes the floor of the mean of its parts; unused entries stay.

    A partition sends one row per entry and place, in two halves that cannot overflow; the
    driver receives the sums, as many as the codebooks have numbers.
    """
    prepared = [slices(b) for b in books]
    width, count = books[0].shape[1], len(books[0])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(prepared), count), np.int64)
        sums = np.zeros((2, len(prepared), count, width), np.int64)
        for batch in batches:
            for start in range(0, len(batch), BLOCK_ROWS):
                for part, rows, at, _ in _assigned(prepared, _matrix(batch.slice(start, BLOCK_ROWS).column(0))):
                    by = np.argsort(at, kind="stable")
                    used, starts = np.unique(at[by], return_index=True)
                    n[part, used] += np.diff(np.r_[starts, len(by)])
                    sums[0, part, used] += np.add.reduceat(rows[by] >> 32, starts, axis=0)
                    sums[1, part, used] += np.add.reduceat(rows[by] & 0xFFFFFFFF, starts, axis=0)
        part, entry = np.nonzero(n)
        if len(part):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(part, width).astype(np.int32)),
                    pa.array(np.repeat(entry, width).astype(np.int32)),
                    pa.array(np.tile(np.arange(width, dtype=np.int32), len(part))),
                    pa.array(np.repeat(n[part, entry], width)),
                    pa.array(sums[0][part, entry].ravel()),
                    pa.array(sums[1][part, entry].ravel()),
                ],
                ["part", "entry", "place", "n", "high", "low"],
            )

    total = x.select("x").mapInArrow(partial, _SUMS).groupBy("part", "entry", "place").agg(
        F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")
    )
    out = [b.copy() for b in books]
    for r in total.collect():
        out[r["part"]][r["entry"], r["place"]] = ((r["high"] << 32) + r["low"]) // r["n"]
    return out


def codebooks(x: DataFrame, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The refined codebooks of ``x`` (vec_id, x): one matrix of whole numbers per part."""
    first = x.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).collect()
    if not first:
        return []
    start = np.array([r["x"] for r in first], np.int64)
    books = np.split(start, PARTS, axis=1)
    for _ in range(rounds):
        books = refined(x, books)
    return books


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all entries' components, by part, entry and place."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame) -> DataFrame:
    """One row per vector that takes part: ``vec_id, code, error, label_error, codebooks_sha256``.

    Vectors that ``fixed_point`` drops, or whose length isn't a multiple of PARTS, have no rows.
    Repeated rows each count and get theirs; null ids come last where ids choose the first
    entries, equal ids in the order of their vectors; fewer vectors than ENTRIES give smaller
    codebooks. Sums that don't fit a long are null. An empty table gives no rows. Other columns
    are ignored; null labels are one group.
    """
    spark = vectors.sparkSession
    x = fixed_point(vectors, SCALE, 0, F.col("vec_id").cast("long").alias("vec_id"), "label").where(F.size("x") % PARTS == 0)
    books = codebooks(x)
    schema = f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, code string, error long"
    if not books:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    prepared = [slices(b) for b in books]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                code = np.zeros((len(part), PARTS), np.uint8)
                error = np.zeros(len(part), object)
                for p, _, at, square in _assigned(prepared, _matrix(part.column(2))):
                    code[:, p] = at
                    error += square
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([c.tobytes().hex() for c in code], pa.string()),
                        pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64()),
                    ],
                    ["vec_id", "label", "code", "error"],
                )

    coded = written(x.select("vec_id", "label", "x").mapInArrow(encode, schema), "vector-codes")
    by_label = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    whole = coded.alias("c").join(by_label.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")))
    return whole.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
