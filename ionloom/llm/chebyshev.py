"""Whitening of vectors by Chebyshev-filtered subspace iteration.

The covariance is never formed. A block of columns Q goes to the workers, each partition of the
fit list returns its share of Xc'(Xc Q), Xc being centred first, and the driver adds matrices of
dimension x block. A polynomial recurrence over such passes damps the unwanted part of the
spectrum (between a Lanczos bound and the least Ritz value of the block); QR and Rayleigh-Ritz
follow, until the residuals of all wanted pairs are certified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.llm.common import written
from ionloom.llm.vectors import fixed_point

#: Entries become floor(SCALE * c) + OFFSET; the components kept; further columns of the block.
SCALE, OFFSET, COMPONENTS, GUARD = 64, 1_000_000, 16, 16
#: Degree of the filter, Lanczos steps for its lower end, most rounds.
DEGREE, LANCZOS, ROUNDS = 10, 8, 60
#: Residuals are certified at SURE times the largest eigenvalue; beneath NIL of it is no component.
SURE, NIL = 1e-13, 1e-12
#: Rows of a packed block; partial matrices that reach the driver at most.
BLOCK_ROWS, PARTIALS = 4096, 64

_PARTIAL = "bucket int, part binary"


@dataclass(frozen=True)
class Fit:
    """The fit list: packed blocks, its size, exact sums, and the mean as whole and fraction."""

    blocks: DataFrame
    n: int
    sums: tuple[int, ...]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], object)

    @property
    def fraction(self) -> np.ndarray:
        return np.array([(s % self.n) / self.n for s in self.sums])


@dataclass(frozen=True)
class Whitening:
    """Unit eigenvectors (columns) by falling eigenvalue, shares of the trace, and how exact they are."""

    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    residual: float
    identity_error: float


def _rows(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows as bytes, with the sums of each in two halves that cannot overflow."""
    for batch in batches:
        for start in range(0, len(batch), BLOCK_ROWS):
            x = _rows(batch.slice(start, BLOCK_ROWS).column(0))
            high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
            yield pa.RecordBatch.from_pydict(
                {"rows": [len(x)], "block": [np.ascontiguousarray(x).tobytes()], "high": [high.tolist()], "low": [low.tolist()]}
            )


def fit_list(x: DataFrame) -> Fit | None:
    """Each distinct vector of ``x`` once, packed and written; None if there is none."""
    distinct = x.select("x").distinct()
    blocks = written(distinct.mapInArrow(_packed, "rows long, block binary, high array<long>, low array<long>"), "fit-list")
    n = blocks.agg(F.sum("rows")).first()[0]
    if not n:
        return None
    halves = blocks.select(F.posexplode(F.arrays_zip("high", "low")).alias("d", "s"))
    sums = halves.groupBy("d").agg(F.sum("s.high").alias("high"), F.sum("s.low").alias("low")).orderBy("d").collect()
    return Fit(blocks.select("rows", "block"), n, tuple((r["high"] << 32) + r["low"] for r in sums))


def added(fit: Fit, share: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``share(Xc)`` over the blocks of the fit list: per partition on the workers,
    then per bucket if there are many partitions, so that at most PARTIALS matrices are collected."""
    whole, fraction, width = fit.whole, fit.fraction, len(fit.sums)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            for block in batch.column(0):
                x = np.frombuffer(block.as_buffer(), np.int64).reshape(-1, width)
                more = share((x - whole).astype(float) - fraction)
                total = more if total is None else total + more
        if total is not None:
            bucket = TaskContext.get().partitionId() % PARTIALS
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([total.tobytes()])], ["bucket", "part"])

    def merge(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p.as_buffer(), float) for p in table.column("part"))
        return pa.table({"bucket": table.column("bucket").combine_chunks()[:1], "part": pa.array([total.tobytes()])})

    parts = fit.blocks.select("block").mapInArrow(partial, _PARTIAL)
    if fit.blocks.rdd.getNumPartitions() > PARTIALS:
        parts = parts.groupBy("bucket").applyInArrow(merge, _PARTIAL)
    rows = sorted(parts.collect(), key=lambda r: r["bucket"])
    return sum(np.frombuffer(bytes(r["part"]), float) for r in rows)


def times_covariance(fit: Fit, q: np.ndarray) -> np.ndarray:
    """V q by one pass over the fit list."""
    return added(fit, lambda c: c.T @ (c @ q)).reshape(q.shape) / fit.n


def lower_bound(times: Callable[[np.ndarray], np.ndarray], width: int, rng: np.random.Generator) -> float:
    """A bound of the least eigenvalue from a few Lanczos steps, at least zero."""
    basis = [v := rng.normal(size=width)]
    basis[0] = v / np.linalg.norm(v)
    images = []
    for _ in range(min(LANCZOS, width)):
        image = times(basis[-1][:, None])[:, 0]
        images.append(image)
        left = image.copy()
        for _ in range(2):
            for b in basis:
                left -= (b @ left) * b
        norm = np.linalg.norm(left)
        if norm <= 1e-12 * max(np.linalg.norm(image), 1e-300) or len(images) == min(LANCZOS, width):
            break
        basis.append(left / norm)
    b, a = np.array(basis[: len(images)]).T, np.array(images).T
    values, vectors = np.linalg.eigh((b.T @ a + a.T @ b) / 2)
    residual = np.linalg.norm(a @ vectors[:, 0] - values[0] * (b @ vectors[:, 0]))
    return max(0.0, values[0] - residual)


def filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, image: np.ndarray, low: float, high: float, top: float) -> np.ndarray:
    """A Chebyshev polynomial of the covariance applied to ``q`` (whose ``image`` is known):
    small on [low, high], growing above, scaled to 1 at ``top``."""
    centre, half = (high + low) / 2, (high - low) / 2
    scale = half / (top - centre)
    first = scale
    before, now = q, (image - centre * q) * (scale / half)
    for _ in range(DEGREE - 1):
        after = 1 / (2 / first - scale)
        before, now = now, (times(now) - centre * now) * (2 * after / half) - before * (scale * after)
        scale = after
    return now


def certified(fit: Fit, components: int = COMPONENTS, seed: int = 7) -> Whitening:
    """The leading eigenpairs of the fit list's covariance.

    Directions without variance are no components, so there may be fewer than asked. Equal
    eigenvalues give some orthonormal basis of their space.
    """
    width, rng = len(fit.sums), np.random.default_rng(seed)

    def times(q: np.ndarray) -> np.ndarray:
        return times_covariance(fit, q)

    trace = float(added(fit, lambda c: np.array([(c * c).sum()]))[0]) / fit.n
    wanted, block = min(components, width), min(components + GUARD, width)
    q = np.linalg.qr(rng.normal(size=(width, block)))[0]
    low, image, best = (lower_bound(times, width, rng) if block < width else 0.0), times(q), None
    for _ in range(ROUNDS):
        small = q.T @ image
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        residual = float(np.linalg.norm(image - q * ritz, axis=0)[:wanted].max())
        if best is None or residual < best[0]:
            best, stale = (residual, ritz[:wanted].copy(), q[:, :wanted].copy()), 0
        else:
            stale += 1
        top = ritz[0]
        # Rounding may keep residuals above the certificate; a round that gains nothing there ends it.
        if top <= 0 or residual <= SURE * top or block == width or (stale and best[0] <= 1e3 * SURE * top):
            break
        high = max(ritz[-1], low + 1e-6 * (top - low))
        if high >= top:
            break
        q = np.linalg.qr(filtered(times, q, image, low, high, top))[0]
        image = times(q)
    residual, values, vectors = best
    some = values > NIL * max(trace, 0.0)
    values, vectors = values[some], vectors[:, some]
    error = 0.0
    if len(values):
        w = vectors / np.sqrt(values)
        covariance = added(fit, lambda c: (p := c @ w).T @ p).reshape(len(values), -1) / fit.n
        error = float(np.abs(covariance - np.eye(len(values))).max())
    return Whitening(values, vectors, values / trace if trace > 0 else values, residual, error)


def deviations(x: np.ndarray, n: int, whole: np.ndarray, rest: np.ndarray) -> list[int | None]:
    """Per row the exact sum of (n * x - S)^2; None where it doesn't fit a long."""
    centred = x - whole
    widest = n * (int(np.abs(centred).max(initial=0)) + 1)
    if x.shape[1] * widest * widest < 1 << 63:
        return ((n * centred - rest.astype(np.int64)) ** 2).sum(1).tolist()
    about = ((n * centred.astype(float)) ** 2).sum(1)
    out: list[int | None] = []
    for row, size in zip(centred, about, strict=True):
        exact = None if size > 2.0**64 else sum((n * int(c) - int(r)) ** 2 for c, r in zip(row, rest, strict=True))
        out.append(exact if exact is not None and exact < 1 << 63 else None)
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector that takes part and component: ``vec_id, component, n, deviation,
    whitened, explained, identity_error``.

    Vectors that ``fixed_point`` drops have no rows. Repeated rows each get theirs; of equal
    vectors one is in the fit list. ``deviation`` is null where it doesn't fit a long. An empty
    table, or one without variance, gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = fixed_point(vectors, SCALE, OFFSET, F.col("vec_id").cast("long").alias("vec_id"))
    fit = fit_list(x)
    model = certified(fit, components) if fit else None
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    n, whole, rest, fraction = fit.n, fit.whole, fit.rest, fit.fraction
    turn, k = model.vectors / np.sqrt(model.values), len(model.values)
    explained, error = model.explained, model.identity_error

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                rows = _rows(part.column(1))
                ids = np.repeat(np.arange(len(rows)), k)
                white = ((rows - whole).astype(float) - fraction) @ turn
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(ids)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(len(ids), n, np.int64)),
                        pa.array(deviations(rows, n, whole, rest), pa.int64()).take(pa.array(ids)),
                        pa.array(white.ravel()),
                        pa.array(np.tile(explained, len(rows))),
                        pa.array(np.full(len(ids), error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return x.select("vec_id", "x").mapInArrow(apply, schema)
