"""Supervised quality classifier on subword embeddings.

A document is the average of learned vectors of its words, neighbouring word pairs and
character n-grams, all hashed into one table; a softmax layer on it gives the two classes.
Training is plain stochastic gradient descent in numpy on a bounded sample of labelled rows.
Since the output layer is linear, it is folded into the table for scoring: a document's
logit is the average of one number per feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionloom.llm.common import id_remainder

#: Lengths of the character n-grams, in bytes.
GRAMS = (3, 5)
#: Rows of the table, as a power of two; width of a vector.
TABLE_BITS, WIDTH = 17, 16
#: Labelled rows that are learned from at most, chosen by hash of the id (bounds the fit).
SAMPLE = 3000
EPOCHS, RATE = 5, 0.5
#: Features that count as zero in every average, so that a few odd ones decide no short text.
PRIOR = 100
#: Scores from here on are predicted as class 1.
THRESHOLD = 0.7
#: Folds by id that are held out: the remainder of this modulus.
FOLDS, HELD_OUT = 4, 2

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 20


class Features(NamedTuple):
    """Bucket of each feature of a run of texts, group by group, with the texts' bounds."""

    buckets: list[np.ndarray]
    starts: list[np.ndarray]
    ends: list[np.ndarray]


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0x5851F42D4C957F2D & (1 << 64) - 1)) * _MIX
    return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int32)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_P, 1), _powers(_P_INVERSE, 1)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        _UP, _DOWN = _powers(_P, n), _powers(_P_INVERSE, n)
    return _UP[:n], _DOWN[:n]


def features(texts: list[bytes]) -> Features:
    """Hashes of all words, word pairs and n-grams of the texts.

    A rolling sum of byte times a power of an odd number, modulo 2**64, gives the hash of any
    stretch as a difference times the inverse power, whatever stands around it. The hash of a
    word pair is the exclusive or of its words, so all repeated words share one feature.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    up, down = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    out = Features([], [], [])

    blank = (data == 32) | ((data >= 9) & (data <= 13))
    inside = ~blank
    first = inside.copy()
    first[1:] &= blank[:-1]
    first[starts[sizes > 0]] = inside[starts[sizes > 0]]
    last = inside.copy()
    last[:-1] &= blank[1:]
    last[ends[sizes > 0] - 1] = inside[ends[sizes > 0] - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = (total[b] - total[a]) * down[a]
    lo, hi = np.searchsorted(a, starts), np.searchsorted(a, ends)
    for i, (h, cut) in enumerate(((words, 0), (words[:-1] ^ words[1:], 1))):
        out.buckets.append(_bucket(h, i + 1))
        out.starts.append(lo)
        out.ends.append(np.maximum(hi - cut, lo))
    for n in GRAMS:
        h = (total[n:] - total[:-n]) * down[: max(0, len(data) + 1 - n)]
        out.buckets.append(_bucket(h, n + 10))
        out.starts.append(starts)
        out.ends.append(np.maximum(ends - n + 1, starts))
    return out


def _segment_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between bounds; each only depends on its own stretch."""
    out = np.zeros(len(starts))
    full = ends > starts
    if full.any():
        bounds = np.stack([starts[full], ends[full]], 1).ravel()
        out[full] = np.add.reduceat(np.append(values, 0.0), bounds)[::2]
    return out


class Model(NamedTuple):
    """The folded table (log-odds of class 1 per feature) and the intercept."""

    table: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        found = features(texts)
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for bucket, a, b in zip(*found, strict=True):
            total += _segment_sums(self.table[bucket], a, b)
            count += b - a
        return 1 / (1 + np.exp(-(total / (count + PRIOR) + self.bias)))


def _bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights in its average."""
    found = features([text])
    every = np.concatenate([bucket[a[0] : b[0]] for bucket, a, b in zip(*found, strict=True)])
    buckets, counts = np.unique(every, return_counts=True)
    return buckets, (counts / (len(every) + PRIOR)).astype(np.float32)


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Model:
    """Stochastic gradient descent on the embeddings and the softmax layer; no rows give even odds."""
    if not texts:
        return Model(np.zeros(1 << TABLE_BITS), 0.0)
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << TABLE_BITS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    bags = [_bag(t) for t in texts]
    step, steps = 0, epochs * len(texts)
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            buckets, weights = bags[i]
            mean = weights @ table[buckets]
            logits = layer @ mean + bias
            p = np.exp(logits - logits.max())
            slope = p / p.sum()
            slope[labels[i]] -= 1
            slope *= rate * (1 - step / steps)
            step += 1
            # The mean is over many features, so each gets its share of the step times their number.
            table[buckets] -= (weights * len(buckets))[:, None] * (slope @ layer)
            layer -= np.outer(slope, mean)
            bias -= slope
    odds = layer[1] - layer[0]
    return Model((table @ odds).astype(np.float64), float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> DataFrame:
    """``id, y, text`` of the learned rows: those labelled and not held out with the smallest hashes."""
    ids = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    ids = ids.where(id_remainder(F.col("id"), FOLDS) != HELD_OUT).distinct()
    chosen = F.broadcast(ids.orderBy(F.xxhash64("id"), "id", "y").limit(most))
    return docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(chosen, "id")


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Trains in one task on the bounded sample; only the folded table comes back."""

    def learn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in it for r in batch.to_pylist()]
        rows.sort(key=lambda r: (r["id"], r["y"], r["text"]))
        model = train([r["text"] for r in rows], [r["y"] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([model.table.tobytes()]), pa.array([model.bias])], names=["t", "b"])

    got = sample(docs, labels, "quality", most).repartition(1).mapInArrow(learn, "t binary, b double").first()
    return Model(np.frombuffer(got["t"]).copy(), got["b"]) if got else train([], [])


def _runs(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) of runs of rows of bounded length; a text is never cut."""
    start, size, texts = 0, 0, []
    for row, text in enumerate(column):
        data = text.as_py() or b""
        if texts and size + len(data) > _CHUNK:
            yield start, texts
            start, size, texts = row, 0, []
        texts.append(data)
        size += len(data)
    if texts:
        yield start, texts


def score(docs: DataFrame, model: Model, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` plus ``score`` (probability of class 1) and ``predicted``, under the given names.

    Null and empty texts get the intercept's score; repeated rows score alike; an empty table
    gives no rows; columns of ``docs`` named like the new ones are replaced.
    """
    kept = docs.select([c for c in docs.columns if c not in (score, predicted)])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())]
    schema = T.StructType([*kept.schema.fields, *added])
    at = kept.columns.index("text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            parts = [shared.value.scores(texts) for _, texts in _runs(batch.column(at).cast(pa.binary()))]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            good = pa.array((scores >= THRESHOLD).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), good], names=schema.names)

    return kept.mapInArrow(batches, schema)
