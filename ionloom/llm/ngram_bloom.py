"""Language-model scores from a log-frequency Bloom filter.

N-gram counts are quantised to levels of powers of two. An n-gram of level q is entered q
times, once per level, so its level is found by probing level after level until one is
missing. All n-grams enter, from the first occurrence on. The filter is cut into segments by
hash, each as wide as its own entries ask, so it grows with the corpus. A filter within a
checked size is broadcast; a larger one stays a table, and probes are joined to their segment.
Documents are scored with smoothed probabilities made of the levels of words and word pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.llm.common import id_remainder, written

#: Documents whose crc32(doc_id) has remainder 0 are held out.
FOLDS = 10
#: The end of a text as a token; no word can be a line break.
END = b"\n"
#: Segments of the filter, as a power of two.
SEGMENT_BITS = 14
#: Probes per level, and bits per entry; an absent n-gram passes with probability 0.024.
PROBES, ENTRY_BITS = 4, 8
#: A filter of up to so many bytes is broadcast; probes are joined to the segments of a larger one.
BROADCAST_BYTES = 128 << 20
#: Weight of the pair estimate against the word estimate.
LAMBDA = 0.5
#: Added to every word count.
ADDED = 0.1
#: Exact counts of at most so many of the most frequent words are sent to the workers; the
#: others are joined.
FREQUENT = 1 << 17

_START = np.uint64(0x9FB21C651E98DF25)
_CHUNK = 4 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Tokens(NamedTuple):
    """Tokens of a run of texts: distinct ones, their hashes, and per place a code and a pair hash."""

    distinct: list[bytes]
    hashes: np.ndarray
    codes: np.ndarray
    previous: np.ndarray  # code of the token before, -1 at the start of a text
    pairs: np.ndarray
    starts: np.ndarray


def tokenize(texts: list[bytes]) -> Tokens:
    """Words after lower-casing A-Z, then one end per text."""
    words = [[*t.lower().split(), END] for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = [w for ws in words for w in ws]
    distinct = list(set(flat))
    index = dict(zip(distinct, range(len(distinct)), strict=True))
    codes = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in distinct], np.uint64)
    starts = np.cumsum(sizes) - sizes
    previous = np.r_[np.int64(-1), codes[:-1]]
    previous[starts] = -1
    before = np.where(previous < 0, _START, hashes[previous])
    pairs = _mix(before * np.uint64(0x9E3779B97F4A7C15) + hashes[codes])
    return Tokens(distinct, hashes, codes, previous, pairs, starts)


def _runs(column: pa.Array, most: int = _CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of runs of rows of bounded length; a text is never cut, null is empty."""
    start, size, texts = 0, 0, []
    for row, text in enumerate(column):
        data = text.as_py() or b""
        if texts and size + len(data) > most:
            yield start, texts
            start, size, texts = row, 0, []
        texts.append(data)
        size += len(data)
    if texts:
        yield start, texts


def _segment(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SEGMENT_BITS)).astype(np.int64)


def count(texts: DataFrame) -> DataFrame:
    """``s, h, word, n``: counts of words (with the word) and of word pairs (``word`` null) of
    ``texts (text)``, the rows of a segment ``s`` in one partition. One shuffle."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for _, run in _runs(batch.column(0)):
                t = tokenize(run)
                pairs, times = np.unique(t.pairs, return_counts=True)
                h = np.concatenate([t.hashes, pairs])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_segment(h).astype(np.int32)),
                        pa.array(h.view(np.int64)),
                        pa.array([*t.distinct, *[None] * len(pairs)], pa.binary()),
                        pa.array(np.concatenate([np.bincount(t.codes, minlength=len(t.distinct)), times])),
                    ],
                    names=["s", "h", "word", "n"],
                )

    parts = texts.select(F.col("text").cast("binary")).mapInArrow(batches, "s int, h long, word binary, n long")
    # Parts of a segment meet by its number; the groups below it then need no further shuffle.
    return parts.repartition("s").groupBy("s", "h", "word").agg(F.sum("n").alias("n"))


def _levels(counts: np.ndarray) -> np.ndarray:
    """Level 1 for a count of 1, 2 for 2..3, and so on."""
    return np.frexp(counts.astype(np.float64))[1]


def _places(hashes: np.ndarray, level: int, probe: int, size: np.ndarray) -> np.ndarray:
    """Bit of a hash for a level inside its own segment (of ``size`` bits), by double hashing."""
    mixed = _mix(hashes + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    step = (mixed >> np.uint64(40)) | np.uint64(1)
    return (((mixed >> np.uint64(8)) + np.uint64(probe) * step) % size.astype(np.uint64)).astype(np.int64)


def segment_bits(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The bytes of one segment, a byte per entry."""
    bits = np.zeros(ENTRY_BITS * max(8, int(levels.sum())), bool)
    size = np.full(1, len(bits))
    for level in range(1, int(levels.max(initial=0)) + 1):
        inside = h[levels >= level]
        for probe in range(PROBES):
            bits[_places(inside, level, probe, size)] = True
    return np.packbits(bits, bitorder="little")


def build(counts: DataFrame) -> DataFrame:
    """``s, bits, word, n``: the segments of the filter, and the words with their counts.

    ``counts`` has the rows of a segment in one partition (``count``), where they are gathered as
    numbers, about ten bytes each, until a segment's size is known.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["s", "bits", "word", "n"]
        hashes, levels = [], []
        for batch in it:
            n = batch.column(3).to_numpy(zero_copy_only=False)
            hashes.append(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            levels.append(_levels(n).astype(np.uint8))
            words = batch.filter(batch.column(2).is_valid())
            if len(words):
                empty = [pa.nulls(len(words), t) for t in (pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*empty, words.column(2), words.column(3)], names=names)
        if not hashes:
            return
        h, level = np.concatenate(hashes), np.concatenate(levels)
        by = np.argsort(_segment(h), kind="stable")
        h, level = h[by], level[by]
        segment, starts = np.unique(_segment(h), return_index=True)
        for s, a, b in zip(segment, starts, np.r_[starts[1:], len(h)], strict=True):
            bits = segment_bits(h[a:b], level[a:b].astype(np.int64))
            row = [pa.array([int(s)], pa.int32()), pa.array([bits.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays([*row, pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64())], names=names)

    return written(counts.mapInArrow(batches, "s int, bits binary, word binary, n long"), "ngram-filter")


class Filter(NamedTuple):
    """Segments one after the other: first byte and bits of each, no bits where there is none."""

    starts: np.ndarray
    sizes: np.ndarray
    bits: np.ndarray

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Quantised count of each hash, 0 if it is not there. Errors are one-sided and rare."""
        out = np.zeros(len(hashes), np.int64)
        segment = _segment(hashes)
        active, level = np.flatnonzero(self.sizes[segment] > 0), 1
        while len(active):
            for probe in range(PROBES):
                own = segment[active]
                at = _places(hashes[active], level, probe, self.sizes[own])
                byte = self.bits[self.starts[own] + (at >> 3)]
                active = active[(byte >> (at & 7).astype(np.uint8) & 1).astype(bool)]
            out[active] = level
            level += 1
        return out


def as_filter(rows: list[tuple[int, bytes]]) -> Filter:
    """The filter of (segment, bytes)."""
    sizes, starts = np.zeros(1 << SEGMENT_BITS, np.int64), np.zeros(1 << SEGMENT_BITS, np.int64)
    at = 0
    for s, bits in rows:
        sizes[s], starts[s] = 8 * len(bits), at
        at += len(bits)
    return Filter(starts, sizes, np.frombuffer(b"".join(b for _, b in rows), np.uint8))


def joined_levels(probes: DataFrame, segments: DataFrame) -> DataFrame:
    """``h, level`` of distinct ``probes (h)``: each meets the segment that holds its bits."""

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        h = left.column("h").combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64)
        made = as_filter([(r["s"], r["bits"]) for r in right.to_pylist()])
        return pa.table({"h": pa.array(h.view(np.int64)), "level": pa.array(made.levels(h).astype(np.int32))})

    placed = probes.select(F.shiftrightunsigned("h", 64 - SEGMENT_BITS).cast("int").alias("s"), "h")
    return placed.groupBy("s").cogroup(segments.groupBy("s")).applyInArrow(probe, "h long, level int")


class Model(NamedTuple):
    """The filter (None if it stays a table), training totals, and exact counts of the most frequent words."""

    filter: Filter | None
    tokens: int
    distinct: int
    texts: int
    amounts: float
    frequent: dict[bytes, int]

    @property
    def scale(self) -> float:
        """Sum of all exact counts, smoothed."""
        return self.tokens + ADDED * (self.distinct + 1)

    @property
    def mass(self) -> float:
        """Sum of all quantised counts, smoothed."""
        return self.amounts + ADDED * (self.distinct + 1)

    def logs(self, t: Tokens, levels_of: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """log10 of the smoothed probability of each token after the one before it.

        ``levels_of`` hashes stands in for a filter that stays a table.

        A word's share is its quantised count of their sum. A pair counts with the least count of
        its level, its context with the greatest, so the shares after a context sum to at most 1.
        """
        levels_of = levels_of or (self.filter and self.filter.levels)
        if levels_of is None:
            return np.zeros(len(t.codes))
        levels = levels_of(t.hashes)
        single = (_amount(levels)[t.codes] + ADDED) / self.mass
        distinct, back = np.unique(t.pairs, return_inverse=True)
        least = np.exp2(levels_of(distinct) - 1.0)
        pair = np.where(least >= 1, least, 0.0)[back]
        context = np.where(t.previous < 0, float(self.texts), np.exp2(levels.astype(float))[t.previous] - 1)
        share = np.minimum(1.0, pair / np.maximum(context, 1.0))
        return np.log10(np.where(context > 0, (1 - LAMBDA) * single + LAMBDA * share, single))


def _amount(levels: np.ndarray) -> np.ndarray:
    """Middle of the counts of a level: 1 for level 1, of 2..3 for level 2, and so on."""
    high = np.exp2(levels.astype(np.float64))
    return np.where(levels > 0, (high / 2 + high - 1) / 2, 0.0)


def fit(train: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model of ``train (text)``, the exact counts of its words (``word, n``), and the segments."""
    made = build(count(train))
    words = made.where("word is not null").select("word", "n")
    segments = made.where("bits is not null").select("s", "bits")
    high = F.pow(F.lit(2.0), F.floor(F.log2("n") + 1e-9) + 1)
    total = words.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("word"), F.coalesce(F.sum((high * 1.5 - 1) / 2), F.lit(0.0))
    ).first()
    texts = words.where(F.col("word") == F.lit(END)).first()
    step = F.floor(8 * F.log2("n")).alias("step")
    room, least = FREQUENT, None
    for row in words.groupBy(step).count().orderBy(F.desc("step")).collect():
        if (room := room - row["count"]) < 0:
            break
        least = row["step"]
    frequent = words.where(step >= least).collect() if least is not None else []
    size = segments.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0))).first()[0]
    held = as_filter([tuple(r) for r in segments.collect()]) if size <= BROADCAST_BYTES else None
    counts = {bytes(r["word"]): r["n"] for r in frequent}
    return Model(held, total[0], total[1], texts["n"] if texts else 0, total[2], counts), words, segments


def in_runs(numbered: DataFrame) -> DataFrame:
    """``numbered`` plus ``run``: the first ``uid`` of the run of texts that are scored together."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            uid, text = (batch.column(batch.schema.get_field_index(c)) for c in ("uid", "text"))
            starts = np.array([start for start, _ in _runs(text)], np.int64)
            run = uid.to_numpy()[np.repeat(starts, np.diff(np.r_[starts, len(text)]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(run)], names=[*batch.schema.names, "run"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema.fields)
    return numbered.mapInArrow(batches, schema + ", run long")


def _asked(t: Tokens) -> np.ndarray:
    """Distinct hashes of a run's words and pairs, in order, so by segment."""
    return np.unique(np.concatenate([t.hashes, t.pairs]))


def joined_scores(numbered: DataFrame, model: Model, segments: DataFrame) -> DataFrame:
    """``uid, score`` with a filter that stays a table, of ``numbered (run, uid, text)`` in files.

    A piece of a run asks each segment once for all its hashes, seven bytes each as the segment
    has the first bits. Back come their levels, a byte each in the order of the hashes, to the
    texts of the run, where the hashes are worked out again.
    """

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            runs = batch.column(0).to_numpy()
            edges = np.r_[0, np.flatnonzero(np.diff(runs)) + 1, len(runs)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                h = _asked(tokenize([x.as_py() or b"" for x in part.column(2)]))
                s, first = np.unique(_segment(h), return_index=True)
                seven = h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()
                offsets = 7 * np.r_[first, len(h)].astype(np.int64)
                blobs = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(offsets), pa.py_buffer(seven)])
                same = [pa.array(np.full(len(s), v)) for v in (part.column(0)[0].as_py(), part.column(1)[0].as_py())]
                yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), *same, blobs.cast(pa.binary())], names=["s", "run", "piece", "h"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        blobs = left.column("h").to_pylist()
        sizes = [len(b) // 7 for b in blobs]
        h = np.zeros((sum(sizes), 8), np.uint8)
        h[:, :7] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 7)
        s = np.uint64(left.column("s")[0].as_py()) if len(left) else np.uint64(0)
        low = np.uint64((1 << 64 - SEGMENT_BITS) - 1)
        h = (h.view("<u8").ravel().astype(np.uint64) & low) | (s << np.uint64(64 - SEGMENT_BITS))
        levels = as_filter([(r["s"], r["bits"]) for r in right.to_pylist()]).levels(h).astype(np.uint8).tobytes()
        ends = np.cumsum([0, *sizes])
        found = [levels[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.table({"run": left.column("run"), "piece": left.column("piece"), "s": left.column("s"), "levels": pa.array(found, pa.binary())})

    def score_run(texts: pa.Table, levels: pa.Table) -> pa.Table:
        texts = texts.sort_by("uid")
        levels = levels.sort_by([("piece", "ascending"), ("s", "ascending")])
        uid, piece = texts.column("uid").to_numpy(), levels.column("piece").to_numpy()
        pieces, first = np.unique(piece, return_index=True)
        starts, ends = np.searchsorted(uid, pieces), np.r_[first[1:], len(piece)]
        out = []
        for a, b, i, j in zip(starts, np.r_[starts[1:], len(uid)], first, ends, strict=True):
            t = tokenize([x.as_py() or b"" for x in texts.column("text").slice(a, b - a)])
            asked = _asked(t)
            got = np.frombuffer(b"".join(levels.column("levels").slice(i, j - i).to_pylist()), np.uint8).astype(np.int64)
            out.append(np.add.reduceat(model.logs(t, lambda h, asked=asked, got=got: got[np.searchsorted(asked, h)]), t.starts))
        return pa.table({"uid": pa.array(uid), "score": pa.array(np.concatenate([np.empty(0), *out]))})

    model = model._replace(frequent={})
    texts = numbered.select("run", "uid", "text")
    asked = texts.mapInArrow(ask, "s int, run long, piece long, h binary")
    levels = written(asked.groupBy("s").cogroup(segments.groupBy("s")).applyInArrow(answer, "run long, piece long, s int, levels binary"), "lm-levels")
    return texts.groupBy("run").cogroup(levels.groupBy("run")).applyInArrow(score_run, "uid long, score double")


def held_out(doc_id: Column) -> Column:
    return id_remainder(doc_id, FOLDS) == 0


def score(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model is learned from the documents that are not held out; a null id counts as an
    empty text there. ``base_score`` uses exact word counts: those of the most frequent words
    come with the model, the rest of a document's words meet theirs in a join. Null and empty
    texts consist of their end; repeated rows score alike; with nothing to learn from all
    counts are 0; an empty table gives no rows; extra columns are ignored. Very long texts are
    counted and scored whole, one run each.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    model, words, segments = fit(rows.where(~F.col("held_out")).select("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "held_out", "uid", "n_tokens", "known", "base", "score", "rest"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in it:
            for start, run in _runs(batch.column(3), _CHUNK // 2):
                t = tokenize(run)
                exact = np.array([m.frequent.get(w, 0) for w in t.distinct], np.float64)
                logs = np.where(exact > 0, np.log10((exact + ADDED) / m.scale), 0.0)
                rare = exact[t.codes] == 0
                ends = np.r_[t.starts[1:], len(t.codes)]
                text = np.repeat(np.arange(len(run)), ends - t.starts)
                keys, times = np.unique((text * len(t.distinct) + t.codes)[rare], return_counts=True)
                offsets = np.searchsorted(keys, np.arange(len(run) + 1) * len(t.distinct)).astype(np.int32)
                words = pa.array(t.distinct, pa.binary()).take(pa.array(keys % len(t.distinct)))
                rest = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([words, pa.array(times)], ["word", "times"]))
                part = batch.slice(start, len(run))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:3],
                        pa.array(ends - t.starts),
                        pa.array(np.add.reduceat((~rare).astype(np.int64), t.starts)),
                        pa.array(np.add.reduceat(logs[t.codes], t.starts)),
                        pa.array(np.add.reduceat(m.logs(t), t.starts)),
                        rest,
                    ],
                    names=names,
                )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    numbered = rows.select("doc_id", "held_out", F.monotonically_increasing_id().alias("uid"), F.col("text").cast("binary"))
    if model.filter is None:
        # Numbers given by the plan may differ between runs of it; these are read back.
        numbered = written(in_runs(numbered), "lm-numbered")
    scored = written(
        numbered.select("doc_id", "held_out", "uid", "text").mapInArrow(
            batches,
            f"doc_id {id_type}, held_out boolean, uid long, n_tokens long, known long, base double, score double, "
            "rest array<struct<word:binary,times:long>>",
        ),
        "lm-scored",
    )
    if model.filter is None:
        # Written, so that the texts' shuffle is gone before the words are joined.
        scored = scored.drop("score").join(written(joined_scores(numbered, model, segments), "lm-scores"), "uid")
    rare = scored.select("uid", F.inline("rest")).join(words, "word", "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + ADDED) / F.lit(float(model.scale)))
    sums = rare.groupBy("uid").agg(
        F.sum(log * F.col("times")).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("also")
    )
    return scored.drop("rest").join(sums, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
