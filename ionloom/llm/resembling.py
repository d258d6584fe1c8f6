"""Documents that resemble each other in their five-word shingles, by Golay-code fuzzy hashing.

Texts at Jaccard similarity 0.8 differ in about 15% of their SimHash bits, too many for the few
errors that keys on a 64-bit fingerprint bear. So the fingerprint has 320 bits here, of which 12
segments of 23 are decoded to nearby codewords. Two segments at that error rate share a codeword
with probability 0.61, unrelated ones with 0.007; a key joins the codewords of two segments. Of
six such pairs of segments one agrees with probability 0.94 at similarity 0.8, 0.99 at 0.87.
Candidates are verified on all 320 bits, which tell the similarity to about 0.03.

All pairs of different texts that share a key are compared on all 320 bits, in numpy inside the
task that holds their bucket, and a task returns no pairs but which groups they join: at most one
row per document and bucket. In a bucket a row is compared with rows of other groups only, and once
it is compared with all of them it is done, so a group of any size costs a few passes over it, and
only texts that share a key and don't resemble cost a comparison per pair. Buckets are dealt by the
codeword of the first segment of a key. Of more than MOST_ROWS rows they are cut into parts, and
rows outside the group that most of a bucket belongs to meet the other parts too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.llm.common import in_files, minus, with_locator, written
from ionloom.llm.components import components
from ionloom.llm.golay import codewords, decoding

WORDS, SEED = 5, 42
#: 64-bit lanes of a fingerprint, pairs of segments that make keys, bits of a segment.
LANES, TABLES, SEGMENT = 5, 6, 23
#: Bits that may differ in a link.
MOST_BITS = 56
#: Rows that share a key are compared in steps over all keys at once up to this number, else key by key.
PAIRED = 64
#: Rows of a part of a bucket, about, and comparisons made at once.
MOST_ROWS, _AT_ONCE = 1 << 16, 1 << 20
_BLOCK = 1 << 13
_LANE = [f"lane{i}" for i in range(LANES)]


def signature(text: bytes) -> np.ndarray:
    """LANES words of SimHash over the distinct shingles; zero without words."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(LANES, np.int64)
    shingles = [b" ".join(words)] if len(words) < WORDS else map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False))
    hashes = np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64))
    ones = np.zeros(64 * LANES, np.int64)
    for start in range(0, len(hashes), _BLOCK):
        z = hashes[start : start + _BLOCK, None] + np.arange(LANES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """``uid, doc_id, _ion_file, _ion_row`` and the lanes of each document; null text is empty."""
    rows = with_locator(docs.select("doc_id", "text")).select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", "_ion_file", "_ion_row", F.col("text").cast("binary")
    )

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            lanes = np.array([signature(text.as_py() or b"") for text in batch.column(4)], np.int64).reshape(-1, LANES)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], *[pa.array(lane) for lane in lanes.T.copy()]], names=["uid", "doc_id", "_ion_file", "_ion_row", *_LANE]
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(batches, f"uid long, doc_id {id_type}, _ion_file string, _ion_row long, " + ", ".join(f"{n} long" for n in _LANE))


def _near(lanes: np.ndarray, number: int, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codewords near a segment of fingerprints (row x lane), six per row, and which are no repeats."""
    lane, shift = divmod(number * SEGMENT, 64)
    bits = lanes[:, lane].view(np.uint64) >> np.uint64(shift)
    if shift + SEGMENT > 64:
        bits = bits | lanes[:, lane + 1].view(np.uint64) << np.uint64(64 - shift)
    words = codewords((bits & np.uint64((1 << SEGMENT) - 1)).astype(np.int64), tables)
    used = np.ones(words.shape, bool)
    used[:, 1:] = words[:, 1:] != words[:, :1]
    return words, used


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after nodes ``a`` and ``b`` are linked: the least node of each group."""
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        a, b, parent = a[apart], b[apart], np.arange(len(label))
        np.minimum.at(parent, high[apart], low[apart])
        while (further := parent[parent]).tobytes() != parent.tobytes():
            parent = further
        label = parent[label]
    return label


def _close(columns: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows differ in MOST_BITS or fewer; a lane is read while that is open."""
    left, bits = np.arange(len(a)), np.zeros(len(a), np.int64)
    for lane in columns:
        bits = bits + np.bitwise_count(lane[a[left]] ^ lane[b[left]])
        few = bits <= MOST_BITS
        left, bits = left[few], bits[few]
    return left


def bucket_links(bucket: np.ndarray, part: np.ndarray, root: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``u, v``: groups (their roots) that are joined by rows with a common key at most MOST_BITS apart.

    The rows are those of whole parts of buckets, sorted by both. ``u`` is the least root joined.
    """
    nodes, node = np.unique(root, return_inverse=True)
    label = np.arange(len(nodes))
    place = np.cumsum(np.r_[False, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])])
    table_of, tables, keys, rows = bucket >> 12, decoding(), [], []
    for table in range(TABLES):
        here = np.flatnonzero(table_of == table)
        words, used = _near(lanes[here], 2 * table + 1, tables)
        at, which = np.nonzero(used)
        keys.append(place[here[at]] << 12 | words[at, which])
        rows.append(here[at])
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    columns = [np.ascontiguousarray(lane).view(np.uint64) for lane in lanes.T]

    end, few = np.repeat(start + size, size), np.repeat((size > 1) & (size <= PAIRED), size)
    at = np.flatnonzero(few)
    for step in range(1, PAIRED):
        at = at[at + step < end[at]]
        for begin in range(0, len(at), _AT_ONCE):
            now = at[begin : begin + _AT_ONCE]
            a, b = row[now], row[now + step]
            other = label[node[a]] != label[node[b]]
            a, b = a[other], b[other]
            hit = _close(columns, a, b)
            label = _joined(label, node[a[hit]], node[b[hit]])

    for run in np.flatnonzero(size > PAIRED):
        members = row[start[run] : start[run] + size[run]]
        open_, pivots = np.ones(len(members), bool), np.zeros(1, np.int64)
        while len(pivots) and (label[node[members]] != label[node[members[0]]]).any():
            open_[pivots] = False
            mine = label[node[members]]
            a, b = np.nonzero(mine[pivots][:, None] != mine[None, :])
            a, b = members[pivots[a]], members[b]
            hit = _close(columns, a, b)
            label = _joined(label, node[a[hit]], node[b[hit]])
            mine = label[node[members]]
            values, count = np.unique(mine, return_counts=True)
            pivots = np.flatnonzero(open_ & (mine != values[count.argmax()]))[: max(1, min(PAIRED, _AT_ONCE // len(members)))]

    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[moved]], nodes[moved]


def keyed(marks: DataFrame) -> DataFrame:
    """``bucket, uid, lanes`` of ``marks (uid, lanes)``: the table and a codeword near its first segment, 6 to 36 per row."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = decoding()
        for batch in it:
            for first in range(0, len(batch), _BLOCK):
                part = batch.slice(first, _BLOCK)
                lanes = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns[1:]])
                for table in range(TABLES):
                    words, used = _near(lanes, 2 * table, tables)
                    at, which = np.nonzero(used)
                    bucket = pa.array((table << 12 | words[at, which]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([bucket, *part.take(pa.array(at)).columns], names=["bucket", "uid", *_LANE])

    return marks.select("uid", *_LANE).mapInArrow(batches, "bucket int, uid long, " + ", ".join(f"{n} long" for n in _LANE))


def links(rows: DataFrame) -> DataFrame:
    """``u, v``: groups joined within a part of a bucket, of ``rows (bucket, part, root, lanes)``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def joined(columns: list[np.ndarray]) -> pa.RecordBatch:
            u, v = bucket_links(*columns[:3], np.column_stack(columns[3:]))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        held: list[list[np.ndarray]] = []
        n = 0
        for batch in it:
            if not len(batch):
                continue
            held.append([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            n += len(batch)
            if n >= MOST_ROWS:  # the last part of a bucket may go on in the next batch
                now = [np.concatenate(c) for c in zip(*held, strict=True)]
                goes_on = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
                last = int(goes_on[-1]) + 1 if len(goes_on) else 0
                if last:
                    yield joined([c[:last] for c in now])
                held, n = [[c[last:] for c in now]], len(now[0]) - last
        if n:
            yield joined([np.concatenate(c) for c in zip(*held, strict=True)])

    ordered = rows.select("bucket", "part", "root", *_LANE).repartition("bucket", "part").sortWithinPartitions("bucket", "part")
    return ordered.mapInArrow(batches, "u long, v long").distinct()


def _parts(n: str, most_rows: int) -> Column:
    return F.ceil(F.col(n) / F.lit(most_rows)).cast("int")


def _dealt(parts: str) -> Column:
    return F.pmod(F.xxhash64("uid"), F.col(parts)).cast("int")


def between_parts(rows: DataFrame, rooted: DataFrame, most_rows: int) -> DataFrame:
    """``u, v`` joined by rows of different parts of the cut buckets ``rows (bucket, parts, uid, lanes)``.

    Of two rows of different groups one is outside the group most of the bucket belongs to. These
    rest rows are cut into parts as well, and each part of them meets each part of the bucket.
    """
    rows = written(rows.join(rooted.select("uid", "root"), "uid"), "resembling-cut")
    members = rows.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"))
    main = members.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("rest"))
    met = rows.join(F.broadcast(main.where("rest > 0")), "bucket").withColumn("rests", _parts("rest", most_rows))
    both = [
        met.select("*", _dealt("parts").alias("one"), F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("two")),
        met.where("root <> main").select(
            "*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("one"), _dealt("rests").alias("two")
        ),
    ]
    return links(both[0].unionByName(both[1]).withColumn("part", F.col("one") * F.col("rests") + F.col("two")))


def roots(marks: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """``marks (uid, ...)`` with ``root``, the smallest uid of the group."""

    def rooted(edges: DataFrame) -> DataFrame:
        found = components(edges).select(F.col("u").alias("uid"), "root")
        return marks.join(found, "uid", "left").withColumn("root", F.coalesce("root", "uid"))

    one = written(marks.groupBy(*_LANE).agg(F.min("uid").alias("uid")), "resembling-distinct")
    same = marks.join(one.withColumnRenamed("uid", "u"), _LANE).where("uid <> u").select("u", F.col("uid").alias("v"))
    rows = keyed(one)
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_rows)
    large = written(sizes.select("bucket", _parts("n", most_rows).alias("parts")), "resembling-large")
    cut = rows.join(F.broadcast(large), "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    edges = written(links(cut.withColumn("part", _dealt("parts")).withColumnRenamed("uid", "root")).unionByName(same), "resembling-links")
    if large.isEmpty():
        return rooted(edges)
    inner = written(rooted(edges), "resembling-gathered")
    inside = inner.where("uid <> root").select(F.col("root").alias("u"), F.col("uid").alias("v"))
    return rooted(between_parts(cut.where("parts > 1"), inner, most_rows).unionByName(inside))


def grouped(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, component_id``, its locator and its ``holder``.

    ``component_id`` is the smallest doc_id reachable over links, ``holder`` that row. Texts without
    words are alike; null ids count as largest; rows that repeat an id are separate documents; very
    long texts are read whole; an empty table gives no rows; extra columns are ignored.
    """
    marks = written(signatures(in_files(docs)), "resembling-marks")
    rooted = written(roots(marks).drop(*_LANE), "resembling-roots")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "_ion_file", "_ion_row")
    holders = written(rooted.groupBy("root").agg(F.min(first).alias("holder")), "resembling-holders")  # so that the join can be split
    return rooted.join(holders, "root").select("doc_id", F.col("holder.id").alias("component_id"), "_ion_file", "_ion_row", "holder")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group stays, the one with the smallest id, with all columns. Awkward rows as in ``grouped``."""
    docs = in_files(docs)
    stays = (F.col("_ion_file") == F.col("holder._ion_file")) & (F.col("_ion_row") == F.col("holder._ion_row"))
    dropped = written(grouped(docs).where(~stays).select("_ion_file", "_ion_row"), "resembling-dropped")
    return minus(with_locator(docs), dropped, ["_ion_file", "_ion_row"]).drop("_ion_file", "_ion_row")
