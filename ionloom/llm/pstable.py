"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector by a few Gaussian (2-stable) projections, cut into cells of equal
width. A query visits its own bucket and then perturbed ones, in the order of how likely they
hold its neighbours: by the sum of squared distances to the cell walls that a perturbation
crosses, until one of its nearest would be met with a set probability. How far those are is
measured on a sample of queries. The candidates of all tables are merged and ranked by their
exact cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.llm.common import written

#: Tables, and cell width for vectors of length 1.
TABLES, CELL = 12, 2.5
#: A neighbour as far as all but FAR of the nearest of SAMPLE queries is met with probability HIT.
HIT, FAR, SAMPLE = 0.97, 0.05, 128
#: A table has log2(vectors) - OFFSET projections, so buckets keep their size as vectors grow.
OFFSET = 4
#: Neighbours per query.
NEAREST = 5
#: Buckets of a table are dealt to so many groups, larger groups are split at so many vectors.
GROUPS, GROUP_ROWS = 16, 8192
_REACH = 3  # cells that a perturbation moves at most


def projections(dimension: int, functions: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([dimension, functions, table])
    return rng.normal(size=(dimension, functions)), rng.uniform(0, CELL, functions)


def bucket(cells: np.ndarray) -> np.ndarray:
    """One number for each row of cell indices."""
    h = np.full(len(cells), 0x9E3779B97F4A7C15, np.uint64)
    for column in cells.T.astype(np.int64).view(np.uint64):
        h = (h ^ (h >> np.uint64(31)) ^ column) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def probes(place: np.ndarray, most: int) -> np.ndarray:
    """Cells to visit for a query at ``place`` (in cells), likeliest first, its own cell first."""
    own = np.floor(place)
    steps = np.array([0, *(sign * k for k in range(1, _REACH + 1) for sign in (-1, 1))])
    inside = (place - own)[:, None]
    gaps = np.where(steps < 0, inside - steps - 1, np.where(steps > 0, steps - inside, 0.0)) ** 2
    cost, moves = np.zeros(1), np.zeros((1, 0), np.int64)
    for gap in gaps:  # the cheapest cells begin with the cheapest beginnings
        every = (cost[:, None] + gap).ravel()
        least = np.argsort(every, kind="stable")[:most]
        cost, moves = every[least], np.column_stack([moves[least // len(steps)], steps[least % len(steps)]])
    return own + moves


_GRID = np.linspace(-9, 9, 1 << 14)
_NORMAL = np.array([math.erfc(-x / math.sqrt(2)) / 2 for x in _GRID])


def enough(place: np.ndarray, distance: float, share: float) -> np.ndarray:
    """The first of ``probes`` that hold a vector at ``distance`` with probability ``share`` in all."""
    spread = distance / CELL
    most = 32
    while True:
        cells = probes(place, most)
        gap = (cells - place) / spread
        met = np.cumsum(np.prod(np.interp(gap + 1 / spread, _GRID, _NORMAL) - np.interp(gap, _GRID, _NORMAL), axis=1))
        if met[-1] >= share or len(cells) < most:
            return cells[: int(np.searchsorted(met, share)) + 1]
        most *= 4


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64) if len(column) else np.zeros((0, 1))


def _direction(vectors: np.ndarray) -> np.ndarray:
    """Vectors divided by their largest component: equal for all multiples of a float vector."""
    vectors = vectors.astype(np.float64)
    return vectors / np.abs(vectors).max(axis=1, keepdims=True)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = _direction(vectors)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` of the vectors that take part, ``v`` as doubles.

    Null ids, and vectors that are null, zero, or hold null or non-finite components, take no
    part; neither do vectors whose dimension is not the most frequent one. Of rows that repeat
    an id the one with the smallest vector stays.
    """
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    rows = written(rows.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(v).alias("v")), "ann-vectors")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (common["d"] if common else 0))


def _far(classes: DataFrame, asked: DataFrame, nearest: int) -> float:
    """The distance within which all but ``FAR`` of the nearest of some queries are, by brute force."""
    some = asked.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).collect()
    if not some:
        return 0.0
    own, unit = np.array([r["cid"] for r in some]), _unit(np.array([r["v"] for r in some], np.float64))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(own), nearest), -np.inf)
        for batch in it:
            if len(batch):
                score = unit @ _unit(_matrix(batch.column(1))).T
                score[own[:, None] == batch.column(0).to_numpy()] = -np.inf
                best = np.sort(np.hstack([best, score]), axis=1)[:, -nearest:]
        at, rank = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(best[at, rank])], names=["cid", "score"])

    first = Window.partitionBy("cid").orderBy(F.desc("score"))
    found = classes.select("cid", "v").mapInArrow(batches, "cid long, score double")
    scores = [r["score"] for r in found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= nearest).collect()]
    return math.sqrt(max(0.0, 2 - 2 * float(np.quantile(scores, FAR)))) if scores else 0.0


def _hashed(classes: DataFrame, dimension: int, functions: int, kind: str) -> DataFrame:
    """``tbl, grp, bucket, cid, v`` for every class and table; ``v`` is the vector as bytes of ``kind``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            given = _matrix(batch.column(1))
            unit = _unit(given)
            data = pa.array([row.tobytes() for row in given.astype(kind)], pa.binary())
            for table in range(TABLES):
                a, shift = projections(dimension, functions, table)
                b = bucket(np.floor((unit @ a + shift) / CELL))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(b), table, np.int32)), pa.array((b % GROUPS).astype(np.int32)), pa.array(b), batch.column(0), data],
                    names=["tbl", "grp", "bucket", "cid", "v"],
                )

    return classes.mapInArrow(batches, "tbl int, grp int, bucket long, cid long, v binary")


def _probed(classes: DataFrame, dimension: int, functions: int, kind: str, distance: float) -> DataFrame:
    """``tbl, grp, buckets, cid, v``: what each query class visits, a row per table and group.

    A neighbour at ``distance`` is met in some table with probability ``HIT``.
    """
    share = 1 - (1 - HIT) ** (1 / TABLES)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            given = _matrix(batch.column(1))
            unit = _unit(given)
            for table in range(TABLES):
                a, shift = projections(dimension, functions, table)
                rows = []
                for cid, vector, place in zip(batch.column(0).to_pylist(), given, (unit @ a + shift) / CELL, strict=True):
                    b = np.unique(bucket(enough(place, distance, share)))
                    data = vector.astype(kind).tobytes()
                    rows += [(g, b[b % GROUPS == g].tobytes(), cid, data) for g in np.unique(b % GROUPS).tolist()]
                grp, buckets, cids, data = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows), table, np.int32)),
                        pa.array(grp, pa.int32()),
                        pa.array(buckets, pa.binary()),
                        pa.array(cids, pa.int64()),
                        pa.array(data, pa.binary()),
                    ],
                    names=["tbl", "grp", "buckets", "cid", "v"],
                )

    return classes.mapInArrow(batches, "tbl int, grp int, buckets binary, cid long, v binary")


def _rank_group(index: pd.DataFrame, queries: pd.DataFrame, kind: str, most: int) -> pd.DataFrame:
    """The ``most`` nearest candidates of each query within one group of buckets, by cosine in
    double precision, ties to the smaller class. Rough scores only leave out what their
    rounding cannot lift among them."""
    out: dict[str, list] = {"cid": [], "near": [], "score": []}
    if len(index) and len(queries):
        index = index.sort_values(["bucket", "cid"])
        keys, ids = index["bucket"].to_numpy(), index["cid"].to_numpy()
        vectors = _direction(np.frombuffer(b"".join(index["v"]), kind).reshape(len(index), -1))
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        rough = (vectors / norms[:, None]).astype(np.float32)
        slack = 2 * (rough.shape[1] + 4) * 2.0**-24
        for cid, visited, data in zip(queries["cid"], queries["buckets"], queries["v"], strict=True):
            visited = np.frombuffer(visited, np.int64)
            lo, hi = np.searchsorted(keys, visited, "left"), np.searchsorted(keys, visited, "right")
            sizes = hi - lo
            if not sizes.any():
                continue
            at = np.repeat(lo - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            asked = _direction(np.frombuffer(data, kind)[None])[0]
            norm = math.sqrt((asked * asked).sum())
            if len(at) > most:
                score = rough[at] @ (asked / norm).astype(np.float32)
                at = at[score >= np.partition(score, -most)[-most] - slack]
            score = (vectors[at] * asked).sum(axis=1) / (norms[at] * norm)
            best = np.lexsort((ids[at], -score))[:most]
            out["cid"] += [cid] * len(best)
            out["near"] += ids[at[best]].tolist()
            out["score"] += score[best].tolist()
    return pd.DataFrame(out)


def search(vectors: DataFrame, is_query: Column, nearest: int = NEAREST) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest vectors found for each query row.

    ``is_query`` is a condition on ``vec_id``. Candidates are all other rows, nearest first by
    cosine, ties to the smaller id; fewer rows if there are fewer candidates. Vectors of equal
    direction form one class in the index, so however many share one they are hashed once; each
    class offers its few smallest ids, which is all a query can use. Rows that take no part
    (see ``usable``) give no query either; an empty table gives no rows; extra columns are
    ignored.
    """
    kind = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    rows = usable(vectors)
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    rows = rows.withColumn("u", F.transform("v", lambda x: x / largest + 0.0))
    classes = written(rows.groupBy("u").agg(F.min("vec_id").alias("cid"), F.min("v").alias("v")), "ann-classes")
    named = rows.join(classes.select("u", "cid"), "u").select("vec_id", "cid")
    named = written(named, "ann-members")
    order = Window.partitionBy("cid").orderBy("vec_id")
    members = named.withColumn("n", F.row_number().over(order)).where(F.col("n") <= nearest + 1).select("cid", "vec_id")
    queries = named.where(is_query).select(F.col("vec_id").alias("query_id"), "cid")

    total = classes.count()
    first = classes.select("v").first()
    dimension = len(first["v"]) if first else 1
    functions = max(1, round(math.log2(max(total, 1))) - OFFSET)
    asked = classes.join(queries.select("cid").distinct(), "cid", "left_semi").select("cid", "v")

    index = written(_hashed(classes.select("cid", "v"), dimension, functions, kind), "ann-index")
    loads = index.groupBy("tbl", "grp").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part")
    left = index.join(loads, ["tbl", "grp"]).select("tbl", "grp", part, "bucket", "cid", "v")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    probed = _probed(asked, dimension, functions, kind, _far(classes, asked, nearest))
    right = probed.join(loads, ["tbl", "grp"]).select("tbl", "grp", every, "buckets", "cid", "v")
    keys = ["tbl", "grp", "part"]
    most = nearest + 1  # one of the classes may be the query's own

    def rank(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        return _rank_group(index, queries, kind, most)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(rank, "cid long, near long, score double")

    merged = found.groupBy("cid", "near").agg(F.max("score").alias("score"))
    best = Window.partitionBy("cid").orderBy(F.desc("score"), "near")
    scored = written(
        merged.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most).select("cid", "near", "score"), "ann-scored"
    )

    answers = queries.join(scored, "cid").join(members.withColumnRenamed("cid", "near"), "near").where("vec_id <> query_id")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        answers.withColumn("rank", F.row_number().over(ranked).cast("int"))
        .where(F.col("rank") <= nearest)
        .select("query_id", "rank", "vec_id", "score")
    )
