"""Error-weighted non-negative factorisation of the sparse matrix.

Samples x bins, but only present cells are stored. All absent cells have value 0 and one weight,
so what they add to a denominator is that weight times a small Gram matrix (factors x factors)
less the part of the present cells. Cells are packed once, in blocks of whole samples: a sample has
at most one cell per bin, so no group is unbounded.

An iteration is one pass. Each block brings its rows of G up to date with the current H and adds
up its share of Q and of the next update of H; nothing else moves. H has as many rows as the axis
has bins and is held by the driver, G stays with the blocks: its rows follow from those stored in
the block and the few H since then, and are stored anew every ``RESTORE`` passes. A lost
executor only repeats its blocks. Several factor numbers share each pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions.quantiles import exact_quantiles
from ionloom.session import cut_lineage, forget, stored

REL_ERR, FLOOR_FRAC, MISSING_MULT = 0.15, 0.10, 3.0
EPS = 1e-10
#: Cells of a packed block; passes after which G is stored anew.
BLOCK_CELLS, RESTORE = 1 << 18, 10
#: Partial sums of up to so many bytes are added by the driver, larger ones by a shuffle.
DIRECT_BYTES = 64 << 20


@dataclass(frozen=True)
class Sparse:
    """Present cells ``(sample_item_id, bin, x, sigma)``, all samples, all bins, and the error of absent cells."""

    rows: DataFrame
    samples: DataFrame
    bins: DataFrame
    absent: float


def sparse_input(cells: DataFrame, min_presence: float = 0.0, reagent: DataFrame | None = None) -> Sparse:
    """Cells of the bins that enough samples have, with their errors.

    ``reagent (sample_item_id, reagent)`` divides each sample's heights; samples whose reagent is
    null or zero then have no cell present. Negative heights count as 0.
    """
    samples = cut_lineage(cells.select("sample_item_id").distinct())
    n = max(samples.count(), 1)
    bins = cut_lineage(cells.groupBy("bin").agg((F.count("height") / F.lit(n)).alias("share")).where(F.col("share") >= min_presence).select("bin"))
    kept = cells.where("height IS NOT NULL").join(bins, "bin", "left_semi").select("sample_item_id", "bin", "height")
    if reagent is not None:
        kept = kept.join(reagent.where("reagent <> 0"), "sample_item_id").withColumn("height", F.col("height") / F.col("reagent"))
    rows = cut_lineage(kept.select("sample_item_id", "bin", F.greatest("height", F.lit(0.0)).alias("x")))
    med = exact_quantiles(rows.where("x > 0"), [], "x", {"med": 0.5}).first()
    floor = FLOOR_FRAC * (med["med"] if med and med["med"] is not None else 1.0)
    top = rows.agg(F.max("x")).first()[0] or 0.0
    sigma = F.sqrt(F.pow(F.col("x") * REL_ERR, 2) + F.pow(F.lit(floor), 2))
    return Sparse(rows.withColumn("sigma", sigma), samples, bins, MISSING_MULT * float(np.hypot(REL_ERR * top, floor)))


def build_input(cells: DataFrame, min_presence: float = 0.0, reagent: DataFrame | None = None) -> DataFrame:
    """``(sample_item_id, bin, x, sigma)`` with a row for absent cells too: samples x kept bins.

    The full grid is what this operator is asked for; the factorisation does without it. Samples
    make the bin numbers themselves, so nothing is gathered.
    """
    given = sparse_input(cells, min_presence, reagent)
    numbered = cut_lineage(given.bins.select("bin", F.row_number().over(Window.orderBy("bin")).alias("_i")))
    grid = (
        given.samples.select("sample_item_id", F.explode(F.sequence(F.lit(1), F.lit(max(numbered.count(), 1)))).alias("_i"))
        .join(numbered, "_i").select("sample_item_id", "bin")
    )
    full = grid.join(given.rows, ["sample_item_id", "bin"], "left")
    return full.select("sample_item_id", "bin", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("sigma", F.lit(given.absent)).alias("sigma"))


@dataclass(frozen=True)
class Packed:
    """Blocks of whole samples, the bins in order, the sizes, and the weight of absent cells."""

    blocks: DataFrame
    bins: np.ndarray
    n_samples: int
    mean: float
    absent_weight: float
    n_blocks: int


_BLOCK = "samples array<string>, keys binary, row binary, col binary, x binary, w binary, g array<binary>"
_FIELDS = ["samples", "keys", "row", "col", "x", "w", "g"]


def pack(given: Sparse) -> Packed:
    """The cells as blocks: samples are shuffled once, ordered, and cut between samples."""
    spark = given.rows.sparkSession
    bins = np.array(sorted(r["bin"] for r in given.bins.select("bin").distinct().collect()), np.int64)
    marks = given.samples.select(F.col("sample_item_id").cast("string").alias("s"), *[F.lit(None).cast(t).alias(c) for c, t in (("bin", "long"), ("x", "double"), ("sigma", "double"))])
    cells = given.rows.select(F.col("sample_item_id").cast("string").alias("s"), F.col("bin").cast("long").alias("bin"), "x", "sigma")
    every = marks.unionByName(cells).withColumn("key", F.xxhash64("s"))
    ordered = every.repartition("key").sortWithinPartitions("key", "s", "bin")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def block(table: pa.Table) -> pa.RecordBatch:
            frame = table.to_pandas()
            first = frame["s"].ne(frame["s"].shift()).to_numpy()
            row = np.cumsum(first) - 1
            present = frame["bin"].notna().to_numpy()
            at = np.searchsorted(bins, frame["bin"].to_numpy(float)[present].astype(np.int64))
            sigma = np.maximum(frame["sigma"].to_numpy(float)[present], EPS)
            values = (
                frame["key"].to_numpy(np.int64)[first], row[present].astype(np.int32), at.astype(np.int32),
                frame["x"].to_numpy(float)[present], 1.0 / sigma**2,
            )
            columns = [pa.array([frame["s"].to_numpy(object)[first].tolist()], pa.list_(pa.string()))]
            columns += [pa.array([v.tobytes()]) for v in values]
            return pa.RecordBatch.from_arrays([*columns, pa.array([None], pa.list_(pa.binary()))], _FIELDS)

        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < BLOCK_CELLS:
                continue
            table = pa.Table.from_batches(held)
            last = table.column("s")[-1]
            whole = len(table) - pc.sum(pc.equal(table.column("s"), last)).as_py()
            if whole:
                yield block(table.slice(0, whole))
            held = table.slice(whole).to_batches()
            size = len(table) - whole
        if size:
            yield block(pa.Table.from_batches(held))

    blocks, _ = stored(ordered.mapInArrow(cut, _BLOCK), "cell-blocks")
    total = given.rows.agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x")).first()
    n = given.samples.distinct().count()
    room = n * len(bins)
    full = total["n"] >= room
    mean = (total["x"] or 0.0) / room if room else 0.0
    return Packed(blocks, bins, n, mean, 0.0 if full else 1.0 / max(given.absent, EPS) ** 2, blocks.count())


def start(keys: np.ndarray, k: int, scale: float, seed: int) -> np.ndarray:
    """Positive start values (key x factor) that depend on the key and the factor only."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = z + np.uint64(seed) * np.uint64(0xD1B54A32D192ED03)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return scale * ((z >> np.uint64(11)).astype(float) / float(1 << 53) + 0.05)


@dataclass(frozen=True)
class Totals:
    """Numerators and denominators (present cells) of H's update, G'G, and Q of the present cells
    less what they would add if absent."""

    top: np.ndarray
    low: np.ndarray
    gram: np.ndarray
    q: float

    def flat(self) -> np.ndarray:
        return np.concatenate([self.top.ravel(), self.low.ravel(), self.gram.ravel(), [self.q]])

    @staticmethod
    def of(flat: np.ndarray, m: int, k: int) -> Totals:
        top, low, gram, q = np.split(flat, np.cumsum([m * k, m * k, k * k]))
        return Totals(top.reshape(m, k), low.reshape(m, k), gram.reshape(k, k), float(q[0]))


@dataclass
class Model:
    """One factorisation under way: H (bin x factor), the H that stored rows of G have not met yet."""

    k: int
    scale: float
    seed: int
    h: np.ndarray
    pending: list[np.ndarray] = field(default_factory=list)
    history: list[float] = field(default_factory=list)
    done: bool = False

    def update(self, totals: Totals, w0: float) -> None:
        """The next H; G follows when a block is next asked for it."""
        self.h = self.h * totals.top / (np.maximum(totals.low + w0 * (self.h @ totals.gram), 0.0) + EPS)
        self.pending.append(self.h)

    def q(self, totals: Totals, w0: float) -> float:
        return totals.q + w0 * float((totals.gram * (self.h.T @ self.h)).sum())


class _Block:
    """A packed block inside a task."""

    def __init__(self, row: dict[str, object]):
        self.samples = row["samples"]
        self.keys = np.frombuffer(row["keys"], np.int64)
        self.row, self.col = np.frombuffer(row["row"], np.int32), np.frombuffer(row["col"], np.int32)
        self.x, self.w = np.frombuffer(row["x"]), np.frombuffer(row["w"])
        self.stored = row["g"]
        self.known: dict[int, tuple[int, np.ndarray]] = {}

    def summed(self, index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        return np.column_stack([np.bincount(index, v, size) for v in values.T])

    def g(self, number: int, model: Model, w0: float) -> np.ndarray:
        """The rows of G after all updates so far."""
        k = model.k
        if number in self.known:
            met, g = self.known[number]
        elif self.stored is None:
            met, g = 0, start(self.keys, k, model.scale, model.seed)
        else:
            met, g = 0, np.frombuffer(self.stored[number]).reshape(-1, k)
        for h in model.pending[met:]:
            other = h[self.col]
            fit = (g[self.row] * other).sum(1)
            top = self.summed(self.row, (self.w * self.x)[:, None] * other, len(g))
            low = self.summed(self.row, ((self.w - w0) * fit)[:, None] * other, len(g)) + w0 * (g @ (h.T @ h))
            g = g * top / (np.maximum(low, 0.0) + EPS)
        self.known[number] = (len(model.pending), g)
        return g

    def totals(self, number: int, model: Model, w0: float) -> Totals:
        """This block's share of Q and of H's update."""
        g, m = self.g(number, model, w0), len(model.h)
        mine, other = g[self.row], model.h[self.col]
        fit = (mine * other).sum(1)
        top = self.summed(self.col, (self.w * self.x)[:, None] * mine, m)
        low = self.summed(self.col, ((self.w - w0) * fit)[:, None] * mine, m)
        return Totals(top, low, g.T @ g, (self.w * (self.x - fit) ** 2).sum() - w0 * (fit * fit).sum())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        for row in batch.to_pylist():
            yield _Block(row)


def _added(packed: Packed, width: int, share: Callable[[_Block], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of vectors of ``width`` numbers."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in _blocks(batches):
            more = share(block)
            total = more if total is None else total + more
        if total is not None:
            for piece, begin in enumerate(range(0, width, 1 << 16)):
                part = total[begin : begin + (1 << 16)].tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([part])], ["piece", "part"])

    def merge(table: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(p.as_buffer()) for p in table.column("part"))
        return pa.table({"piece": table.column("piece").combine_chunks()[:1], "part": pa.array([whole.tobytes()])})

    schema = "piece int, part binary"
    parts = packed.blocks.mapInArrow(partial, schema)
    if packed.blocks.rdd.getNumPartitions() * width * 8 > DIRECT_BYTES:
        parts = parts.groupBy("piece").applyInArrow(merge, schema)
    out = np.zeros(width)
    for r in sorted(parts.collect(), key=lambda r: (r["piece"], bytes(r["part"]))):
        begin = r["piece"] << 16
        out[begin : begin + (1 << 16)] += np.frombuffer(bytes(r["part"]))
    return out


def _pass(packed: Packed, models: list[Model]) -> list[Totals]:
    """Totals of the models under way, summed over all blocks."""
    m, w0 = len(packed.bins), packed.absent_weight
    live = [(i, model) for i, model in enumerate(models) if not model.done]

    def share(block: _Block) -> np.ndarray:
        return np.concatenate([block.totals(i, model, w0).flat() for i, model in live])

    sizes = [2 * m * model.k + model.k**2 + 1 for _, model in live]
    total = _added(packed, sum(sizes), share)
    return [Totals.of(t, m, model.k) for t, (_, model) in zip(np.split(total, np.cumsum(sizes)[:-1]), live, strict=True)]


def _iterate(packed: Packed, models: list[Model], totals: list[Totals], steps: int) -> list[Totals]:
    """``steps`` iterations of the models under way.

    Blocks have to agree on H after each. If there is only one block, of BLOCK_CELLS at most, it
    agrees with itself: its totals are those of the matrix, so it takes all steps in one pass.
    """
    w0 = packed.absent_weight
    live = [model for model in models if not model.done]
    for model, t in zip(live, totals, strict=True):
        model.update(t, w0)
    if packed.n_blocks > 1:
        totals = _pass(packed, models)
        return totals if steps == 1 else _iterate(packed, models, totals, steps - 1)
    m, numbers = len(packed.bins), [i for i, model in enumerate(models) if not model.done]
    sizes = [steps * m * model.k + 2 * m * model.k + model.k**2 + 1 for model in live]

    def share(block: _Block) -> np.ndarray:
        out = []
        for number in numbers:
            model, already = models[number], len(models[number].pending) - 1
            for _ in range(steps - 1):
                model.update(block.totals(number, model, w0), w0)
            out += [np.concatenate(model.pending[already:]).ravel(), block.totals(number, model, w0).flat()]
        return np.concatenate(out)

    total, after = _added(packed, sum(sizes), share), []
    for model, part in zip(live, np.split(total, np.cumsum(sizes)[:-1]), strict=True):
        hs = part[: steps * m * model.k].reshape(steps, m, model.k)
        model.pending = [*model.pending[:-1], *hs]
        model.h = hs[-1]
        after.append(Totals.of(part[steps * m * model.k :], m, model.k))
    return after


def _restored(packed: Packed, models: list[Model]) -> tuple[DataFrame, str]:
    """The blocks with their rows of G as they are now."""
    w0 = packed.absent_weight

    def renew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row)
                g = [block.g(i, model, w0).tobytes() for i, model in enumerate(models)]
                columns = [batch.schema.field(f).type for f in _FIELDS[:-1]]
                arrays = [pa.array([row[f]], t) for f, t in zip(_FIELDS[:-1], columns, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([g], pa.list_(pa.binary()))], _FIELDS)

    return stored(packed.blocks.mapInArrow(renew, _BLOCK), "cell-blocks")


@dataclass(frozen=True)
class Factors:
    """``g (sample_item_id, f, v)``, ``h (bin, f, v)``, Q at its checks, the last being the result's."""

    k: int
    g: DataFrame
    h: DataFrame
    history: list[float]


def factorise(
    given: Sparse | Packed, ks: list[int], n_iter: int = 500, seed: int = 0, tol: float = 1e-6, check_every: int = 20
) -> list[Factors]:
    """A factorisation for each number of factors, all in the same passes.

    Every iteration updates H, then G. Q is compared every ``check_every`` iterations; a model is
    finished when it changes by less than ``tol`` of itself, or after ``n_iter``. Factors come in
    order of explained weighted variance, and the loadings of a factor sum to one. An empty matrix
    gives empty factors.
    """
    packed = given if isinstance(given, Packed) else pack(given)
    spark = packed.blocks.sparkSession
    m, w0 = len(packed.bins), packed.absent_weight
    if not m or not packed.n_samples:
        g = spark.createDataFrame([], "sample_item_id string, f int, v double")
        return [Factors(k, g, spark.createDataFrame([], "bin long, f int, v double"), []) for k in ks]
    models = []
    for k in ks:
        scale = float(np.sqrt(max(packed.mean, EPS) / k))
        models.append(Model(k, scale, seed, start(packed.bins, k, scale, seed + 1)))
    path, since, at = None, 0, -1
    totals = _pass(packed, models)
    while at < n_iter - 1 and not all(model.done for model in models):
        steps = 1 if at < 0 else min(check_every - at % check_every, n_iter - 1 - at)
        if packed.n_blocks > 1:
            steps = min(steps, RESTORE - since)
        totals = _iterate(packed, models, totals, steps)
        at, since = at + steps, since + (steps if packed.n_blocks > 1 else 1)
        if at % check_every == 0 or at == n_iter - 1:
            for model, t in zip([x for x in models if not x.done], list(totals), strict=True):
                q = model.q(t, w0)
                model.done = bool(model.history) and abs(model.history[-1] - q) / max(model.history[-1], EPS) < tol
                model.history.append(q)
                if model.done:
                    totals = [other for other in totals if other is not t]
        if since >= RESTORE:
            blocks, new = _restored(packed, models)
            if path:
                forget(spark, path)
            packed, path, since = replace(packed, blocks=blocks), new, 0
            for model in models:
                model.pending = []
    return _finished(packed, models)


def _finished(packed: Packed, models: list[Model]) -> list[Factors]:
    """Factors ordered and scaled: H to loadings that sum to one, G by what that takes."""
    spark, w0 = packed.blocks.sparkSession, packed.absent_weight

    def explained(block: _Block) -> np.ndarray:
        out = []
        for number, model in enumerate(models):
            g = block.g(number, model, w0)
            both = (g[block.row] * model.h[block.col]) ** 2
            out += [((block.w - w0)[:, None] * both).sum(0), (g * g).sum(0)]
        return np.concatenate(out)

    total, at, orders = _added(packed, sum(2 * x.k for x in models), explained), 0, []
    for model in models:
        present, squares = total[at : at + model.k], total[at + model.k : at + 2 * model.k]
        orders.append(np.argsort(-(present + w0 * squares * (model.h**2).sum(0)), kind="stable"))
        at += 2 * model.k
    sums = [model.h.sum(0) for model in models]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            for number, model in enumerate(models):
                g = (block.g(number, model, w0) * sums[number])[:, orders[number]]
                n, k = g.shape
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n * k, number, np.int32)), pa.array(np.repeat(np.array(block.samples, object), k), pa.string()),
                        pa.array(np.tile(np.arange(k, dtype=np.int32), n)), pa.array(g.ravel()),
                    ],
                    ["model", "sample_item_id", "f", "v"],
                )

    every, _ = stored(packed.blocks.mapInArrow(rows, "model int, sample_item_id string, f int, v double"), "factor-values")
    out = []
    for number, model in enumerate(models):
        h = (model.h / np.maximum(sums[number], EPS))[:, orders[number]]
        loadings = [(int(b), f, float(v)) for b, row in zip(packed.bins, h, strict=True) for f, v in enumerate(row)]
        g = every.where(F.col("model") == number).drop("model")
        out.append(Factors(model.k, g, spark.createDataFrame(loadings, "bin long, f int, v double"), model.history))
    return out


def wnmf(
    given: Sparse | Packed | DataFrame, k: int, n_iter: int = 500, seed: int = 0, tol: float = 1e-6, check_every: int = 20
) -> tuple[DataFrame, DataFrame, list[float]]:
    """Factors ``g (sample_item_id, f, v)`` and ``h (bin, f, v)`` and the history of Q.

    Of a plain table of cells ``(sample_item_id, bin, x, sigma)`` the absent ones have no weight.
    """
    if isinstance(given, DataFrame):
        given = Sparse(given, given.select("sample_item_id").distinct(), given.select("bin").distinct(), float("inf"))
    one = factorise(given, [k], n_iter, seed, tol, check_every)[0]
    return one.g, one.h, one.history


def q_expected(packed: Packed, k: int) -> float:
    """Degrees of freedom of a good fit."""
    n, m = packed.n_samples, len(packed.bins)
    return max(1.0, float(n * m - k * (n + m)))


def rank_scan(given: Sparse | Packed, ks: list[int], n_iter: int = 500, seed: int = 0) -> DataFrame:
    """Q and its expectation for several factor numbers, found in the same passes."""
    packed = given if isinstance(given, Packed) else pack(given)
    rows = []
    for found in factorise(packed, ks, n_iter, seed):
        q, qe = (found.history[-1] if found.history else 0.0), q_expected(packed, found.k)
        rows.append((found.k, q, qe, q / qe))
    return packed.blocks.sparkSession.createDataFrame(rows, "k int, q double, q_expected double, ratio double")


def factor_timeseries(g: DataFrame, clock: DataFrame) -> DataFrame:
    """Factor values per sample and time."""
    return g.join(clock.select("sample_item_id", "datetime_utc"), "sample_item_id").select(
        "sample_item_id", "datetime_utc", "f", F.col("v").alias("value")
    )


def factor_top_ions(h: DataFrame, bins: DataFrame, top: int = 12) -> DataFrame:
    """Most distinctive bins per factor: loading times its share of the bin's total loading."""
    total = h.groupBy("bin").agg(F.sum("v").alias("s"))
    rows = h.join(total, "bin").withColumn("exclusivity", F.col("v") / (F.col("s") + EPS)).withColumn(
        "score", F.col("v") * F.col("exclusivity")
    )
    place = F.row_number().over(Window.partitionBy("f").orderBy(F.desc("score"), "bin"))
    return rows.withColumn("place", place).where(F.col("place") <= top).join(bins.select("bin", "bin_mz"), "bin").select(
        "f", "place", "bin", "bin_mz", F.col("v").alias("weight"), "exclusivity", "score"
    )
