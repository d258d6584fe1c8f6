"""Axis relations: gap clustering, band joins and nearest matches.

Every relation here works on *cells* of the axis rather than on rows. A cell is
narrower than the tolerance, so the rows of one cell always belong together and
can be pre-aggregated before the shuffle; the cell table is bounded by the axis
range divided by the tolerance, however many rows there are and however they
crowd into one place.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cells per block when numbering bins along the axis.
BLOCK = 4096
# Axis units of a stretch whose rows meet in one task.
STRETCH = 32.0


def relative_cell(x: Column, tol_ppm: float, shrink: float = 1.0) -> Column:
    """Log-scale cell index; a cell spans ``tol_ppm * shrink``."""
    width = math.log1p(tol_ppm * 1e-6) * shrink
    return F.floor(F.ln(x) / F.lit(width))


def mixed_cell(x: Column, tol_ppm: float, floor_da: float) -> Column:
    """Cells as wide as ``max(x * tol_ppm, floor_da)``, joined smoothly where the two meet."""
    rel = tol_ppm * 1e-6
    knee = floor_da / rel
    u = F.when(x < knee, x / F.lit(floor_da)).otherwise(
        F.lit(knee / floor_da) + F.ln(x / F.lit(knee)) / F.lit(rel)
    )
    return F.floor(u / F.lit(1.001))


def _tolerance(tol_ppm: float | None, tol_abs: float | str | None) -> Column:
    if tol_abs is None:
        return F.lit(float(tol_ppm))
    return F.col(tol_abs) if isinstance(tol_abs, str) else F.lit(float(tol_abs))


def _gap_cell(x: str, tol_ppm: float | None, tol_abs: float | str | None) -> Column:
    if tol_abs is None:
        return relative_cell(F.col(x), tol_ppm, 1 - 1e-6)
    return F.floor(F.col(x) / (_tolerance(tol_ppm, tol_abs) * (1 - 1e-6)))


def gap_cells(
    df: DataFrame,
    x: str,
    tol_ppm: float | None = None,
    *,
    tol_abs: float | str | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Map occupied cells to bins of the sequential rule "a gap above tolerance starts a bin".

    Output: ``(*keys, cell, bin)``; ``bin`` counts from 0 in axis order per key.
    Neighbouring rows of one cell are always linked because the cell is narrower
    than the tolerance, so only the extremes of each cell matter. Bins are then
    numbered block by block, with a carry from the (small) block table.
    ``tol_abs`` may name a column that is constant within ``keys``.
    """
    keys = list(keys)
    cells = (
        df.where(F.col(x).isNotNull())
        .groupBy(*keys, _gap_cell(x, tol_ppm, tol_abs).alias("cell"))
        .agg(
            F.min(x).alias("lo"),
            F.max(x).alias("hi"),
            F.max(_tolerance(tol_ppm, tol_abs)).alias("tol"),
        )
        .withColumn("block", F.floor(F.col("cell") / BLOCK))
    )

    def is_break(prev: Column, cur: Column) -> Column:
        gap = (cur - prev) / prev * 1e6 if tol_abs is None else cur - prev
        return (gap > F.col("tol")).cast("long")

    inside = Window.partitionBy(*keys, "block").orderBy("cell")
    runs = cells.withColumn(
        "brk", F.coalesce(is_break(F.lag("hi").over(inside), F.col("lo")), F.lit(0))
    ).withColumn("local_bin", F.sum("brk").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = runs.groupBy(*keys, "block").agg(
        F.min("lo").alias("b_lo"),
        F.max("hi").alias("b_hi"),
        F.sum("brk").alias("b_brk"),
        F.max("tol").alias("tol"),
    )
    # The block table holds one row per 4096 cells of the axis.
    along = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("block")
    blocks = (
        blocks.withColumn(
            "head", F.coalesce(is_break(F.lag("b_hi").over(along), F.col("b_lo")), F.lit(0))
        )
        .withColumn(
            "base",
            F.sum(F.col("head") + F.col("b_brk")).over(along.rowsBetween(Window.unboundedPreceding, 0))
            - F.col("b_brk"),
        )
        .select(*keys, "block", "base")
    )
    return runs.join(blocks, [*keys, "block"]).select(
        *keys, "cell", (F.col("base") + F.col("local_bin")).alias("bin")
    )


def assign_bins(
    df: DataFrame,
    x: str,
    tol_ppm: float | None = None,
    *,
    tol_abs: float | str | None = None,
    keys: Sequence[str] = (),
    out: str = "bin",
) -> DataFrame:
    """``df`` without null positions, plus its gap-cluster number."""
    keys = list(keys)
    cell = _gap_cell(x, tol_ppm, tol_abs)
    mapping = gap_cells(df, x, tol_ppm, tol_abs=tol_abs, keys=keys).withColumnRenamed("bin", out)
    return (
        df.where(F.col(x).isNotNull())
        .withColumn("cell", cell)
        .join(mapping, [*keys, "cell"])
        .drop("cell")
    )


def neighbourhoods(
    library: DataFrame, cell: Column, payload: Sequence[str], keys: Sequence[str] = (), out: str = "near", unique: bool = False
) -> DataFrame:
    """``(*keys, cell, near)``: what a probe in ``cell`` can reach, one cell to either side.

    Copies collapse first, unless the library is ``unique``, so ``near`` holds distinct library entries only.
    """
    keys = list(keys)
    entries = library.select(*keys, cell.alias("_c"), F.struct(*payload).alias("_p"))
    return (
        (entries if unique else entries.distinct())
        .withColumn("cell", F.explode(F.array(F.col("_c") - 1, F.col("_c"), F.col("_c") + 1)))
        .groupBy(*keys, "cell")
        .agg(F.collect_list("_p").alias(out))
    )


def band_join(
    left: DataFrame,
    right: DataFrame,
    left_x: Column,
    right_x: Column,
    tol_ppm: float | None,
    within: Column,
    keys: Sequence[str] = (),
    how: str = "inner",
    *,
    width: float | None = None,
) -> DataFrame:
    """Join on a tolerance band as an equi-join on cells plus the exact predicate ``within``.

    ``within`` refers to the columns of both sides; ``tol_ppm``, or ``width`` in axis units,
    must bound it. The right side is replicated to three cells, so pass the smaller one there.
    """
    keys = list(keys)

    def cell_of(x: Column) -> Column:
        return relative_cell(x, tol_ppm, 1.01) if width is None else F.floor(x / F.lit(width * 1.01))

    lhs = left.withColumn("_cell", cell_of(left_x))
    rhs = right.withColumn("_rc", cell_of(right_x)).withColumn(
        "_cell", F.explode(F.array(F.col("_rc") - 1, F.col("_rc"), F.col("_rc") + 1))
    )
    for k in keys:
        rhs = rhs.withColumnRenamed(k, f"_k_{k}")
    cond = F.col("l._cell") == F.col("r._cell")
    for k in keys:
        cond = cond & (F.col(f"l.{k}") == F.col(f"r._k_{k}"))
    joined = lhs.alias("l").join(rhs.alias("r"), cond & within, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_cell")
    return joined.drop(F.col("l._cell")).drop(F.col("r._cell")).drop("_rc", *[f"_k_{k}" for k in keys])


def nearest(
    probes: DataFrame,
    library: DataFrame,
    probe_x: str,
    library_x: str,
    payload: Sequence[str],
    *,
    tol_ppm: float,
    floor_da: float | None = None,
    relative_to: str = "probe",
    keys: Sequence[str] = (),
    order: Sequence[str] = (),
    out: str = "hit",
) -> DataFrame:
    """``probes`` plus ``out``: the nearest library entry within tolerance, or null.

    The library side is gathered per cell first, so probe rows are matched in
    place (no shuffle when the library is small, one on the cell otherwise) and
    keep their number. Ties go to the smaller position, then to ``order``.
    """
    keys = list(keys)
    if floor_da is None:
        def cell_of(col: Column) -> Column:
            return relative_cell(col, tol_ppm, 1.01)
    else:
        def cell_of(col: Column) -> Column:
            return mixed_cell(col, tol_ppm, floor_da)
    fields = [library_x, *[c for c in payload if c != library_x]]
    rest = list(order) + [c for c in fields[1:] if c not in order]
    # Of entries at one position only the first in order can win, so copies collapse map-side.
    entries = library.where(F.col(library_x).isNotNull())
    if rest:
        first = F.min(F.struct(*rest)).alias("_first")
        entries = entries.groupBy(*keys, library_x).agg(first).select(*keys, library_x, *[F.col(f"_first.{c}").alias(c) for c in rest])
    lib = neighbourhoods(entries, cell_of(F.col(library_x)), fields, keys, "_near", unique=bool(rest))
    px = F.col(probe_x)

    def allowed(entry: Column) -> Column:
        x = entry[library_x]
        base = px if relative_to == "probe" else x
        if floor_da is None:
            return F.abs(px - x) / base * 1e6 <= tol_ppm
        return F.abs(px - x) <= F.greatest(base * tol_ppm * 1e-6, F.lit(floor_da))

    ranked = F.array_min(
        F.transform(
            F.filter("_near", allowed),
            lambda e: F.struct(
                F.abs(px - e[library_x]).alias("_d"),
                e[library_x].alias(library_x),
                *[e[c].alias(c) for c in rest],
            ),
        )
    )
    return (
        probes.withColumn("cell", cell_of(px))
        .join(lib, [*keys, "cell"], "left")
        .withColumn(out, ranked)
        .drop("cell", "_near")
    )


def meet(
    left: DataFrame,
    right: DataFrame,
    left_x: str,
    right_x: str,
    below: float,
    above: float,
    tol_ppm: float,
    fn: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    keys: Sequence[str] = ("sample_item_id",),
) -> DataFrame:
    """``fn`` over stretches of each key's axis: rows of ``left`` and all rows of ``right`` they can reach.

    A row at x looks at places from ``x - below`` to ``x + above``, with ``tol_ppm`` of the place around each. For probes that look at many places:
    they are shuffled once, as they are, instead of once per place; rows of ``right`` go to
    every stretch that reaches them. Rows without a key or position take no part.
    """
    keys = list(keys)

    def placed(df: DataFrame, x: str) -> DataFrame:
        for k in keys:
            df = df.where(F.col(k).isNotNull())
        return df.where(F.col(x).isNotNull() & ~F.isnan(x))

    def stretch(x: Column) -> Column:
        return F.floor(x / F.lit(STRETCH))

    x = F.col(right_x)
    slack = F.abs(x) * F.lit(2e-6 * tol_ppm)
    lhs = placed(left, left_x).withColumn("_stretch", stretch(F.col(left_x)))
    rhs = placed(right, right_x).withColumn("_stretch", F.explode(F.sequence(stretch(x - slack - above), stretch(x + slack + below))))
    place = [*keys, "_stretch"]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return fn(a.combine_chunks(), b.combine_chunks())

    return lhs.groupBy(*place).cogroup(rhs.groupBy(*place)).applyInArrow(run, schema)


def first_per_position(rows: pa.Table, x: str, order: Sequence[str]) -> pa.Table:
    """Rows in axis order, of those at one position the first by ``order`` (nulls first, NaN last)."""
    keys = [(x, "ascending")]
    for c in order:
        if pa.types.is_floating(rows[c].type):
            rows = rows.append_column(f"_nan_{c}", pc.fill_null(pc.is_nan(rows[c]), False))
            keys.append((f"_nan_{c}", "ascending"))
        keys.append((c, "ascending"))
    rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start")).combine_chunks()
    at = rows[x].to_numpy()
    return rows.filter(pa.array(np.concatenate([[True], at[1:] != at[:-1]]))) if len(at) else rows


def nearest_of(sorted_x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the position nearest each target, the smaller of two equally near, and its distance."""
    if not len(sorted_x):
        return np.zeros(len(target), np.int64), np.full(len(target), np.inf)
    up = np.searchsorted(sorted_x, target)
    low, high = np.maximum(up - 1, 0), np.minimum(up, len(sorted_x) - 1)
    d_low, d_high = np.abs(target - sorted_x[low]), np.abs(target - sorted_x[high])
    return np.where(d_low <= d_high, low, high), np.minimum(d_low, d_high)
