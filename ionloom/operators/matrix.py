"""The sparse samples x bins matrix and what is read off it. Never pivoted: an absent
row is a missing cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions.quantiles import exact_quantiles
from ionloom.operators import axis

BIN_PPM = 5.0
SERIES_PPM = 8.0


def binned_peaks(peaks: DataFrame, tol_ppm: float = BIN_PPM, keys: Sequence[str] = ()) -> DataFrame:
    """Peaks with the number of their axis bin (numbered per ``keys``)."""
    usable = peaks.where(
        F.col("mz").isNotNull() & F.col("height").isNotNull() & F.col("sample_item_id").isNotNull()
    )
    return axis.assign_bins(usable, "mz", tol_ppm, keys=keys)


def bin_table(binned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per bin: height-weighted position, extent and row count."""
    return binned.groupBy(*keys, "bin").agg(
        F.try_divide(F.sum(F.col("mz") * F.col("height")), F.sum("height")).alias("bin_mz"),
        F.min("mz").alias("lo_mz"),
        F.max("mz").alias("hi_mz"),
        F.count(F.lit(1)).alias("n_peaks"),
    )


def matrix_cells(binned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return binned.groupBy(*keys, "sample_item_id", "bin").agg(F.sum("height").alias("height"))


def sample_clock(peaks: DataFrame) -> DataFrame:
    """First timestamp per sample and its hours since the start of the run."""
    first = peaks.groupBy("sample_item_id").agg(F.min("datetime_utc").alias("datetime_utc"))
    start = F.broadcast(first.agg(F.min("datetime_utc").alias("t0")).withColumn("one", F.lit(1)))
    return (
        first.withColumn("one", F.lit(1))
        .join(start, "one")
        .select(
            "sample_item_id",
            "datetime_utc",
            ((F.unix_micros("datetime_utc") - F.unix_micros("t0")) / F.lit(3.6e9)).alias("hours"),
        )
    )


def native_cadence(peaks: DataFrame, target_bins: int = 50) -> DataFrame:
    """One row: bin width in minutes from the median spacing of the samples.

    The spacing between neighbours is taken day by day with a carry from the day
    before, so no task sees the whole run.
    """
    times = (
        peaks.groupBy("sample_item_id")
        .agg(F.min("datetime_utc").alias("t"))
        .where(F.col("t").isNotNull())
        .select((F.unix_micros("t") / F.lit(1e6)).alias("t"))
    )
    day = times.withColumn("day", F.floor(F.col("t") / 86400))
    ends = day.groupBy("day").agg(F.max("t").alias("last_t"))
    carry = ends.select(
        "day", F.lag("last_t").over(Window.partitionBy(F.lit(0)).orderBy("day")).alias("before")
    )
    in_day = Window.partitionBy("day").orderBy("t")
    steps = day.join(carry, "day").select(
        (F.col("t") - F.coalesce(F.lag("t").over(in_day), F.col("before"))).alias("step")
    )
    spacing = exact_quantiles(steps, [], "step", {"step": 0.5})
    span = times.agg(
        F.count(F.lit(1)).alias("n"), ((F.max("t") - F.min("t")) / 60.0).alias("span")
    )
    joined = span.withColumn("one", F.lit(1)).join(spacing.withColumn("one", F.lit(1)), "one", "left")
    fallback = F.greatest(
        F.lit(1),
        F.rint(F.when(F.col("n") >= 2, F.col("span")).otherwise(30.0) / target_bins).cast("int"),
    )
    return joined.select(
        F.when(
            (F.col("n") >= 3) & (F.col("step") > 0),
            F.greatest(F.lit(1), F.ceil(F.col("step") / 60.0).cast("int")),
        )
        .otherwise(fallback)
        .cast("long")
        .alias("bin_minutes")
    )


def time_bucket_medians(cells: DataFrame, clock: DataFrame, hours: float = 2.0) -> DataFrame:
    """Median height per (time bucket of the epoch, bin)."""
    step = hours * 3600.0
    bucketed = cells.join(
        clock.select("sample_item_id", F.floor(F.unix_micros("datetime_utc") / 1e6 / step).alias("tb")),
        "sample_item_id",
    )
    return exact_quantiles(bucketed, ["tb", "bin"], "height", {"height": 0.5})


def regular_grid(traces: DataFrame, step_hours: float, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Median per slot of a fixed grid from the run start; empty slots stay, as nulls.

    ``traces``: ``(*keys, hours, y)``. Slot numbers count from 1.
    """
    slot = F.floor(F.col("hours") / step_hours) + 1
    med = exact_quantiles(traces.withColumn("slot", slot), [*keys, "slot"], "y", {"y": 0.5})
    last = traces.agg(F.max(slot).alias("n")).withColumn("one", F.lit(1))
    frame = (
        traces.select(*keys)
        .distinct()
        .withColumn("one", F.lit(1))
        .join(F.broadcast(last), "one")
        .select(*keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("slot"))
    )
    return frame.join(med, [*keys, "slot"], "left")


def total_near(cells: DataFrame, bins: DataFrame, library: DataFrame, tol_ppm: float = SERIES_PPM) -> DataFrame:
    """Per-sample sum over the bins next to a library position (left or right neighbour)."""
    hit = neighbours_within(bins, library, tol_ppm).select("bin").distinct()
    return (
        cells.join(hit, "bin", "left_semi")
        .groupBy("sample_item_id")
        .agg(F.sum("height").alias("reagent_total"))
    )


def neighbours_within(bins: DataFrame, library: DataFrame, tol_ppm: float) -> DataFrame:
    """Library rows x their left and right neighbouring bins, when within tolerance.

    Tolerance is relative to the library position ``mz``.
    """
    near = axis.neighbourhoods(bins, axis.relative_cell(F.col("bin_mz"), tol_ppm, 1.01), ["bin_mz", "bin"])
    mz = F.col("mz")
    inside = F.filter("near", lambda e: F.abs(e["bin_mz"] - mz) / mz * 1e6 <= tol_ppm)
    left = F.array_max(F.filter(inside, lambda e: e["bin_mz"] < mz))
    right = F.array_min(F.filter(inside, lambda e: e["bin_mz"] >= mz))
    return (
        library.withColumn("cell", axis.relative_cell(mz, tol_ppm, 1.01))
        .join(near, "cell")
        .withColumn("hit", F.explode(F.array_compact(F.array(left, right))))
        .select(*library.columns, F.col("hit.bin").alias("bin"), F.col("hit.bin_mz").alias("bin_mz"))
    )


def normalised(cells: DataFrame, totals: DataFrame) -> DataFrame:
    """Heights over the per-sample total; a zero or absent total gives a missing value."""
    return cells.join(totals, "sample_item_id", "left").withColumn(
        "norm", F.try_divide(F.col("height"), F.nullif(F.col("reagent_total"), F.lit(0.0)))
    )


def bin_metrics(cells: DataFrame, value: str = "height") -> DataFrame:
    """Presence, median and sample-std cv per bin over all samples of the matrix."""
    n = cells.agg(F.count_distinct("sample_item_id").alias("n_all")).withColumn("one", F.lit(1))
    stats = cells.groupBy("bin").agg(
        F.count(value).alias("n"),
        F.try_divide(F.stddev_samp(value), F.avg(value)).alias("cv"),
    )
    med = exact_quantiles(cells, ["bin"], value, {"median": 0.5})
    return (
        stats.join(med, "bin", "left")
        .withColumn("one", F.lit(1))
        .join(F.broadcast(n), "one")
        .select("bin", (F.col("n") / F.col("n_all")).alias("presence"), "median", "cv")
    )


def formula_traces(
    cells: DataFrame, bins: DataFrame, ions: DataFrame, clock: DataFrame, totals: DataFrame | None = None
) -> DataFrame:
    """Trace per formula: sum over the distinct bins any of its ions touches, per sample.

    ``ions``: ``(formula, mz)``. ``totals`` switches to the normalised modes.
    """
    pairs = neighbours_within(bins, ions, SERIES_PPM).select("formula", "bin").distinct()
    out = cells.join(pairs, "bin").groupBy("formula", "sample_item_id").agg(F.sum("height").alias("y"))
    return _timed(out, clock, totals)


def ion_traces(
    cells: DataFrame, bins: DataFrame, ions: DataFrame, clock: DataFrame, totals: DataFrame | None = None
) -> DataFrame:
    """Trace per ion key: its single nearest bin within tolerance. ``ions``: ``(key, mz)``."""
    hit = axis.nearest(ions, bins, "mz", "bin_mz", ["bin"], tol_ppm=SERIES_PPM, relative_to="probe")
    pairs = hit.where(F.col("hit").isNotNull()).select("key", F.col("hit.bin").alias("bin"))
    out = cells.join(pairs, "bin").select("key", "sample_item_id", F.col("height").alias("y"))
    return _timed(out, clock, totals)


def _timed(traces: DataFrame, clock: DataFrame, totals: DataFrame | None) -> DataFrame:
    if totals is not None:
        traces = traces.join(totals, "sample_item_id", "left").withColumn(
            "y", F.try_divide(F.col("y"), F.nullif(F.col("reagent_total"), F.lit(0.0)))
        ).drop("reagent_total")
    return traces.join(clock.select("sample_item_id", "hours"), "sample_item_id")


def window_trace(peaks: DataFrame, mz: float | Column, tol_ppm: float = BIN_PPM) -> DataFrame:
    """Height per timestamp summed over the peaks within tolerance of one position.

    The position is a literal, or a column already on ``peaks``; bounds are put
    as plain comparisons first so that they reach the scan.
    """
    x = F.lit(float(mz)) if not isinstance(mz, Column) else mz
    margin = x * (tol_ppm * 1.0001e-6)
    return (
        peaks.where((F.col("mz") >= x - margin) & (F.col("mz") <= x + margin))
        .where(F.abs(F.col("mz") - x) / x * 1e6 <= tol_ppm)
        .groupBy("datetime_utc")
        .agg(F.sum("height").alias("height"), F.count_distinct("peak_id").alias("n_peak_ids"))
    )
