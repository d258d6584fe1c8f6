"""Choice of representative samples of a run, or of every group of a pool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.operators import matrix


def sample_table(peaks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per sample: row count, total height, first time and name."""
    return peaks.groupBy(*keys, "sample_item_id").agg(
        F.count(F.lit(1)).alias("n_peaks"),
        F.sum("height").alias("tic"),
        F.min("datetime_utc").alias("datetime_utc"),
        F.min("sample_item_name").alias("sample_item_name"),
    )


def representative_samples(samples: DataFrame, n_time: int = 5) -> DataFrame:
    """Samples nearest to ``n_time`` equally spaced times, each used once, plus the richest one.

    Only the ``n_time`` nearest samples per target can ever be taken, and those
    are found by a distributed top-k per target.
    """
    t = F.unix_micros("datetime_utc").cast("double")
    ends = samples.agg(F.min(t).alias("t0"), F.max(t).alias("t1"), F.count(F.lit(1)).alias("n"))
    timed = samples.select("sample_item_id", t.alias("t")).withColumn("one", F.lit(1))
    targets = [
        F.struct(
            F.lit(i).alias("i"),
            (F.col("t0") + (F.col("t1") - F.col("t0")) * F.lit(i / max(n_time - 1, 1))).alias("at"),
        )
        for i in range(n_time)
    ]
    reach = (
        timed.join(F.broadcast(ends.withColumn("one", F.lit(1))), "one")
        .withColumn("target", F.explode(F.array(*targets)))
        .select("sample_item_id", "n", "target.i", F.abs(F.col("t") - F.col("target.at")).alias("d"), "t")
    )
    by_distance = Window.partitionBy("i").orderBy("d", "t", "sample_item_id")
    shortlist = reach.withColumn("rn", F.row_number().over(by_distance)).where(F.col("rn") <= n_time)
    per_target = shortlist.groupBy("i").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "sample_item_id"))), lambda e: e["sample_item_id"]).alias("ids")
    )
    picks = per_target.agg(
        F.aggregate(
            F.array_sort(F.collect_list(F.struct("i", "ids"))),
            F.array().cast("array<string>"),
            lambda taken, e: F.concat(
                taken,
                F.slice(F.filter(e["ids"], lambda s: ~F.array_contains(taken, s)), 1, 1),
            ),
        ).alias("ids")
    ).select(F.explode("ids").alias("sample_item_id")).withColumn("on_grid", F.lit(True))
    richest = samples.agg(
        F.max(F.struct(F.col("tic"), -F.unix_micros("datetime_utc"), F.col("sample_item_id"))).alias("m")
    ).select(F.col("m.sample_item_id").alias("sample_item_id")).withColumn("is_max", F.lit(True))
    chosen = picks.join(richest, "sample_item_id", "full_outer")
    role = (
        F.when(F.col("on_grid") & F.col("is_max"), "time-grid+max-TIC")
        .when(F.col("is_max"), "max-TIC")
        .otherwise("time-grid")
    )
    return samples.join(F.broadcast(chosen), "sample_item_id").select(*samples.columns, role.alias("role"))


def coverage_samples(
    peaks: DataFrame,
    keys: Sequence[str] = (),
    coverage_target: float = 0.85,
    k_max: int = 10,
    k_min: int = 6,
    height_floor: float = 1000.0,
    include_time_grid: bool = True,
) -> DataFrame:
    """Smallest set of samples that are the brightest for most significant bins, per group.

    Every bin has one brightest sample, so the cover is a running sum over the
    samples by bins won. All rankings are top-k per group, which Spark limits
    before the shuffle.
    """
    keys = list(keys)
    k_min = min(k_min, k_max)
    part = keys or [F.lit(0)]
    tab = sample_table(peaks, keys)
    sized = _with_group(
        tab,
        tab.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n_samples"),
            F.min(F.struct("datetime_utc", "sample_item_id")).alias("first_s"),
            F.max(F.struct("datetime_utc", "sample_item_id")).alias("last_s"),
        ),
        keys,
    )
    cells = matrix.matrix_cells(matrix.binned_peaks(peaks, keys=keys), keys)
    winners = (
        cells.groupBy(*keys, "bin")
        .agg(
            F.max("height").alias("top"),
            F.min(F.struct(-F.col("height"), F.col("sample_item_id"))).alias("w"),
        )
        .where(F.col("top") >= height_floor)
        .groupBy(*keys, F.col("w.sample_item_id").alias("sample_item_id"))
        .agg(F.count(F.lit(1)).alias("bins_won"))
    )
    totals = winners.groupBy(*keys).agg(F.sum("bins_won").alias("n_bins"))
    by_wins = Window.partitionBy(*part).orderBy(F.desc("bins_won"), "sample_item_id")
    top = winners.withColumn("rn", F.row_number().over(by_wins)).where(F.col("rn") <= k_max)
    top = _with_group(top, totals, keys).withColumn(
        "covered", F.sum("bins_won").over(by_wins.rowsBetween(Window.unboundedPreceding, 0))
    )
    enough = (F.col("covered") / F.greatest("n_bins", F.lit(1)) >= coverage_target) & (F.col("rn") >= k_min)
    stop = F.coalesce(
        F.max(enough.cast("int")).over(by_wins.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    chosen = top.withColumn("stopped", stop).where(F.col("stopped") == 0).select(
        *keys, "sample_item_id", "bins_won"
    )
    counted = chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_chosen"))
    by_tic = Window.partitionBy(*part).orderBy(F.desc("tic"), "sample_item_id")
    spare = (
        tab.join(chosen, [*keys, "sample_item_id"], "left_anti")
        .withColumn("rn", F.row_number().over(by_tic))
        .where(F.col("rn") <= k_min)
    )
    padding = _with_group(spare, counted, keys, "left").where(
        F.col("rn") + F.coalesce("n_chosen", F.lit(0)) <= k_min
    ).select(*keys, "sample_item_id", F.lit(0).cast("long").alias("bins_won"))
    covering = chosen.unionByName(padding).withColumn("covers", F.lit(True))
    flagged = sized.join(covering, [*keys, "sample_item_id"], "left").withColumn(
        "is_end",
        F.lit(include_time_grid)
        & (F.col("n_samples") >= 2)
        & F.col("sample_item_id").isin(F.col("first_s.sample_item_id"), F.col("last_s.sample_item_id")),
    )
    small = F.col("n_samples") <= k_min
    role = (
        F.when(small, "coverage-winner")
        .when(F.col("covers") & F.col("is_end"), "coverage+time-grid")
        .when(F.col("covers"), "coverage-winner")
        .when(F.col("is_end"), "time-grid")
    )
    won = F.when(small, F.lit(0)).otherwise(F.coalesce("bins_won", F.lit(0))).cast("long")
    return (
        flagged.withColumn("role", role)
        .where(F.col("role").isNotNull())
        .select(*tab.columns, "role", won.alias("bins_won"))
    )


def pooled_union(peaks: DataFrame, group: str = "sample_batch_name", **kw) -> tuple[DataFrame, DataFrame]:
    """Coverage samples inside every group: the distinct ids in order, and the table behind them."""
    kw = {"coverage_target": 0.90, "k_max": 6, **kw}
    table = coverage_samples(peaks, keys=[group], **kw)
    ids = table.groupBy("sample_item_id").agg(F.min(F.struct(group, "datetime_utc")).alias("first_seen"))
    return ids, table


def _with_group(rows: DataFrame, per_group: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    if keys:
        return rows.join(per_group, list(keys), how)
    one = F.lit(1)
    return rows.withColumn("_one", one).join(
        F.broadcast(per_group.withColumn("_one", one)), "_one", how
    ).drop("_one")
