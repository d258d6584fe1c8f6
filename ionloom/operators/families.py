"""Families of co-varying channels: complete linkage, merging, cohesion, flat split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions.quantiles import exact_quantiles
from ionloom.functions.stats import pair_r
from ionloom.operators import traces as tr
from ionloom.session import cut_lineage

DIST_T = 0.40
MERGE_R = 0.85
MIN_MEMBERS = 3
COHESION_MIN = 0.50


def complete_linkage(items: DataFrame, pairs: DataFrame, cut: float = DIST_T) -> DataFrame:
    """Complete-linkage clusters below ``cut``: ``(channel, cluster)``; a lone channel is its own.

    ``items``: ``(channel)``; ``pairs``: ``(a, b, r)``, distance ``1 - r`` and a
    missing r counting as 0. Complete linkage is reducible, so merging every pair
    of mutual nearest neighbours at once gives the same tree as one merge at a
    time. A pair of clusters further apart than the cut can never merge and is
    dropped, so the pair table only shrinks. Each cluster is named after its
    smallest channel.
    """
    labels = cut_lineage(items.select("channel", F.col("channel").alias("cluster")).distinct())
    edges = cut_lineage(
        pairs.select("a", "b", (F.lit(1.0) - F.coalesce("r", F.lit(0.0))).alias("d")).where(F.col("d") <= cut)
    )
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
        order = F.struct("d", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        near = both.groupBy("a").agg(F.min(order).alias("best"))
        # A pair is mutual when both ends chose it: the same (lo, hi) shows up twice.
        merged = (
            near.groupBy("best.lo", "best.hi").agg(F.count(F.lit(1)).alias("votes")).where("votes = 2")
            .select(F.col("hi").alias("old"), F.col("lo").alias("new"))
        )
        merged = cut_lineage(merged)
        sizes = merged.select(F.col("new").alias("c"), F.lit(2).alias("k"))

        def renamed(df: DataFrame, col: str) -> DataFrame:
            return df.join(merged, F.col(col) == F.col("old"), "left").withColumn(
                col, F.coalesce("new", col)
            ).drop("old", "new")

        labels = cut_lineage(renamed(labels, "cluster"))
        moved = renamed(renamed(edges, "a"), "b").where("a <> b")
        folded = moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
            F.max("d").alias("d"), F.count(F.lit(1)).alias("have")
        )
        need = folded.join(sizes.select(F.col("c").alias("a"), F.col("k").alias("ka")), "a", "left").join(
            sizes.select(F.col("c").alias("b"), F.col("k").alias("kb")), "b", "left"
        )
        edges = cut_lineage(
            need.where(F.col("have") == F.coalesce("ka", F.lit(1)) * F.coalesce("kb", F.lit(1))).select("a", "b", "d")
        )
    return labels


def big_families(labels: DataFrame, min_members: int = MIN_MEMBERS) -> DataFrame:
    """Only the families with enough members."""
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_members)
    return labels.join(sizes, "cluster", "left_semi").select("channel", "cluster")


def merge_similar(
    rows: DataFrame, value: str, labels: DataFrame, merge_r: float = MERGE_R, min_members: int = MIN_MEMBERS
) -> DataFrame:
    """Fold families whose mean traces correlate at ``merge_r`` or more into one."""
    big = cut_lineage(big_families(labels, min_members))
    means = rows.join(big, "channel").groupBy("cluster", "t").agg(F.avg(value).alias("m"))
    pairs = tr.pairwise_r(means, "m", min_points=2, key="cluster")
    groups = complete_linkage(big.select(F.col("cluster").alias("channel")).distinct(), pairs, 1.0 - merge_r)
    folded = groups.select(F.col("channel").alias("cluster"), F.col("cluster").alias("folded"))
    return labels.join(folded, "cluster", "left").select(
        "channel", F.coalesce("folded", "cluster").alias("cluster")
    )


def threshold_scan(items: DataFrame, pairs: DataFrame, cuts: Sequence[float] = (0.3, 0.4, 0.5, 0.6, 0.7)) -> DataFrame:
    """Family sizes at several cuts: ``(cut, cluster, n)`` for families of three or more."""
    out = None
    for cut in cuts:
        sizes = (
            complete_linkage(items, pairs, cut).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= MIN_MEMBERS).withColumn("cut", F.lit(cut))
        )
        out = sizes if out is None else out.unionByName(sizes)
    return out.select("cut", "cluster", "n")


def cohesion(labels: DataFrame, pairs: DataFrame, r_min: float = COHESION_MIN) -> DataFrame:
    """Mean r among the members of each family, flagged when low."""
    left = labels.select(F.col("channel").alias("a"), F.col("cluster"))
    right = labels.select(F.col("channel").alias("b"), F.col("cluster").alias("cb"))
    inside = pairs.join(left, "a").join(right, "b").where(F.col("cluster") == F.col("cb"))
    means = inside.groupBy("cluster").agg(F.avg("r").alias("mean_r"))
    return labels.select("cluster").distinct().join(means, "cluster", "left").select(
        "cluster", "mean_r", F.coalesce(F.col("mean_r") < r_min, F.lit(False)).alias("flagged")
    )


def family_rows(traces: DataFrame, labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per family: size, mean r, shape and peak time of the smoothed mean z-trace."""
    g = traces.join(labels, "channel").withColumn("g", F.when(F.col("y").isNotNull(), F.log10(F.greatest("y", F.lit(1e-9)))))
    scale = g.groupBy("channel").agg(F.avg("g").alias("m"), F.stddev_samp("g").alias("s"))
    z = g.join(scale, "channel").withColumn("z", F.try_divide(F.col("g") - F.col("m"), F.nullif("s", F.lit(0.0))))
    mean = z.groupBy("cluster", "t", "hours").agg(F.avg("z").alias("y"))
    sm = cut_lineage(tr.smoothed(cut_lineage(mean), 5, "cluster"))
    shape = tr.ends(sm, "s", "cluster").select("cluster", "shape")
    peak = sm.groupBy("cluster").agg(F.min_by("hours", F.struct(-F.col("s"), F.col("t"))).alias("peak_hour"))
    size = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return (
        size.join(cohesion(labels, pairs).select("cluster", "mean_r"), "cluster")
        .join(shape, "cluster").join(peak, "cluster")
    )


def remaining_row(traces: DataFrame, labels: DataFrame) -> DataFrame:
    """Size, shape and peak time of all channels that are in no family, as one overview row."""
    rest = traces.select("channel").distinct().join(labels, "channel", "left_anti").withColumn("cluster", F.lit(0))
    none = rest.select(F.col("channel").alias("a"), F.col("channel").alias("b"), F.lit(0.0).alias("r")).limit(0)
    return family_rows(traces, rest, none).select("n", "shape", "peak_hour")


def members_by_brightness(traces: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of each family with their place by median brightness."""
    med = exact_quantiles(traces, ["channel"], "y", {"median": 0.5})
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("median"), "channel"))
    return labels.join(med, "channel", "left").withColumn("place", place)


def split_flat(traces: DataFrame, labels: DataFrame) -> DataFrame:
    """Per family: the measures of its mean trace and whether it is dynamic or flat.

    A flat family does not move, unless it carries a coherent daily wave; or it
    moves only while settling, which shows as a start near its own peak and a
    flat remainder.
    """
    mean = cut_lineage(tr.family_mean(traces, labels))
    span = mean.agg((F.max("hours") - F.min("hours")).alias("span")).withColumn("one", F.lit(1))
    out = (
        tr.smoothed_range(mean, key="cluster").withColumnRenamed("range", "full")
        .join(tr.smoothed_range(tr.settle_trim(mean, "cluster"), key="cluster").withColumnRenamed("range", "settled"), "cluster")
        .join(tr.starts_high(mean, "cluster"), "cluster")
        .join(tr.diurnal_eta2(mean, "cluster"), "cluster")
        .withColumn("one", F.lit(1)).join(F.broadcast(span), "one").drop("one")
    )
    measurable = F.col("span") >= tr.DIURNAL_SPAN_H
    bar = F.when(measurable & (F.col("eta2") < tr.DIURNAL_ETA2), 0.5).otherwise(0.8)
    wave = measurable & (F.col("eta2") >= tr.DIURNAL_ETA2) & (F.col("full") >= tr.DIURNAL_MIN_RANGE)
    dynamic = F.when(F.col("full") < tr.FLAT_CLUSTER_RANGE, wave).otherwise(
        ~((F.col("settled") < tr.FLAT_CLUSTER_RANGE) & (F.col("starts_high") >= bar))
    )
    return out.select("cluster", "full", "settled", "starts_high", "eta2", dynamic.alias("dynamic"))


def channel_agreement(
    traces: DataFrame, channels: DataFrame, floor: float = 150.0, min_points: int = tr.MIN_POINTS
) -> DataFrame:
    """Do the channels of one neutral track each other? One row per neutral.

    ``channels``: ``(channel, neutral_formula, adduct)``. Pairs are formed within
    a neutral only, which has at most one channel per ion form.
    """
    med = exact_quantiles(traces, ["channel"], "y", {"median": 0.5})
    counts = traces.groupBy("channel").agg(F.count("y").alias("n"))
    ok = (
        channels.join(med, "channel").join(counts, "channel")
        .where((F.col("n") >= min_points) & (F.col("median") >= floor))
    )
    place = F.row_number().over(Window.partitionBy("neutral_formula").orderBy(F.desc("median"), "channel"))
    ok = ok.withColumn("place", place)
    pos = traces.where(F.col("y") > 0).select("channel", "t", F.log10("y").alias("g")).join(
        ok.select("channel", "neutral_formula", "place"), "channel"
    )
    right = pos.select(
        "neutral_formula", "t", F.col("place").alias("pb"), F.col("g").alias("gb")
    )
    pairs = (
        pos.join(right, ["neutral_formula", "t"]).where(F.col("place") < F.col("pb"))
        .groupBy("neutral_formula", "place", "pb")
        .agg(pair_r(F.col("g"), F.col("gb")).alias("r"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") >= min_points) & F.col("r").isNotNull())
    )
    scored = pairs.groupBy("neutral_formula").agg(
        F.min("r").alias("worst"),
        F.max(F.when((F.col("place") == 1) & (F.col("pb") == 2), F.col("r"))).alias("top2"),
    )
    listed = ok.groupBy("neutral_formula").agg(
        F.count(F.lit(1)).alias("n_channels"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("place", "adduct", F.rint("median").cast("long").alias("m")))),
                lambda e: F.concat_ws("~", e["adduct"], e["m"].cast("string")),
            ),
            ", ",
        ).alias("channels"),
    )
    verdict = F.when(F.col("worst") >= 0.7, "agree").when(F.col("worst") >= 0.4, "marginal").otherwise("disagree")
    return scored.join(listed, "neutral_formula").where("n_channels >= 2").select(
        "neutral_formula", "n_channels", F.bround("worst", 3).alias("worst_r"),
        F.bround("top2", 3).alias("top2_r"), "channels", verdict.alias("verdict"),
    )
