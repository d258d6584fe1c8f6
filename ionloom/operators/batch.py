"""Families of a whole batch: gates for unassigned bins, one clustering, background sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions.quantiles import exact_quantiles
from ionloom.operators import axis, chem
from ionloom.operators import families as fam
from ionloom.operators import traces as tr
from ionloom.session import cut_lineage

# Tolerance of "explained", least median of an unassigned bin, least share of
# samples to enter the clustering, least R2 of a carrier of the common mode.
MATCH_PPM, MEDIAN_FLOOR, UNION_PRESENCE, COMMON_R2 = 8.0, 50.0, 0.30, 0.70


def bin_gates(cells: DataFrame, bins: DataFrame, explained: DataFrame) -> DataFrame:
    """One row per bin: ``bin, bin_mz, median, presence, assigned, bright, iso_parent, enters``.

    ``explained``: ``(mz)`` of all explained peaks. A bright bin is unassigned, with a median of
    at least 50 over at least 8 samples. It enters the clustering when it is there in 30 % of
    the samples and not one isotope spacing above a brighter assigned bin.
    """
    library = explained.select(F.col("mz").alias("x")).distinct()
    hit = axis.band_join(
        bins.select("bin", "bin_mz"), library, F.col("bin_mz"), F.col("x"), MATCH_PPM,
        F.abs(F.col("x") - F.col("bin_mz")) / F.col("bin_mz") * 1e6 <= MATCH_PPM, how="left_semi",
    ).select("bin").withColumn("assigned", F.lit(True))
    samples = F.broadcast(cells.agg(F.count_distinct("sample_item_id").alias("samples")).withColumn("one", F.lit(1)))
    counts = cells.groupBy("bin").agg(F.count("height").alias("n"), F.count_if(F.col("height") > 0).alias("positive"))
    table = cut_lineage(
        bins.select("bin", "bin_mz").join(counts, "bin")
        .join(exact_quantiles(cells, ["bin"], "height", {"median": 0.5}), "bin").join(hit, "bin", "left")
        .withColumn("one", F.lit(1)).join(samples, "one")
        .select(
            "bin", "bin_mz", "median", "n", F.coalesce("assigned", F.lit(False)).alias("assigned"),
            (F.col("positive") / F.col("samples")).alias("presence"),
        )
    )
    bright = ~F.col("assigned") & (F.col("median") >= MEDIAN_FLOOR) & (F.col("n") >= tr.MIN_POINTS)
    table = table.withColumn("bright", bright)
    known = table.where("assigned").select(F.col("bin_mz").alias("x"), F.col("median").alias("known_median"))
    parents = chem.satellite_parents(table.where("bright").select("bin", "bin_mz", "median"), known, chem.SATELLITE_STEPS)
    enters = F.col("bright") & (F.col("presence") >= UNION_PRESENCE) & F.col("iso_parent").isNull()
    return table.join(parents.select("bin", F.col("parent_mz").alias("iso_parent")), "bin", "left").select(
        "bin", "bin_mz", "median", "presence", "assigned", "bright", "iso_parent", enters.alias("enters")
    )


def funnel(gates: DataFrame) -> DataFrame:
    """How many bins each gate leaves, as one row."""
    isotope = F.col("bright") & F.col("iso_parent").isNotNull()
    return gates.agg(
        F.count(F.lit(1)).alias("n_ts_bins"),
        F.count_if(~F.col("assigned")).alias("n_unassigned_any"),
        F.count_if(F.col("bright")).alias("n_after_brightness_persistence"),
        F.count_if(F.col("enters")).alias("n_entered_union"),
        F.count_if(isotope).alias("n_isotope_rejected"),
        F.count_if(F.col("bright") & ~isotope & (F.col("presence") < UNION_PRESENCE)).alias("n_below_presence"),
    )


def union_traces(assigned: DataFrame, cells: DataFrame, gates: DataFrame, clock: DataFrame) -> DataFrame:
    """Assigned traces ``(channel, label, datetime_utc, y)`` and those of the bins that enter, in one table."""
    entering = cells.join(gates.where("enters").select("bin", "bin_mz"), "bin").join(clock, "sample_item_id")
    unknown = entering.select(
        F.concat(F.lit("?"), F.format_string("%.4f", "bin_mz")).alias("channel"),
        F.lit(None).cast("string").alias("label"), "datetime_utc", F.col("height").alias("y"),
    )
    return assigned.select("channel", "label", "datetime_utc", "y").unionByName(unknown)


def assigned_traces(cells: DataFrame, bins: DataFrame, ledger: DataFrame, clock: DataFrame) -> DataFrame:
    """``channel, label, datetime_utc, y`` of each assigned ion ``(neutral_formula, adduct, mz)``, from its nearest bin.

    A channel is a bin, named by its position; of ions that share a bin the nearest one (ties: the
    smallest name) labels it, so that no bin enters twice.
    """
    ions = ledger.select(F.concat_ws(" ", "neutral_formula", "adduct").alias("label"), "mz").distinct()
    hit = axis.nearest(ions, bins, "mz", "bin_mz", ["bin"], tol_ppm=MATCH_PPM).select("label", "mz", F.col("hit.bin").alias("bin"))
    placed = hit.where("bin IS NOT NULL").join(bins.select("bin", "bin_mz"), "bin")
    gap = F.abs(F.col("mz") - F.col("bin_mz"))
    named = placed.groupBy("bin", "bin_mz").agg(F.min(F.struct(gap.alias("gap"), "label")).alias("first"))
    return cells.join(named, "bin").join(clock, "sample_item_id").select(
        F.format_string("%.4f", "bin_mz").alias("channel"), F.col("first.label").alias("label"), "datetime_utc", F.col("height").alias("y")
    )


def union_grid(traces: DataFrame) -> DataFrame:
    """``channel, t, hours, y``: traces of ``union_traces`` on their common time axis; the brightest of equal times counts."""
    best = traces.groupBy("channel", "datetime_utc").agg(F.max("y").alias("y"))
    timed = best.withColumn("hour", F.unix_micros(F.col("datetime_utc").cast("timestamp")) / F.lit(3.6e9))
    return tr.complete_grid(cut_lineage(tr.with_axis(timed, "hour", 1.0)))


def batch_families(traces: DataFrame, labels: DataFrame, cut: float = fam.DIST_T, merge_r: float = fam.MERGE_R) -> DataFrame:
    """One row per channel: ``channel, cluster, set, cluster_label``.

    ``traces``: every channel at every time point (``channel, t, hours, y``); ``labels``:
    ``(channel, label)`` with a null label for unassigned channels. Batches of 40 hours or more
    are compared without their daily wave and common mode, shorter ones as logarithms. Sets:
    ``family`` (moves), ``flat family``, ``changer``, ``common-mode``, ``structured``, ``flat``.
    A family is named after its brightest assigned member, or ``novel``.
    """
    points = traces.groupBy("channel").agg(F.count("y").alias("n")).where(F.col("n") >= tr.MIN_POINTS)
    traces = cut_lineage(traces.join(points, "channel", "left_semi"))
    span = traces.agg(F.max("hours") - F.min("hours")).first()[0] or 0.0
    if span >= tr.DIURNAL_SPAN_H:
        reference = labels.where("label IS NOT NULL").select("channel")
        rows, carried, _ = tr.decompose(traces, reference)
        rows = cut_lineage(rows.withColumnRenamed("r", "g"))
    else:
        rows = cut_lineage(tr.log_traces(traces))
        carried = traces.select("channel").distinct().withColumn("r2", F.lit(0.0))
    # Pairs beyond the cut never merge; a missing r has distance 1. The margin leaves rounding to the linkage.
    pairs = tr.pairwise_r(rows, "g", least_r=1.0 - cut - 1e-9 if cut < 1 else None)
    found = fam.complete_linkage(traces.select("channel").distinct(), pairs, cut)
    found = cut_lineage(fam.big_families(fam.merge_similar(rows, "g", found, merge_r)))
    moving = fam.split_flat(traces, found).select("cluster", "dynamic")

    lead = fam.members_by_brightness(traces, found).join(labels, "channel", "left").where("label IS NOT NULL")
    anchors = lead.groupBy("cluster").agg(F.min_by("label", "place").alias("anchor"))
    named = F.when(F.col("anchor").isNull(), "novel (no assigned anchor)").otherwise(F.concat(F.lit("co-varies with "), "anchor"))
    families = found.join(moving, "cluster", "left").join(anchors, "cluster", "left").select(
        "channel", "cluster", F.coalesce("dynamic", F.lit(False)).alias("dynamic"), named.alias("cluster_label")
    )
    changers = tr.big_changers(traces).select("channel", F.lit(True).alias("changer"))
    every = traces.select("channel").distinct().join(families, "channel", "left").join(changers, "channel", "left")
    every = every.join(carried, "channel", "left").join(tr.diurnal_eta2(traces), "channel", "left")
    kind = (
        F.when(F.col("dynamic"), "family")
        .when(F.col("changer"), "changer")
        .when(F.col("cluster").isNotNull(), "flat family")
        .when(F.col("r2") >= COMMON_R2, "common-mode")
        .when(F.col("eta2") >= tr.DIURNAL_ETA2, "structured")
        .otherwise("flat")
    )
    return every.select(
        "channel", "cluster", kind.alias("set"), F.when(F.col("dynamic"), F.col("cluster_label")).alias("cluster_label")
    )


def changing_series(traces: DataFrame, top: int = 28) -> DataFrame:
    """Series of the brightest changing channels, in long form: ``place, channel, hours, y``.

    Points that are missing or not positive are null; heights are rounded to whole counts.
    """
    changing = tr.dynamics(traces).where("changing")
    place = F.row_number().over(Window.orderBy(F.desc("median_cps"), "channel"))
    first = changing.select("channel", "median_cps").orderBy(F.desc("median_cps"), "channel").limit(top)
    first = first.withColumn("place", place).select("channel", "place")
    y = F.when(F.col("y") > 0, F.rint("y"))
    return traces.join(F.broadcast(first), "channel").select("place", "channel", F.bround("hours", 1).alias("hours"), y.alias("y"))
