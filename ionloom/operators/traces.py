"""Time-series measures of long traces.

A trace table is ``(channel, t, hours, y)``: ``t`` counts the time points of the
common axis, ``y`` is null (or the row absent) where nothing was detected.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions.quantiles import exact_quantiles
from ionloom.functions.stats import cv_pop, pair_r, slope
from ionloom.session import cut_lineage

MIN_POINTS = 8
FLAT_CV = 0.30
SMOOTH_W = 3
PEAK_RANGE = 1.7
DIURNAL_ETA2 = 0.3
DIURNAL_MIN_RANGE = 1.15
DIURNAL_SPAN_H = 40.0
DIURNAL_BINS = 8
DIEL_BINS = 24
FLAT_CLUSTER_RANGE = 1.4
SETTLE_FRAC = 0.18


def positive(y: Column) -> Column:
    return F.when(y > 0, y)


def with_axis(traces: DataFrame, time: str, unit_hours: float) -> DataFrame:
    """Add ``t`` (0, 1, ... over the distinct times of the run) and ``hours`` since its start.

    The axis is numbered day by day with a carry, so it needs no global sort.
    """
    per_day = max(1, int(round(24.0 / unit_hours)))
    axis = traces.select(time).distinct().withColumn("_d", F.floor(F.col(time) / per_day))
    inside = Window.partitionBy("_d").orderBy(time)
    days = axis.groupBy("_d").agg(F.count(F.lit(1)).alias("_n"), F.min(time).alias("_first"))
    carry = Window.partitionBy(F.lit(0)).orderBy("_d")
    days = days.select(
        "_d",
        (F.sum("_n").over(carry.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_base"),
        F.min("_first").over(Window.partitionBy(F.lit(0))).alias("_t0"),
    )
    axis = axis.withColumn("_rn", F.row_number().over(inside)).join(days, "_d").select(
        time,
        (F.col("_base") + F.col("_rn") - 1).alias("t"),
        ((F.col(time) - F.col("_t0")) * F.lit(unit_hours)).alias("hours"),
    )
    return traces.join(axis, time)


def complete_grid(traces: DataFrame) -> DataFrame:
    """Every channel at every time point; absent cells become null."""
    axis = traces.select("t", "hours").distinct()
    # Time points are numbered, so a channel makes its own from the two ends, which are one row.
    ends = F.broadcast(axis.agg(F.min("t").alias("_lo"), F.max("t").alias("_hi")).withColumn("one", F.lit(1)))
    frame = (
        traces.select("channel").distinct().withColumn("one", F.lit(1)).join(ends, "one").where("_lo IS NOT NULL")
        .select("channel", F.explode(F.sequence("_lo", "_hi")).alias("t"))
        .join(axis, "t")
        .select("channel", "t", "hours")
    )
    return frame.join(traces.select("channel", "t", "y"), ["channel", "t"], "left")


def trace_cv(traces: DataFrame) -> DataFrame:
    """Population cv of the positive points; 0 for an empty trace."""
    return traces.groupBy("channel").agg(F.coalesce(cv_pop(positive(F.col("y"))), F.lit(0.0)).alias("cv"))


def smoothed(traces: DataFrame, w: int = SMOOTH_W, key: str = "channel") -> DataFrame:
    """Add ``s``: centred moving mean of width ``w`` over the median-filled trace.

    ``traces`` must hold every time point. Points beyond either end count as
    zero, as the constant divisor says; an even width leans to the left. A
    channel with fewer than ``w`` points keeps its filled values.
    """
    med = exact_quantiles(traces, [key], "y", {"_med": 0.5})
    filled = traces.join(med, key, "left").withColumn("f", F.coalesce("y", "_med")).drop("_med")
    whole = Window.partitionBy(key)
    left, right = w // 2, (w - 1) // 2
    frame = whole.orderBy("t").rowsBetween(-left, right)
    return filled.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn(
        "s", F.when(F.col("_n") >= w, F.sum("f").over(frame) / F.lit(float(w))).otherwise(F.col("f"))
    ).drop("_n", "f")


def smoothed_range(traces: DataFrame, w: int = SMOOTH_W, key: str = "channel") -> DataFrame:
    """Largest over median positive point of the smoothed trace, 0 without any."""
    s = cut_lineage(smoothed(traces, w, key).select(key, "s"))
    pos = s.where(F.col("s") > 0)
    top = s.groupBy(key).agg(F.max(positive(F.col("s"))).alias("_top"))
    med = exact_quantiles(pos, [key], "s", {"_m": 0.5})
    return top.join(med, key, "left").select(
        key, F.coalesce(F.try_divide(F.col("_top"), F.col("_m")), F.lit(0.0)).alias("range")
    )


def diurnal_eta2(
    traces: DataFrame, key: str = "channel", bins: int = DIURNAL_BINS, min_points: int = 24,
    min_span: float = DIURNAL_SPAN_H,
) -> DataFrame:
    """Share of the log variance between hour-of-day bins; 0 for short or sparse traces."""
    rows = traces.where((F.col("y") > 0) & F.col("hours").isNotNull()).select(
        key,
        F.log10("y").alias("g"),
        "hours",
        F.floor(F.pmod(F.col("hours"), F.lit(24.0)) / F.lit(24.0 / bins)).alias("hb"),
    )
    per_bin = rows.groupBy(key, "hb").agg(
        F.count(F.lit(1)).alias("n"), F.avg("g").alias("m"), F.var_pop("g").alias("v"),
        F.min("hours").alias("h0"), F.max("hours").alias("h1"),
    )
    # Sums of squares about the bin means and about the grand mean.
    total = per_bin.groupBy(key).agg(
        F.sum("n").alias("n_all"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"),
        (F.max("h1") - F.min("h0")).alias("span"),
    )
    parts = per_bin.join(total, key).groupBy(key).agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)).alias("between"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        F.first("n_all").alias("n_all"),
        F.first("span").alias("span"),
    )
    usable = (F.col("n_all") >= min_points) & (F.col("span") >= min_span)
    share = F.try_divide(F.col("between"), F.nullif(F.col("between") + F.col("within"), F.lit(0.0)))
    out = parts.select(key, F.when(usable, F.coalesce(share, F.lit(0.0))).otherwise(0.0).alias("eta2"))
    return traces.select(key).distinct().join(out, key, "left").select(
        key, F.coalesce("eta2", F.lit(0.0)).alias("eta2")
    )


def varies(traces: DataFrame) -> DataFrame:
    """cv, range and eta2 per channel, and whether the trace varies at all."""
    out = trace_cv(traces).join(smoothed_range(traces), "channel").join(diurnal_eta2(traces), "channel")
    rule = (
        (F.col("cv") >= FLAT_CV)
        | (F.col("range") >= PEAK_RANGE)
        | ((F.col("eta2") >= DIURNAL_ETA2) & (F.col("range") >= DIURNAL_MIN_RANGE))
    )
    return out.withColumn("varies", rule)


def log_traces(traces: DataFrame) -> DataFrame:
    """Add ``g`` = log10 of the positive points; others become null."""
    return traces.withColumn("g", F.log10(positive(F.col("y"))))


def diel_anomaly(logged: DataFrame, bins: int = DIEL_BINS, min_span: float = DIURNAL_SPAN_H) -> DataFrame:
    """Add ``a``: g minus the channel's own hour-of-day mean (or plain mean on a short run)."""
    span = F.broadcast(
        logged.agg((F.max("hours") - F.min("hours")).alias("span")).withColumn("one", F.lit(1))
    )
    hb = F.floor(F.pmod(F.col("hours"), F.lit(24.0)) / F.lit(24.0 / bins))
    rows = logged.withColumn("one", F.lit(1)).join(span, "one").withColumn(
        "hb", F.when(F.col("span") >= min_span, hb).otherwise(F.lit(-1))
    )
    prof = rows.groupBy("channel", "hb").agg(F.avg("g").alias("mean_g"))
    return rows.join(prof, ["channel", "hb"]).withColumn("a", F.col("g") - F.col("mean_g")).drop(
        "one", "span", "hb", "mean_g"
    )


def common_mode(anomaly: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """Median anomaly per time point over the reference channels: ``(t, cm)``."""
    rows = anomaly if reference is None else anomaly.join(reference, "channel", "left_semi")
    return exact_quantiles(rows, ["t"], "a", {"cm": 0.5})


def residualise(anomaly: DataFrame, mode: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Least-squares removal of the common mode per channel: residual rows and R2 per channel."""
    rows = anomaly.join(mode, "t", "left")
    a, cm = F.col("a"), F.col("cm")
    both = a.isNotNull() & cm.isNotNull()
    fit = rows.groupBy("channel").agg(
        F.count_if(both).alias("n"),
        slope(cm, a).alias("b"),
        F.avg(F.when(both, cm)).alias("mx"),
        F.avg(F.when(both, a)).alias("my"),
        F.var_pop(F.when(both, a)).alias("vy"),
        F.var_pop(F.when(both, cm)).alias("vx"),
        F.avg(a).alias("mean_a"),
    )
    usable = (F.col("n") >= MIN_POINTS) & (F.col("vx") > 0)
    fitted = rows.join(fit, "channel")
    resid = F.when(
        usable, a - (F.col("my") + F.col("b") * (cm - F.col("mx")))
    ).otherwise(a - F.col("mean_a"))
    r2 = F.when(
        usable & (F.col("vy") > 0),
        F.greatest(F.lit(0.0), F.col("b") * F.col("b") * F.col("vx") / F.col("vy")),
    ).otherwise(0.0)
    return (
        fitted.select("channel", "t", "hours", resid.alias("r")),
        fit.select("channel", r2.alias("r2")),
    )


def decompose(traces: DataFrame, reference: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Log, diel anomaly, common mode, residual: ``(residual rows, R2, mode)``."""
    anomaly = cut_lineage(diel_anomaly(log_traces(traces)).select("channel", "t", "hours", "a"))
    mode = cut_lineage(common_mode(anomaly, reference))
    resid, r2 = residualise(anomaly, mode)
    return resid, r2, mode


def pairwise_r(
    rows: DataFrame, value: str, min_points: int = MIN_POINTS, key: str = "channel",
    block_channels: int = 256, block_points: int = 4096, least_r: float | None = None,
) -> DataFrame:
    """Pearson r of every channel pair over shared time points: ``(a, b, r, n)``, a < b.

    The pairs are the result, so gate the channels first, or ask only for those of at least ``least_r``. Channels are dealt into
    blocks and every pair of blocks is one small matrix product per stretch of
    the time axis; rows are copied once per block, not once per partner, and the
    partial sums add up map-side.
    """
    usable = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("ch"), "t", F.col(value).cast("double").alias("v"))
    n_channels = usable.select("ch").distinct().count()
    n_blocks = max(1, -(-n_channels // block_channels))
    kind = dict(usable.dtypes)["ch"]
    # r does not change when a channel is shifted; centring keeps the sums accurate.
    mean = usable.groupBy("ch").agg(F.avg("v").alias("m"))
    centred = usable.join(mean, "ch").select(
        "ch", "t", (F.col("v") - F.col("m")).alias("v"),
        F.pmod(F.xxhash64("ch"), F.lit(n_blocks)).cast("int").alias("blk"),
        F.floor(F.col("t") / block_points).cast("long").alias("tc"),
    )
    other = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    dealt = centred.withColumn("o", other).select(
        "ch", "t", "v", "tc", F.least("blk", "o").alias("p"), F.greatest("blk", "o").alias("q"),
        (F.col("blk") <= F.col("o")).alias("first"), (F.col("blk") >= F.col("o")).alias("second"),
    )

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = pdf[pdf["first"]], pdf[pdf["second"]]
        if one.empty or two.empty:
            return pd.DataFrame(columns=["a", "b", "n", "sx", "sy", "sxx", "syy", "sxy"])
        times = np.unique(pdf["t"].to_numpy())

        def dense(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            names, row = np.unique(part["ch"].to_numpy(), return_inverse=True)
            x = np.zeros((len(names), len(times)))
            seen = np.zeros_like(x)
            col = np.searchsorted(times, part["t"].to_numpy())
            x[row, col] = part["v"].to_numpy()
            seen[row, col] = 1.0
            return names, x, seen

        na, xa, ma = dense(one)
        nb, xb, mb = dense(two)
        ia, ib = np.nonzero(na[:, None] < nb[None, :])
        # A channel of the later block may sort before one of the earlier block.
        ja, jb = np.nonzero(na[:, None] > nb[None, :]) if pdf["p"].iat[0] != pdf["q"].iat[0] else (ia[:0], ib[:0])
        table = {
            "n": ma @ mb.T, "sx": xa @ mb.T, "sy": ma @ xb.T,
            "sxx": (xa * xa) @ mb.T, "syy": ma @ (xb * xb).T, "sxy": xa @ xb.T,
        }
        straight = pd.DataFrame({"a": na[ia], "b": nb[ib], **{k: m[ia, ib] for k, m in table.items()}})
        swap = {"n": "n", "sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx", "sxy": "sxy"}
        turned = pd.DataFrame({"a": nb[jb], "b": na[ja], **{k: table[swap[k]][ja, jb] for k in table}})
        out = pd.concat([straight, turned], ignore_index=True)
        return out[out["n"] > 0]

    schema = f"a {kind}, b {kind}, n double, sx double, sy double, sxx double, syy double, sxy double"
    sums = dealt.groupBy("p", "q", "tc").applyInPandas(products, schema).groupBy("a", "b").agg(
        *[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]
    )
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / n
    vy = F.col("syy") - F.col("sy") * F.col("sy") / n
    flat = 1e-12
    r = F.when((vx > flat * F.col("sxx")) & (vy > flat * F.col("syy")), cov / F.sqrt(vx * vy))
    pairs = sums.where(n >= min_points).select("a", "b", r.alias("r"), n.cast("long").alias("n"))
    return pairs if least_r is None else pairs.where(F.col("r") >= least_r)


def reference_r(rows: DataFrame, value: str, members: DataFrame) -> DataFrame:
    """r of every channel against the mean z-score of a reference family.

    ``members``: the family's channels. Output ``(channel, r)``.
    """
    fam = rows.join(members, "channel", "left_semi").where(F.col(value).isNotNull())
    scale = fam.groupBy("channel").agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    z = fam.join(scale, "channel").withColumn(
        "z", F.try_divide(F.col(value) - F.col("_m"), F.nullif(F.col("_s"), F.lit(0.0)))
    )
    ref = z.groupBy("t").agg(F.avg("z").alias("ref"))
    return rows.join(ref, "t").groupBy("channel").agg(pair_r(F.col(value), F.col("ref")).alias("r"))


def longest_run(traces: DataFrame) -> DataFrame:
    """Longest run of consecutive positive points per channel (every time point present)."""
    by_t = Window.partitionBy("channel").orderBy("t")
    on = F.coalesce(F.col("y") > 0, F.lit(False))
    runs = traces.where(on).withColumn("grp", F.col("t") - F.row_number().over(by_t))
    best = runs.groupBy("channel", "grp").agg(F.count(F.lit(1)).alias("n")).groupBy("channel").agg(
        F.max("n").alias("run")
    )
    return traces.select("channel").distinct().join(best, "channel", "left").select(
        "channel", F.coalesce("run", F.lit(0)).alias("run")
    )


def ends(traces: DataFrame, value: str, key: str = "channel", head: int = 6) -> DataFrame:
    """Mean of the first and last points and the shape they make: rise, fall or peak."""
    last = F.max("t").over(Window.partitionBy(key))
    sized = traces.withColumn("_last", last)
    out = sized.groupBy(key).agg(
        F.avg(F.when(F.col("t") < head, F.col(value))).alias("start"),
        F.avg(F.when(F.col("t") > F.col("_last") - head, F.col(value))).alias("end"),
    )
    shape = (
        F.when(F.col("end") - F.col("start") > 0.5, "rise")
        .when(F.col("start") - F.col("end") > 0.5, "fall")
        .otherwise("peak")
    )
    return out.withColumn("shape", shape)


def starts_high(traces: DataFrame, key: str = "channel", w: int = SMOOTH_W) -> DataFrame:
    """Mean of the first twentieth of the smoothed trace over its peak."""
    s = smoothed(traces, w, key).withColumn("_n", F.max("t").over(Window.partitionBy(key)) + 1)
    head = F.col("t") < F.greatest(F.lit(1), F.floor(F.col("_n") / 20))
    out = s.groupBy(key).agg(
        F.count_if(F.col("s") > 0).alias("_p"),
        F.avg(F.when(head, F.col("s"))).alias("_h"),
        F.max(positive(F.col("s"))).alias("_top"),
    )
    return out.select(
        key,
        F.when(F.col("_p") >= MIN_POINTS, F.coalesce(F.try_divide(F.col("_h"), F.col("_top")), F.lit(0.0)))
        .otherwise(0.0)
        .alias("starts_high"),
    )


def settle_trim(traces: DataFrame, key: str = "channel", share: float = SETTLE_FRAC) -> DataFrame:
    """Drop the leading share of the time points, if enough of them remain; ``t`` restarts at 0."""
    n = F.max("t").over(Window.partitionBy(key)) + 1
    cut = F.floor(n * F.lit(share))
    k = F.when(n - cut >= MIN_POINTS, cut).otherwise(0)
    return traces.withColumn("_k", k).where(F.col("t") >= F.col("_k")).withColumn(
        "t", F.col("t") - F.col("_k")
    ).drop("_k")


def big_changers(
    traces: DataFrame, fold_min: float = 3.0, fold_bright: float = 2.0, bright: float = 1000.0
) -> DataFrame:
    """Channels whose smoothed peak is several times their low baseline: fold and peak time."""
    s = cut_lineage(smoothed(traces, 2).select("channel", "t", "hours", "s"))
    pos = s.where(F.col("s") > 0)
    base = exact_quantiles(pos, ["channel"], "s", {"base": 0.1})
    med = exact_quantiles(traces, ["channel"], "y", {"median": 0.5})
    top = s.groupBy("channel").agg(
        F.count_if(F.col("s") > 0).alias("n_pos"),
        F.max("s").alias("top"),
        F.min_by("hours", F.struct(-F.col("s"), F.col("t"))).alias("peak_hour"),
    )
    out = top.join(base, "channel").join(med, "channel", "left").withColumn(
        "fold", F.when(F.col("base") > 0, F.col("top") / F.col("base")).otherwise(0.0)
    )
    need = F.when(F.coalesce("median", F.lit(0.0)) >= bright, fold_bright).otherwise(fold_min)
    return out.where((F.col("n_pos") >= MIN_POINTS) & (F.col("fold") >= need)).select(
        "channel", "fold", "peak_hour"
    )


def dynamics(traces: DataFrame, changing_cv: float = FLAT_CV) -> DataFrame:
    """Median, population cv and the changing flag per channel."""
    med = exact_quantiles(traces, ["channel"], "y", {"median_cps": 0.5})
    cv = traces.groupBy("channel").agg(cv_pop(F.col("y")).alias("cv"), F.avg("y").alias("_m"))
    return cv.join(med, "channel", "left").select(
        "channel",
        F.coalesce("median_cps", F.lit(0.0)).alias("median_cps"),
        F.when(F.col("_m") > 0, F.col("cv")).alias("cv"),
        F.coalesce((F.col("_m") > 0) & (F.col("cv") >= changing_cv), F.lit(False)).alias("changing"),
    )


def panel_median(traces: DataFrame, families: DataFrame) -> DataFrame:
    """Median trace per family with non-detections filled at the family's floor.

    ``traces`` holds every time point; ``families``: ``(channel, cluster)``.
    """
    rows = traces.join(families, "channel")
    floor = rows.groupBy("cluster").agg(F.min(positive(F.col("y"))).alias("floor"))
    filled = rows.join(floor, "cluster").withColumn("v", F.coalesce("y", "floor", F.lit(1.0)))
    return exact_quantiles(filled, ["cluster", "t"], "v", {"panel": 0.5})


def hour_profiles(
    traces: DataFrame, start_hour: float = 0.0, min_detect: int = 80, keys: Sequence[str] = ("channel",)
) -> DataFrame:
    """24-point hour-of-day profile per channel over its own mean: ``(*keys, h, p)``.

    Log medians per hour; empty hours are interpolated between their neighbours
    and held at the ends.
    """
    keys = list(keys)
    pos = traces.where(F.col("y") > 0)
    enough = pos.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_detect)
    rows = pos.join(enough, keys, "left_semi").select(
        *keys, F.floor(F.pmod(F.col("hours") + F.lit(start_hour), F.lit(24.0))).alias("h"), F.log10("y").alias("g")
    )
    med = exact_quantiles(rows, [*keys, "h"], "g", {"m": 0.5})
    full = enough.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("h")).join(
        med, [*keys, "h"], "left"
    )
    before = Window.partitionBy(*keys).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy("h").rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("m").isNotNull(), F.struct("h", "m"))
    full = full.withColumn("lo", F.last(at, True).over(before)).withColumn("hi", F.first(at, True).over(after))
    gap = F.nullif(F.col("hi.h") - F.col("lo.h"), F.lit(0))
    share = F.try_divide(F.col("h") - F.col("lo.h"), gap)
    level = (
        F.when(F.col("lo").isNull(), F.col("hi.m"))
        .when(F.col("hi").isNull(), F.col("lo.m"))
        .otherwise(F.col("lo.m") + (F.col("hi.m") - F.col("lo.m")) * F.coalesce(share, F.lit(0.0)))
    )
    lin = full.withColumn("lin", F.pow(F.lit(10.0), level))
    return lin.select(*keys, "h", (F.col("lin") / F.avg("lin").over(Window.partitionBy(*keys))).alias("p"))


def peak_hours(profiles: DataFrame, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Amplitude-weighted circular mean hour of each profile."""
    keys = list(keys)
    low = F.min("p").over(Window.partitionBy(*keys))
    angle = F.col("h") * F.lit(2.0) * F.pi() / F.lit(24.0)
    sums = profiles.withColumn("w", F.col("p") - low).groupBy(*keys).agg(
        F.sum(F.col("w") * F.sin(angle)).alias("sy"), F.sum(F.col("w") * F.cos(angle)).alias("sx")
    )
    turn = F.lit(2.0) * F.pi()
    return sums.select(*keys, (F.pmod(F.atan2("sy", "sx"), turn) * 24.0 / turn).alias("peak_hour"))


def class_profiles(profiles: DataFrame, classes: DataFrame) -> DataFrame:
    """Median profile of each class: ``(cls, h, profile, n)``. ``classes``: ``(channel, cls)``."""
    rows = profiles.join(classes, "channel")
    counts = rows.groupBy("cls", "h").agg(F.count("p").alias("n"))
    return exact_quantiles(rows, ["cls", "h"], "p", {"profile": 0.5}).join(counts, ["cls", "h"])


def family_gain(traces: DataFrame, families: DataFrame) -> DataFrame:
    """Slope of each member's log trace on its family's mean log trace."""
    rows = log_traces(traces).join(families, "channel")
    mean = rows.groupBy("cluster", "t").agg(F.avg("g").alias("fam"))
    joined = rows.join(mean, ["cluster", "t"])
    return (
        joined.groupBy("cluster", "channel")
        .agg(slope(F.col("fam"), F.col("g")).alias("gain"), F.count_if(F.col("g").isNotNull()).alias("n"))
        .where((F.col("n") >= MIN_POINTS) & F.col("gain").isNotNull())
        .drop("n")
    )


def family_mean(traces: DataFrame, families: DataFrame) -> DataFrame:
    """Mean positive trace per family at every time point: ``(cluster, t, hours, y)``."""
    return (
        traces.join(families, "channel")
        .groupBy("cluster", "t", "hours")
        .agg(F.avg(positive(F.col("y"))).alias("y"))
    )
