"""Summary tables of ledgers and merged ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions import formula as fx
from ionloom.functions.quantiles import exact_quantiles
from ionloom.operators import axis

PEAK = ["sample_item_id", "peak_id"]


def norm_tier(tier: Column) -> Column:
    """Assigned or Candidate (an older spelling included), else null."""
    t = F.trim(tier)
    return F.when(t.isin("Assigned", "Identified"), "Assigned").when(t == "Candidate", "Candidate")


def _owners(ledger: DataFrame, *cols: str) -> DataFrame:
    return ledger.where("role = 'M0'").select(
        F.col("sample_item_id").alias("_s"), F.col("peak_id").alias("_p"), *[F.col(c).alias(f"parent_{c}") for c in cols]
    )


def _with_parent(children: DataFrame, ledger: DataFrame, *cols: str) -> DataFrame:
    on = (F.col("sample_item_id") == F.col("_s")) & (F.col("parent_peak_id") == F.col("_p"))
    return children.join(_owners(ledger, *cols), on, "left").drop("_s", "_p")


def split_categories(ledger: DataFrame) -> DataFrame:
    """Owners, satellites and the unexplained by tier, with the mass defect."""
    kids = _with_parent(ledger.where("role = 'iso_child'"), ledger, "tier").select(
        *PEAK, "mz", F.lit("iso").alias("kind"), norm_tier(F.col("parent_tier")).alias("t")
    )
    rest = ledger.where(F.col("role").isin("M0", "unexplained")).select(
        *PEAK, "mz", F.when(F.col("role") == "M0", "parent").otherwise("unexplained").alias("kind"),
        norm_tier(F.col("tier")).alias("t"),
    )
    category = (
        F.when(F.col("kind") == "unexplained", "unexplained")
        .when(F.col("t") == "Assigned", F.concat(F.lit("assigned_"), "kind"))
        .when(F.col("t") == "Candidate", F.concat(F.lit("cand_"), "kind"))
    )
    return rest.unionByName(kids).select(
        *PEAK, "mz", fx.mass_defect(F.col("mz")).alias("md"), category.alias("category")
    ).where(F.col("category").isNotNull())


def ppm_points(ledger: DataFrame) -> DataFrame:
    """Mass errors of the tiered owners; the calibrated error if the ledger has any."""
    m0 = ledger.where("role = 'M0'")
    has_cal = F.broadcast(
        ledger.agg(F.coalesce(F.bool_or(F.col("ppm_error_cal").isNotNull()), F.lit(False)).alias("cal")).withColumn("one", F.lit(1))
    )
    return (
        m0.withColumn("one", F.lit(1)).join(has_cal, "one")
        .select(
            *PEAK, "mz",
            F.when(F.col("cal"), F.col("ppm_error_cal")).otherwise(F.col("ppm_error")).alias("ppm_error"),
            norm_tier(F.col("tier")).alias("tier"),
        )
        .where(F.col("ppm_error").isNotNull() & F.col("tier").isNotNull())
    )


def plot_points(ledger: DataFrame) -> DataFrame:
    """Rounded position, decibel height and category (0 assigned, 1 candidate, 2 unexplained)."""
    conf = F.coalesce("confidence", F.lit(""))
    by_conf = F.when(conf.startswith("High") | conf.startswith("Good"), 0).otherwise(1)
    tier = F.trim("tier")
    cat = F.when(
        F.col("role") == "M0",
        F.when(F.coalesce(tier, F.lit("")) != "", F.when(tier == "Assigned", 0).otherwise(1)).otherwise(by_conf),
    ).when(F.col("role") == "unexplained", 2)
    h = F.greatest(F.coalesce(F.nullif("height", F.lit(0.0)), F.lit(1.0)), F.lit(1.0))
    return (
        ledger.where(~F.coalesce("synthetic", F.lit(False)))
        .select(F.bround("mz", 4).alias("mz"), F.rint(F.log10(h) * 10).cast("long").alias("db"), cat.cast("long").alias("category"))
        .where(F.col("category").isNotNull())
    )


def by_class(ledger: DataFrame) -> DataFrame:
    """Owners per backbone class and heteroatom tags."""
    el = F.col("el")
    tags = F.concat_ws("+", *[F.when(el[e] > 0, F.lit(e)) for e in ("Br", "Cl", "F", "I", "P", "Si")])
    m0 = ledger.where("role = 'M0'").withColumn("el", fx.counts(F.col("neutral_formula")))
    return (
        m0.groupBy(fx.backbone(el).alias("compound_class"), tags.alias("heteroatoms"))
        .agg(
            F.count(F.lit(1)).alias("n_peaks"),
            F.count_if(F.col("tier") == "Assigned").alias("n_identified"),
            F.count_if(~F.coalesce(F.col("tier") == "Assigned", F.lit(False))).alias("n_candidates"),
            F.sum("height").alias("signal"),
        )
    )


def unique_formulas(ledger: DataFrame) -> DataFrame:
    """One row per neutral over its channels."""
    return (
        ledger.where("role = 'M0'")
        .groupBy("neutral_formula")
        .agg(
            F.count(F.lit(1)).alias("n_peaks"),
            F.array_join(F.array_sort(F.collect_set("adduct")), "; ").alias("adducts"),
            F.bool_or(F.col("tier") == "Assigned").alias("a"),
            F.max("ion_score").alias("best_score"),
            F.sum("height").alias("signal"),
        )
        .withColumn("best_tier", F.when(F.col("a"), "Assigned").otherwise("Candidate"))
        .drop("a")
    )


def isotopologue_sheet(ledger: DataFrame) -> DataFrame:
    """Satellites with the formula, form and position of their parent."""
    kids = ledger.where("role = 'iso_child'").select(*PEAK, "mz", "height", "iso_label", "iso_match_score", "parent_peak_id")
    return _with_parent(kids, ledger, "neutral_formula", "adduct", "mz")


def summary_stats(stats: DataFrame, ledger: DataFrame) -> DataFrame:
    """Long (section, metric, value) out of the per-role statistics and the owners."""
    text = F.col
    coverage = stats.select(
        F.lit("Coverage").alias("section"), text("role").alias("metric"),
        F.format_string("%d (%.1f%% of peaks, %.1f%% of signal)", "n_peaks", F.col("count_share") * 100, F.col("signal_share") * 100).alias("value"),
    )
    total = stats.agg(F.sum("n_peaks").alias("n")).select(
        F.lit("Run").alias("section"), F.lit("peaks total").alias("metric"), F.col("n").cast("string").alias("value")
    )
    m0 = ledger.where("role = 'M0'")
    def counted(section: str, col: Column) -> DataFrame:
        return m0.groupBy(col.alias("metric")).agg(F.count(F.lit(1)).alias("n")).where(F.col("metric").isNotNull()).select(
            F.lit(section).alias("section"), "metric", F.col("n").cast("string").alias("value")
        )
    grade = F.regexp_extract("confidence", r"^(\w+)", 1)
    return (
        total.unionByName(coverage)
        .unionByName(counted("Tiers", F.col("tier")))
        .unionByName(counted("Confidence", grade))
        .unionByName(counted("Methods", F.col("method")))
    )


def analyte_table(ledger: DataFrame, exclude_silicon: bool = True) -> DataFrame:
    """One row per carbon-bearing neutral: its best row, ratios, class and channels.

    Channels keep the order in which they are first met along the axis; a neutral
    has as many as there are ion forms.
    """
    m0 = ledger.where((F.col("role") == "M0") & (F.coalesce("neutral_formula", F.lit("")) != "")).withColumn(
        "el", fx.counts(F.col("neutral_formula"))
    )
    m0 = m0.where(F.col("el")["C"] > 0)
    if exclude_silicon:
        m0 = m0.where(F.col("el")["Si"] == 0)
    rank = F.when(F.col("tier") == "Assigned", 0).when(F.col("tier") == "Candidate", 1).otherwise(2)
    place = F.struct("mz", "peak_id")
    first_seen = m0.groupBy("neutral_formula", "adduct").agg(F.min(place).alias("at"))
    channels = first_seen.groupBy("neutral_formula").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("at", "adduct"))), lambda e: e["adduct"]), " / "
        ).alias("channels")
    )
    best = m0.groupBy("neutral_formula").agg(
        F.min(F.struct(rank.alias("r"), F.col("mz").alias("mz"), F.col("peak_id").alias("peak_id"), F.col("tier").alias("tier"))).alias("b"),
        F.first("el").alias("el"),
    )
    el = F.col("el")
    return best.join(channels, "neutral_formula").select(
        "neutral_formula", F.col("b.peak_id").alias("peak_id"), F.col("b.mz").alias("mz"), F.col("b.tier").alias("tier"),
        el["C"].alias("nC"), el["H"].alias("nH"), el["O"].alias("nO"), el["N"].alias("nN"), el["S"].alias("nS"),
        (el["H"] / el["C"]).alias("hc"), (el["O"] / el["C"]).alias("oc"), fx.backbone(el).alias("klass"), "channels",
    )


def neutral_signal(ledger: DataFrame) -> DataFrame:
    return ledger.where("role = 'M0'").groupBy("neutral_formula").agg(F.sum("height").alias("signal"))


def signal_by_backbone(signal: DataFrame) -> DataFrame:
    """Neutral count and share of signal per backbone class."""
    per = signal.groupBy(fx.backbone(fx.counts(F.col("neutral_formula"))).alias("klass")).agg(
        F.count(F.lit(1)).alias("n_neutrals"), F.sum("signal").alias("signal")
    )
    total = F.sum("signal").over(Window.partitionBy(F.lit(0)))
    return per.withColumn("share", F.try_divide("signal", F.nullif(total, F.lit(0.0))))


def shadowed_amines(neutrals: DataFrame) -> DataFrame:
    """Nitrogen-bearing neutrals whose partner one ammonia lighter is present too."""
    return _shadowed(fx.parsed(neutrals, "neutral_formula"))


def _shadowed(distinct: DataFrame) -> DataFrame:
    keyed = distinct.select(fx.text(F.col("el")).alias("twin")).distinct()
    lighter = distinct.where(F.col("el")["N"] >= 1).withColumn("twin", fx.text(fx.minus_nh3(F.col("el"))))
    return lighter.join(keyed, "twin", "left_semi").select("neutral_formula", "twin")


def collapsed_composition(neutrals: DataFrame) -> DataFrame:
    """Class counts as assigned and after folding shadowed amines into their twins."""
    distinct = fx.parsed(neutrals, "neutral_formula")
    klass = fx.backbone(F.col("el")).alias("klass")
    all_n = distinct.groupBy(klass).agg(F.count(F.lit(1)).alias("as_assigned"))
    gone = _shadowed(distinct).join(distinct, "neutral_formula").groupBy(klass).agg(F.count(F.lit(1)).alias("dropped"))
    return all_n.join(gone, "klass", "left").select(
        "klass", "as_assigned", (F.col("as_assigned") - F.coalesce("dropped", F.lit(0))).alias("collapsed")
    )


def top_species(signal: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` neutrals of greatest signal with their share of it."""
    total = F.broadcast(signal.agg(F.sum("signal").alias("all")).withColumn("one", F.lit(1)))
    return (
        signal.orderBy(F.desc("signal"), "neutral_formula").limit(n).withColumn("one", F.lit(1)).join(total, "one")
        .select("neutral_formula", "signal", F.try_divide("signal", "all").alias("frac"),
                fx.backbone(fx.counts(F.col("neutral_formula"))).alias("klass"))
    )


def oligomers(neutrals: DataFrame, c_min: int = 18, c_max: int = 40, o_min: int = 7) -> DataFrame:
    """Neutrals of high carbon and oxygen, without silicon."""
    el = F.col("el")
    return (
        neutrals.select("neutral_formula").distinct().withColumn("el", fx.counts(F.col("neutral_formula")))
        .where(el["C"].between(c_min, c_max) & (el["O"] >= o_min) & (el["Si"] == 0))
        .select("neutral_formula", el["C"].alias("nC"), el["O"].alias("nO"))
        .orderBy(F.desc("nC"), F.desc("nO"), "neutral_formula")
    )


def run_rollups(ledger: DataFrame) -> DataFrame:
    """Counts, signal and mean score by role, tier and ion form in one long table."""
    m0 = F.col("role") == "M0"
    spread = ledger.select(
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("role").alias("grouping"), F.col("role").alias("name")),
                    F.struct(F.lit("tier").alias("grouping"), F.when(m0, F.col("tier")).alias("name")),
                    F.struct(F.lit("adduct").alias("grouping"), F.when(m0, F.col("adduct")).alias("name")),
                ),
                lambda g: g["name"].isNotNull(),
            )
        ).alias("g"),
        "height", "ion_score",
    )
    per = spread.groupBy("g.grouping", "g.name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("height").alias("signal"), F.avg("ion_score").alias("mean_score")
    )
    return per.withColumn("share", F.try_divide("signal", F.sum("signal").over(Window.partitionBy("grouping"))))


def channel_rollup(ledger: DataFrame) -> DataFrame:
    """Per (neutral, channel): greatest height, files seen and the satellite labels found."""
    kids = isotopologue_sheet(ledger).where(F.col("parent_neutral_formula").isNotNull())
    iso = kids.groupBy(
        F.col("parent_neutral_formula").alias("neutral_formula"), F.col("parent_adduct").alias("adduct")
    ).agg(F.array_join(F.array_sort(F.collect_set("iso_label")), ", ").alias("isotopes"))
    per = ledger.where("role = 'M0'").groupBy("neutral_formula", "adduct").agg(
        F.max("height").alias("max_height"), F.count_distinct("src").alias("n_files"), F.avg("mz").alias("mz")
    )
    return per.join(iso, ["neutral_formula", "adduct"], "left")


def appendix(ledger: DataFrame) -> DataFrame:
    """Every (neutral, channel) in order of neutral mass and position."""
    return (
        channel_rollup(ledger)
        .withColumn("mass", fx.mass(fx.counts(F.col("neutral_formula"))))
        .orderBy("mass", "neutral_formula", "mz")
    )


def channels_per_neutral(ledger: DataFrame) -> DataFrame:
    return ledger.where("role = 'M0'").groupBy("neutral_formula").agg(
        F.count_distinct("adduct").alias("n_channels"),
        F.array_join(F.array_sort(F.collect_set("adduct")), ",").alias("adducts"),
    )


def best_evidence(ledger: DataFrame, polarity: str | None = None) -> DataFrame:
    """Per neutral: its row of least mass error, satellite count, margin, first plausible alternative.

    ``alternatives`` is an array of structs with ``formula`` and ``ppm``.
    """
    from ionloom.operators.rules import implausible

    kids = ledger.where("role = 'iso_child'").groupBy(
        "sample_item_id", F.col("parent_peak_id").alias("peak_id")
    ).agg(F.count(F.lit(1)).alias("iso"))
    m0 = ledger.where("role = 'M0'").join(kids, PEAK, "left")
    picked = m0.groupBy("neutral_formula").agg(
        F.min_by(
            F.struct("ppm_error", F.coalesce("iso", F.lit(0)).alias("iso"), "eff_margin", "alternatives"),
            F.struct(F.coalesce(F.abs("ppm_error"), F.lit(float("inf"))), F.col("peak_id")),
        ).alias("b")
    )
    sane = F.filter("b.alternatives", lambda a: implausible(fx.counts(a["formula"]), polarity).isNull())
    return picked.select(
        "neutral_formula", F.col("b.ppm_error").alias("ppm"), F.col("b.iso").alias("iso"),
        F.col("b.eff_margin").alias("margin"), F.try_element_at(sane, F.lit(1))["formula"].alias("sane_alt"),
    )


def drift_trend(points: DataFrame) -> DataFrame:
    """Line through mass error over position; null without spread."""
    med = exact_quantiles(points, [], "ppm_error", {"median": 0.5}).withColumn("one", F.lit(1))
    fit = points.agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("mz").alias("vx"), F.covar_pop("mz", "ppm_error").alias("cxy"),
        F.avg("mz").alias("mx"), F.avg("ppm_error").alias("my"),
    ).withColumn("one", F.lit(1))
    slope = F.when((F.col("n") >= 2) & (F.col("vx") > 0), F.col("cxy") / F.col("vx"))
    return fit.join(med, "one").select(
        "n", slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), "median"
    )


def event_fold(totals: DataFrame) -> DataFrame:
    """Peak of the total signal over the median of the last third, and when.

    ``totals``: ``(sample_item_id, t, hours, total)`` with ``t`` counting samples.
    """
    n = F.broadcast(totals.agg(F.max("t").alias("last")).withColumn("one", F.lit(1)))
    rows = totals.withColumn("one", F.lit(1)).join(n, "one")
    tail = rows.where(F.col("t") >= F.greatest(F.lit(1), F.floor((F.col("last") + 1) * 2 / 3)))
    base = exact_quantiles(tail, [], "total", {"base": 0.5}).withColumn("one", F.lit(1))
    top = rows.agg(
        F.max("total").alias("peak"), F.min_by("hours", F.struct(-F.col("total"), F.col("t"))).alias("peak_hour")
    ).withColumn("one", F.lit(1))
    return top.join(base, "one").select("peak", "base", "peak_hour", F.try_divide("peak", "base").alias("fold"))


def family_rollup(members: DataFrame) -> DataFrame:
    """Per family: size, median O/C and its four brightest distinct neutrals.

    ``members``: ``(cluster, neutral_formula, median)``.
    """
    best = members.groupBy("cluster", "neutral_formula").agg(F.max("median").alias("m"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("m"), "neutral_formula"))
    top = best.withColumn("k", place).where("k <= 4").groupBy("cluster").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "neutral_formula"))), lambda e: e["neutral_formula"]), ", ").alias("brightest")
    )
    el = F.col("el")
    oc = members.withColumn("el", fx.counts(F.col("neutral_formula"))).where(el["C"] > 0).withColumn("oc", el["O"] / el["C"])
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(exact_quantiles(oc, ["cluster"], "oc", {"median_oc": 0.5}), "cluster", "left").join(top, "cluster")


def isotopologue_error(ledger: DataFrame, step: float = 1.0033548, tol_ppm: float = 6.0, sample: str = "sample_item_id") -> DataFrame:
    """Mass error of each owner's 13C satellite; the neighbour below is tried first."""
    kids = ledger.where("role = 'iso_child'").select(sample, F.col("mz").alias("kid_mz"))
    near = axis.neighbourhoods(kids, axis.relative_cell(F.col("kid_mz"), tol_ppm, 1.01), ["kid_mz"], [sample])
    target = F.col("mz") + step
    inside = F.filter("near", lambda e: F.abs(e["kid_mz"] - target) / target * 1e6 <= tol_ppm)
    below = F.array_max(F.filter(inside, lambda e: e["kid_mz"] < target))
    above = F.array_min(F.filter(inside, lambda e: e["kid_mz"] >= target))
    return (
        ledger.where("role = 'M0'")
        .withColumn("cell", axis.relative_cell(target, tol_ppm, 1.01))
        .join(near, [sample, "cell"])
        .withColumn("hit", F.coalesce(below, above))
        .where(F.col("hit").isNotNull())
        .select(sample, "peak_id", ((F.col("hit.kid_mz") - target) / target * 1e6).alias("ppm"))
    )


def error_quartiles(ledger: DataFrame) -> DataFrame:
    """Quartiles of the mass error per tier and for the satellites."""
    rows = ledger.where("role = 'M0'").select(F.col("tier").alias("category"), F.col("ppm_error").alias("ppm")).where(
        F.col("category").isin("Assigned", "Candidate")
    ).unionByName(isotopologue_error(ledger).select(F.lit("isotopologue").alias("category"), "ppm"))
    return exact_quantiles(rows, ["category"], "ppm", {"q1": 0.25, "q2": 0.5, "q3": 0.75})


def candidate_rows(candidates: DataFrame) -> DataFrame:
    """Candidate peaks as ranked rows: the winner first, then its stored alternatives."""
    own = candidates.select(
        *PEAK, "mz", "height", F.lit(1).alias("rank"), F.col("neutral_formula").alias("formula"), "adduct",
        F.col("raw_score").alias("score"), "eff_score", "ppm_error",
    )
    alts = candidates.select(*PEAK, "mz", "height", F.posexplode("alternatives").alias("k", "a")).select(
        *PEAK, "mz", "height", (F.col("k") + 2).alias("rank"), F.col("a.formula").alias("formula"), F.col("a.adduct").alias("adduct"),
        F.col("a.raw_score").alias("score"), F.col("a.eff_score").alias("eff_score"), F.col("a.ppm").alias("ppm_error"),
    )
    return own.unionByName(alts).orderBy(F.desc("height"), "mz", "rank")


def explained_share(cells: DataFrame, bins: DataFrame, explained: DataFrame, tol_ppm: float = 8.0) -> DataFrame:
    """How many bins, and how much signal, lie next to an explained position.

    ``explained``: ``(mz)``. Positions collapse per cell first.
    """
    lib = explained.select(F.col("mz").alias("x")).distinct()
    hit = axis.band_join(
        bins.select("bin", "bin_mz"), lib, F.col("bin_mz"), F.col("x"), tol_ppm,
        F.abs(F.col("x") - F.col("bin_mz")) / F.col("bin_mz") * 1e6 <= tol_ppm, how="left_semi",
    ).select("bin").withColumn("hit", F.lit(True))
    signal = cells.groupBy("bin").agg(F.sum("height").alias("s"))
    return signal.join(hit, "bin", "left").agg(
        F.count(F.lit(1)).alias("n_bins"), F.count_if(F.col("hit")).alias("n_explained"),
        F.sum(F.when(F.col("hit"), F.col("s")).otherwise(0.0)).alias("s_explained"), F.sum("s").alias("s_total"),
    )


def batch_maxima(cells: DataFrame, bins: DataFrame, channels: DataFrame, tol_ppm: float = 8.0) -> DataFrame:
    """Greatest height of each channel's nearest bin over all samples. ``channels``: ``(key, mz)``."""
    top = cells.groupBy("bin").agg(F.max("height").alias("max_height"))
    hit = axis.nearest(channels, bins, "mz", "bin_mz", ["bin"], tol_ppm=tol_ppm)
    return hit.where(F.col("hit").isNotNull()).select("key", F.col("hit.bin").alias("bin")).join(top, "bin").select(
        "key", "max_height"
    )
