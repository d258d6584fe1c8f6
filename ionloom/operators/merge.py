"""Cross-file consensus of per-file owners, and what two runs or scorers agree on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.functions.quantiles import exact_quantiles
from ionloom.operators import axis

MERGE_PPM = 6.0


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "Assigned", 2).when(tier == "Candidate", 1).otherwise(0)


def aligned_rows(owners: DataFrame, offsets: DataFrame | None = None, tol_ppm: float = MERGE_PPM) -> DataFrame:
    """Per-file rows with their offset-corrected position and its cluster.

    ``offsets``: ``(src, offset_ppm)``, one row per file.
    """
    rows = owners.where(F.col("mz").isNotNull())
    if offsets is None:
        rows = rows.withColumn("mz_adj", F.col("mz"))
    else:
        rows = rows.join(offsets, "src", "left").withColumn(
            "mz_adj", F.col("mz") * (1.0 - F.coalesce("offset_ppm", F.lit(0.0)) / 1e6)
        ).drop("offset_ppm")
    return axis.assign_bins(rows, "mz_adj", tol_ppm, out="cluster")


def merge_clusters(aligned: DataFrame) -> DataFrame:
    """One row per cluster: the formula with the broadest support and its best row.

    Rows collapse to (cluster, formula, file) first, so that a cluster holding a
    large share of all rows is combined before the shuffle.
    """
    r = tier_rank(F.col("tier"))
    per_file = aligned.groupBy("cluster", "neutral_formula", "src").agg(
        F.sum((r >= 2).cast("long")).alias("n_assigned"),
        F.max(r).alias("best_r"),
        F.max("ion_score").alias("best_score"),
        F.min(
            F.struct(
                (-r).alias("nr"), (-F.col("ion_score")).alias("ns"), "adduct", "tier", "ion_score"
            )
        ).alias("best"),
        F.count(F.lit(1)).alias("n"),
        F.sum("mz").alias("mz_sum"),
        F.sum("mz_adj").alias("adj_sum"),
        F.min("mz").alias("mz_lo"),
        F.max("mz").alias("mz_hi"),
        F.min("mz_adj").alias("adj_lo"),
        F.max("mz_adj").alias("adj_hi"),
    )
    sums = [F.sum(c).alias(c) for c in ("n", "mz_sum", "adj_sum")]
    lows = [F.min(c).alias(c) for c in ("mz_lo", "adj_lo")]
    highs = [F.max(c).alias(c) for c in ("mz_hi", "adj_hi")]
    support = per_file.groupBy("cluster", "neutral_formula").agg(
        F.sum("n_assigned").alias("n_assigned"),
        F.count(F.lit(1)).alias("n_files"),
        F.max("best_r").alias("best_r"),
        F.max("best_score").alias("best_score"),
        F.min("best").alias("best"),
    )
    winner = support.groupBy("cluster").agg(
        F.min(
            F.struct(
                -F.col("n_assigned"), -F.col("n_files"), -F.col("best_r"), -F.col("best_score"),
                F.col("neutral_formula").alias("neutral_formula"), F.col("best").alias("best"),
            )
        ).alias("w"),
        F.count("neutral_formula").alias("n_formulas"),
    )
    files = per_file.groupBy("cluster", "src").agg(*sums, *lows, *highs)
    whole = files.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.array_join(F.array_sort(F.collect_list("src")), ",").alias("srcs"),
        *sums, *lows, *highs,
    )

    def spread(lo: str, hi: str, total: str) -> Column:
        rel = (F.col(hi) - F.col(lo)) / (F.col(total) / F.col("n")) * 1e6
        return F.bround(F.when(F.col("n") > 1, rel).otherwise(0.0), 3)

    return whole.join(winner, "cluster").select(
        "cluster",
        (F.col("mz_sum") / F.col("n")).alias("mz"),
        F.col("w.neutral_formula").alias("neutral_formula"),
        F.col("w.best.adduct").alias("adduct"),
        F.col("w.best.tier").alias("tier"),
        F.col("w.best.ion_score").alias("ion_score"),
        "n_files",
        "srcs",
        (F.col("n_formulas") <= 1).alias("formula_agree"),
        spread("mz_lo", "mz_hi", "mz_sum").alias("mz_jitter_ppm_raw"),
        spread("adj_lo", "adj_hi", "adj_sum").alias("mz_jitter_ppm_caldj"),
    )


def jitter_rows(aligned: DataFrame) -> DataFrame:
    return aligned.select("cluster", "src", "mz", "neutral_formula", "adduct", "tier", "ion_score")


def file_offsets(rows: DataFrame) -> DataFrame:
    """Median mass error per file. ``rows`` carries ``src`` and ``ppm``."""
    return exact_quantiles(rows, ["src"], "ppm", {"offset_ppm": 0.5})


def jitter_by_formula(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """Spread of the mass error of one (formula, adduct) seen in two files or more."""
    resid = F.col("ppm") - F.coalesce("offset_ppm", F.lit(0.0))
    return (
        rows.join(offsets, "src", "left")
        .groupBy("neutral_formula", "adduct", "src")
        .agg(
            F.sum("mz").alias("mz_sum"), F.count(F.lit(1)).alias("n"),
            F.min("ppm").alias("p0"), F.max("ppm").alias("p1"),
            F.min(resid).alias("r0"), F.max(resid).alias("r1"),
            F.min("ion_score").alias("s0"), F.max("ion_score").alias("s1"),
            F.collect_set("tier").alias("tiers"),
        )
        .groupBy("neutral_formula", "adduct")
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            (F.sum("mz_sum") / F.sum("n")).alias("mz"),
            F.bround(F.max("p1") - F.min("p0"), 3).alias("mz_jitter_raw"),
            F.bround(F.max("r1") - F.min("r0"), 3).alias("mz_jitter_resid"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("tiers")))).alias("t"),
            F.bround(F.min("s0"), 3).alias("ion_score_min"),
            F.bround(F.max("s1"), 3).alias("ion_score_max"),
        )
        .where(F.col("n_files") >= 2)
        .select(
            "neutral_formula", "adduct", "n_files", "mz", "mz_jitter_raw", "mz_jitter_resid",
            F.array_join("t", ",").alias("tiers"), (F.size("t") == 1).alias("tier_stable"),
            "ion_score_min", "ion_score_max",
        )
    )


def formula_disagreements(aligned: DataFrame) -> DataFrame:
    """Clusters seen in two files or more, with the formulas they were given."""
    per = aligned.groupBy("cluster", "src", "neutral_formula").agg(
        F.sum("mz").alias("mz_sum"), F.count(F.lit(1)).alias("n")
    )
    sizes = per.groupBy("cluster").agg(
        (F.sum("mz_sum") / F.sum("n")).alias("mz"), F.count_distinct("src").alias("n_files")
    )
    forms = (
        per.where(F.col("neutral_formula").isNotNull())
        .select("cluster", "neutral_formula")
        .distinct()
        .groupBy("cluster")
        .agg(
            F.count(F.lit(1)).alias("n_formulas"),
            F.array_join(F.array_sort(F.collect_list("neutral_formula")), "; ").alias("formulas"),
        )
    )
    return (
        sizes.where(F.col("n_files") >= 2)
        .join(forms, "cluster", "left")
        .select("cluster", "mz", "n_files", "n_formulas", "formulas", (F.col("n_formulas") > 1).alias("disagree"))
    )


def jitter_summary(by_formula: DataFrame, disagreements: DataFrame, offsets: DataFrame) -> DataFrame:
    """One row of run-level jitter figures."""
    one = F.lit(1)
    qs = exact_quantiles(by_formula, [], "mz_jitter_raw", {"raw_median": 0.5, "raw_p95": 0.95})
    rs = exact_quantiles(by_formula, [], "mz_jitter_resid", {"resid_median": 0.5, "resid_p95": 0.95})
    shared = by_formula.agg(
        F.count(F.lit(1)).alias("shared_assignments"),
        F.count_if(~F.col("tier_stable")).alias("tier_unstable"),
    )
    dis = disagreements.agg(F.count_if("disagree").alias("formula_disagreements"))
    off = offsets.agg(F.bround(F.max("offset_ppm") - F.min("offset_ppm"), 3).alias("offset_spread_ppm"))
    out = shared.withColumn("one", one)
    for piece in (dis, off, qs, rs):
        out = out.join(piece.withColumn("one", one), "one")
    rounded = [F.bround(c, 3).alias(c) for c in ("raw_median", "raw_p95", "resid_median", "resid_p95")]
    return out.select(
        "shared_assignments", "tier_unstable", "formula_disagreements", "offset_spread_ppm", *rounded
    )


def estimate_offset(matches: DataFrame, keep_ppm: float = 10.0, min_n: int = 8) -> DataFrame:
    """Per sample, the median error of its own base matches, or null with too few of them."""
    near = matches.where(F.abs("ppm_error") <= keep_ppm)
    counts = matches.groupBy("sample_item_id").agg(F.count_if(F.abs("ppm_error") <= keep_ppm).alias("n"))
    med = exact_quantiles(near, ["sample_item_id"], "ppm_error", {"offset_ppm": 0.5})
    return counts.join(med, "sample_item_id", "left").select(
        "sample_item_id", "n", F.when(F.col("n") >= min_n, F.col("offset_ppm")).alias("offset_ppm")
    )


def run_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Key-wise comparison of two runs on (sample, peak): one row of totals."""
    la = a.select(
        "sample_item_id", "peak_id", F.col("neutral_formula").alias("fa"),
        F.col("tier").alias("ta"), F.col("ion_score").alias("sa"), F.lit(1).alias("ina"),
    )
    lb = b.select(
        "sample_item_id", "peak_id", F.col("neutral_formula").alias("fb"),
        F.col("tier").alias("tb"), F.col("ion_score").alias("sb"), F.lit(1).alias("inb"),
    )
    both = F.col("ina").isNotNull() & F.col("inb").isNotNull()
    return la.join(lb, ["sample_item_id", "peak_id"], "full_outer").agg(
        F.count_if(both).alias("n_both"),
        F.count_if(F.col("inb").isNull()).alias("only_a"),
        F.count_if(F.col("ina").isNull()).alias("only_b"),
        F.try_divide(F.count_if(both & F.col("fa").eqNullSafe(F.col("fb"))), F.count_if(both)).alias("agree"),
        F.count_if(both & (F.col("ta") == "Assigned") & (F.col("tb") == "Candidate")).alias("demoted"),
        F.count_if(both & (F.col("ta") == "Candidate") & (F.col("tb") == "Assigned")).alias("promoted"),
        F.avg(F.when(both, F.col("sb") - F.col("sa"))).alias("mean_shift"),
        F.avg(F.when(both, F.abs(F.col("sb") - F.col("sa")))).alias("mae"),
    )


def scorer_parity(owners: DataFrame, local: DataFrame, within: float = 0.1) -> DataFrame:
    """How a second scorer agrees with the owners' scores, per reagent and over all.

    ``owners``: one row per owned peak with ``reagent``; ``local``: every scored
    candidate as ``(sample_item_id, peak_id, neutral_formula, adduct, local_score)``.
    """
    peak = ["sample_item_id", "peak_id"]
    top = local.groupBy(*peak).agg(
        F.min(F.struct(-F.col("local_score"), F.col("neutral_formula").alias("f"))).alias("t")
    ).select(*peak, F.col("t.f").alias("top_formula"))
    rows = (
        owners.join(local, [*peak, "neutral_formula", "adduct"], "left")
        .join(top, peak, "left")
        .withColumn("gap", F.abs(F.col("local_score") - F.col("ion_score")))
    )
    b, s = F.col("ion_score"), F.col("local_score")
    pair_b = F.when(s.isNotNull(), b)
    return rows.cube("reagent").agg(
        F.count(F.lit(1)).alias("n_owners"),
        F.count("local_score").alias("n_pairs"),
        F.avg("gap").alias("mae"),
        F.try_divide(F.covar_pop(b, s), F.stddev_pop(pair_b) * F.stddev_pop(s)).alias("r"),
        F.avg((F.col("gap") <= within).cast("double")).alias("within"),
        F.try_divide(F.count("top_formula"), F.count(F.lit(1))).alias("covered"),
        F.try_divide(
            F.count_if(F.col("top_formula") == F.col("neutral_formula")), F.count(F.lit(1))
        ).alias("agree"),
    ).withColumn("reagent", F.coalesce("reagent", F.lit("all")))
