"""Stamp a multi-sample peak table with the identity of its nearest ledger ion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.functions.quantiles import exact_quantiles
from ionloom.operators import axis
from ionloom.session import cut_lineage

IDENTITY = (
    "neutral_formula", "adduct", "tier", "intensity_suspect", "role", "ion_formula", "iso_label",
)
ANCHOR_MARGIN = 2.0


def _with_identity(ledger: DataFrame) -> DataFrame:
    """Add absent identity columns as typed nulls so that the plan is the same for any ledger."""
    for name in IDENTITY:
        if name not in ledger.columns:
            kind = "boolean" if name == "intensity_suspect" else "string"
            ledger = ledger.withColumn(name, F.lit(None).cast(kind))
    return ledger.withColumn("intensity_suspect", F.coalesce("intensity_suspect", F.lit(False)))


def match_nearest(
    peaks: DataFrame, ledger: DataFrame, tol_ppm: float = 5.0, floor_da: float = 1.5e-3
) -> DataFrame:
    """Peaks plus ``ion`` (the nearest ledger ion in tolerance, null if none) and ``off``."""
    hit = axis.nearest(
        peaks, _with_identity(ledger), "mz", "mz", IDENTITY,
        tol_ppm=tol_ppm, floor_da=floor_da, order=("neutral_formula", "adduct"), out="ion",
    )
    return hit.withColumn("off", F.col("mz") - F.col("ion.mz"))


def consensus_offsets(matched: DataFrame, tol_ppm: float = 5.0, floor_da: float = 1.5e-3) -> DataFrame:
    """Per ion, the mean offset of the raw track its peaks really follow: ``(ion_mz, cons)``.

    Offsets split into tracks at gaps above a third of the tolerance. The
    brightest track wins, but the track at the ledger position is only displaced
    by one more than twice as bright.
    """
    cand = matched.where(F.col("ion").isNotNull()).select(
        F.col("ion.mz").alias("ion_mz"),
        "off",
        F.greatest(F.coalesce(F.nanvl("height", F.lit(0.0)), F.lit(0.0)), F.lit(0.0)).alias("h"),
        (F.greatest(F.col("ion.mz") * tol_ppm * 1e-6, F.lit(floor_da)) / 3.0).alias("half"),
    )
    tracks = (
        axis.assign_bins(cand, "off", tol_abs="half", keys=["ion_mz"], out="track")
        .groupBy("ion_mz", "track")
        .agg(
            F.max("h").alias("bright"),
            F.sum("h").alias("hsum"),
            F.sum(F.col("off") * F.col("h")).alias("hoff"),
            F.avg("off").alias("plain"),
            F.min(F.abs("off")).alias("dist"),
            F.max("half").alias("half"),
        )
        .withColumn("pos", F.when(F.col("hsum") > 0, F.col("hoff") / F.col("hsum")).otherwise(F.col("plain")))
    )
    entry = F.struct("bright", "pos")
    picked = tracks.groupBy("ion_mz").agg(
        F.min_by(entry, F.struct(-F.col("bright"), F.col("track"))).alias("top"),
        F.min_by(entry, F.struct("dist", "track")).alias("home"),
        F.min("dist").alias("dist"),
        F.max("half").alias("half"),
    )
    keep_home = (F.col("dist") <= F.col("half")) & (
        F.col("top.bright") <= ANCHOR_MARGIN * F.col("home.bright")
    )
    return picked.select(
        "ion_mz", F.when(keep_home, F.col("home.pos")).otherwise(F.col("top.pos")).alias("cons")
    )


def resolve_one_to_one(matched: DataFrame, offsets: DataFrame | None, keys: Sequence[str] = ("sample_item_id",)) -> DataFrame:
    """Keep one peak per (sample, ion): nearest to the consensus, then brightest, then by id.

    Adds ``winner`` and ``dup_candidate``. The contest is a map-side-combined
    minimum, and rows without an ion get scattered join keys of their own. Rows that
    are equal in all columns count as one peak.
    """
    scattered = -(F.pmod(F.xxhash64("peak_id"), F.lit(100000)) + 1).cast("double")
    keyed = matched.withColumn("ion_mz", F.coalesce(F.col("ion.mz"), scattered))
    if offsets is not None:
        keyed = keyed.join(offsets, "ion_mz", "left")
    else:
        keyed = keyed.withColumn("cons", F.lit(0.0))
    keyed = keyed.withColumn(
        "claim",
        F.when(
            F.col("ion").isNotNull(),
            F.struct(
                F.abs(F.col("off") - F.coalesce("cons", F.lit(0.0))).alias("d"),
                (-F.coalesce(F.nanvl("height", F.lit(None)), F.lit(float("-inf")))).alias("nh"),
                F.col("peak_id").alias("peak_id"),
                # Raw input may repeat an id within a sample; its rows are told apart by content.
                F.xxhash64(*matched.columns).alias("content"),
            ),
        ),
    )
    best = (
        keyed.where(F.col("ion").isNotNull())
        .groupBy(*keys, "ion_mz")
        .agg(F.min("claim").alias("best"))
    )
    return (
        keyed.join(best, [*keys, "ion_mz"], "left")
        .withColumn("winner", F.col("ion").isNotNull() & (F.col("claim") == F.col("best")))
        .withColumn("dup_candidate", F.col("ion").isNotNull() & (F.col("claim") != F.col("best")))
        .drop("ion_mz", "best", "claim", "cons")
    )


def annotate_peaks(
    peaks: DataFrame,
    ledger: DataFrame,
    tol_ppm: float = 5.0,
    floor_da: float = 1.5e-3,
    one_to_one: bool = True,
    consensus: bool = True,
) -> DataFrame:
    """Every peak row, with the identity columns of the ion it is stamped with."""
    matched = match_nearest(peaks, ledger, tol_ppm, floor_da)
    if one_to_one:
        offsets = consensus_offsets(matched, tol_ppm, floor_da) if consensus else None
        matched = resolve_one_to_one(matched, offsets)
    else:
        matched = matched.withColumn("winner", F.col("ion").isNotNull()).withColumn(
            "dup_candidate", F.lit(False)
        )
    stamped = [
        F.when(F.col("winner"), F.col(f"ion.{name}")).alias(name)
        for name in IDENTITY
        if name != "intensity_suspect"
    ]
    return matched.select(
        *peaks.columns,
        *stamped,
        F.when(F.col("winner"), F.col("ion.mz")).alias("ion_mz"),
        "dup_candidate",
        (F.col("winner") & F.coalesce(F.col("ion.intensity_suspect"), F.lit(False))).alias("intensity_suspect"),
    )


def identified_rows(ledger: DataFrame, sample: str = "sample_item_id") -> DataFrame:
    """Per-file rows of every known ion; a satellite carries its parent's ion formula."""
    parents = ledger.select(
        F.col(sample).alias("_s"), F.col("peak_id").alias("_p"), F.col("ion_formula").alias("parent_formula")
    )
    joined = ledger.join(
        parents,
        (F.col(sample) == F.col("_s")) & (F.col("parent_peak_id") == F.col("_p")),
        "left",
    ).drop("_s", "_p")
    role = F.col("role")
    # The tag is the first bracketed text of the comment that is not a mass error.
    tags = F.filter(
        F.regexp_extract_all("commentary", F.lit(r"\(([^)]+)\)"), 1), lambda g: ~g.contains("ppm")
    )
    tag = F.try_element_at(tags, F.lit(1))
    formula = (
        F.when(role.isin("M0", "reagent"), F.col("ion_formula"))
        .when(role == "iso_child", F.col("parent_formula"))
    )
    return joined.where(
        role.isin("M0", "artifact") | (role.isin("reagent", "iso_child") & (F.coalesce(formula, F.lit("")) != ""))
    ).select(
        "mz",
        "role",
        formula.alias("ion_formula"),
        F.when(role == "reagent", tag).when(role == "iso_child", F.col("iso_label")).alias("iso_label"),
        F.when(role == "M0", F.col("neutral_formula")).alias("neutral_formula"),
        F.when(role == "M0", F.col("adduct")).alias("adduct"),
    )


def stamping_frame(merged: DataFrame, identified: DataFrame, artefact_gap: float = 3e-3) -> DataFrame:
    """Union of the merged analytes, the aggregated known non-analytes and the artefact tracks."""
    # Read four times below: written once instead of derived four times.
    identified = cut_lineage(identified)
    votes = (
        identified.where((F.col("role") == "M0") & F.col("ion_formula").isNotNull())
        .groupBy("neutral_formula", "adduct", "ion_formula")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    modal = votes.groupBy("neutral_formula", "adduct").agg(
        F.min(F.struct(-F.col("n"), F.col("ion_formula"))).alias("best")
    ).select("neutral_formula", "adduct", F.col("best.ion_formula").alias("ion_formula"))
    analytes = (
        merged.drop("ion_formula")
        .join(modal, ["neutral_formula", "adduct"], "left")
        .withColumn("role", F.lit("M0"))
        .withColumn("iso_label", F.lit(None).cast("string"))
    )
    aux = identified.where(F.col("role").isin("reagent", "iso_child")).withColumn(
        "tag", F.coalesce("iso_label", F.lit(""))
    )
    roles = aux.groupBy("ion_formula", "tag").agg(F.min("role").alias("role"))
    others = (
        exact_quantiles(aux, ["ion_formula", "tag"], "mz", {"mz": 0.5})
        .join(roles, ["ion_formula", "tag"])
        .select("mz", "role", "ion_formula", F.nullif("tag", F.lit("")).alias("iso_label"))
    )
    ghosts = axis.assign_bins(
        identified.where(F.col("role") == "artifact"), "mz", tol_abs=artefact_gap, out="track"
    )
    ghosts = exact_quantiles(ghosts, ["track"], "mz", {"mz": 0.5}).select(
        "mz",
        F.lit("artifact").alias("role"),
        F.lit(None).cast("string").alias("ion_formula"),
        F.lit(None).cast("string").alias("iso_label"),
    )
    return analytes.unionByName(others, allowMissingColumns=True).unionByName(
        ghosts, allowMissingColumns=True
    )
