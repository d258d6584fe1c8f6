"""Assignment passes: where candidates come from. Scoring, arbitration and commit are shared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.functions import formula as fx
from ionloom.operators import axis, chem, series
from ionloom.operators.claims import RULES, Rule, arbitrate, commit
from ionloom.operators.rules import Profile, profile_reason
from ionloom.session import cut_lineage, release, scratch

PEAK = ["sample_item_id", "peak_id"]


def run_pass(
    ledger: DataFrame, cands: DataFrame, rule: Rule, cal: DataFrame | None = None, listed: DataFrame | None = None,
    only: DataFrame | None = None, scorer=chem.score_candidates,
) -> DataFrame:
    """Score candidates against all peaks of their sample, arbitrate, commit.

    ``scorer(peaks, candidates)`` may be replaced; it returns the SCORED table. ``only`` names the peaks
    that may be claimed, by ``(sample_item_id, peak_id)`` or by positions ``(sample_item_id, mz)`` of free
    peaks, under a rule for unexplained ones. Only the ledger that results stays in the shared folder.
    """
    with scratch(ledger.sparkSession) as keep:
        peaks = ledger.select(*PEAK, "mz", "height")
        scored = cut_lineage(scorer(peaks, cands.select("sample_item_id", "formula", "el", "adduct").distinct()))
        if only is not None and "peak_id" not in only.columns:
            only = at_positions(scored, only)
        winners, children = arbitrate(scored, cal, listed)
        return keep(commit(ledger, cut_lineage(winners), cut_lineage(children), rule, cal, only))


def at_positions(scored: DataFrame, positions: DataFrame, min_height: float = 100.0) -> DataFrame:
    """Peaks of base lines at some positions; what candidates meet is far less than the ledger."""
    bright = F.coalesce("sample_peak_intensity", F.lit(0.0)) >= min_height
    base = scored.where(F.col("is_base") & F.col("sample_peak_id").isNotNull() & bright).select(
        "sample_item_id", F.col("sample_peak_id").alias("peak_id"), F.col("sample_peak_mz").alias("mz")
    )
    return base.distinct().join(positions.select("sample_item_id", "mz").distinct(), ["sample_item_id", "mz"], "left_semi").select(*PEAK)


def free_peaks(ledger: DataFrame, min_height: float = 100.0) -> DataFrame:
    return ledger.where((F.col("role") == "unexplained") & (F.coalesce("height", F.lit(0.0)) >= min_height)).select(*PEAK, "mz", "height")


def backbone(ledger: DataFrame, grid: DataFrame, adducts: Sequence[str], profile: Profile, cal=None, box: DataFrame | None = None) -> DataFrame:
    """Pass 1: grid candidates of every bright peak under the context profile.

    Scoring asks which formulas a sample may hold, so peaks at one position are matched once.
    """
    targets = ledger.where(F.coalesce("height", F.lit(0.0)) >= 100.0).select("sample_item_id", "mz").distinct()
    fits = None
    if box is not None:
        targets, fits = targets.join(box, "sample_item_id"), chem.inside_box()
    allowed = grid.where(profile_reason(F.col("el"), profile).isNull())
    return run_pass(ledger, chem.candidates(targets, allowed, adducts, fits=fits), RULES["backbone"], cal)


def anchors(ledger: DataFrame) -> DataFrame:
    """Trusted neutrals per sample, with their strength."""
    rows = ledger.where((F.col("role") == "M0") & F.coalesce("confidence", F.lit("")).rlike("^(High|Good)"))
    strongest = rows.groupBy("sample_item_id", F.col("neutral_formula").alias("anchor")).agg(F.max("ion_score").alias("strength"))
    return fx.with_counts(strongest, "anchor")


def stepped(anchor_rows: DataFrame, units: Sequence[str], steps: Sequence[int]) -> DataFrame:
    """Neutrals a few repeat units from an anchor: ``(sample, anchor, strength, unit, n_steps, el, formula)``.

    Where a formula leads is worked out once for all samples that hold it.
    """
    # The moves are a table of numbers; atoms are added once, in columns, not once per move.
    moves = ", ".join(f"struct('{u}' AS unit, {s} AS n, {fx.counts_literal(fx.REPEAT_UNITS[u], s)} AS add)" for u in units for s in steps)
    moved = {f: F.col("el")[f] + F.col("m.add")[f] for f in fx.FIELDS.values()}
    el = F.struct(*[c.alias(f) for f, c in moved.items()])
    # Few bytes, much work: left to itself, the shuffle would be read by one task.
    spread = anchor_rows.select("anchor", "el").distinct().repartition(anchor_rows.sparkSession.sparkContext.defaultParallelism, "anchor")
    # An anchor has no negative counts, so only what the move takes can fall below zero.
    rows = spread.withColumn("m", F.explode(F.expr(f"array({moves})"))).where(F.least(*moved.values()) >= 0).select(
        "anchor", F.col("m.unit").alias("unit"), F.col("m.n").alias("n_steps"), el.alias("el")
    )
    rows = rows.where(fx.structure_ok(F.col("el")) & (F.col("el")["O"] <= fx.oxygen_cap(F.col("el")))).withColumn("formula", fx.text(F.col("el")))
    return anchor_rows.select("sample_item_id", "anchor", "strength").join(cut_lineage(rows), "anchor").select(
        "sample_item_id", "anchor", "strength", "unit", "n_steps", "el", "formula"
    )


def on_free_positions(proposals: DataFrame, ledger: DataFrame, adducts: Sequence[str], tol_ppm: float = 3.0) -> DataFrame:
    """Proposals, and the positions of unexplained peaks of their sample that their ions fall on.

    ``proposals``: one row per sample and formula. Peaks at one position meet the same proposals, so copies are matched once.
    """
    # Masses are worked out once per proposal, before ion forms and cells multiply the rows.
    neutral = cut_lineage(proposals.withColumn("_mass", fx.mass(F.col("el"))))
    ions = neutral.withColumn("a", F.explode(chem.adduct_rows(adducts))).select(
        *proposals.columns, F.col("a.adduct").alias("adduct"), (F.col("_mass") + F.col("a.shift")).alias("theo")
    )
    positions = cut_lineage(free_peaks(ledger).select("sample_item_id", "mz").distinct())
    return axis.band_join(
        positions, ions, F.col("mz"), F.col("theo"), tol_ppm,
        F.abs(F.col("mz") - F.col("theo")) / F.col("theo") * 1e6 <= tol_ppm, ["sample_item_id"],
    )


def formulas_of(proposals: DataFrame) -> DataFrame:
    """One row per sample and formula that is proposed."""
    return proposals.select("sample_item_id", "formula", "el").distinct()


def series_walk(
    ledger: DataFrame, adducts: Sequence[str], cal=None, units: Sequence[str] = fx.ORGANIC_UNITS,
    steps: Sequence[int] = (-1, 1), rule: str = "series",
) -> DataFrame:
    """Passes 2 and 4B: grow series from the anchors until nothing new is committed.

    Peaks at one position meet the same proposals. A round proposes what lies a step from an anchor;
    as long as it commits something, the next one has new anchors.
    """
    have = ledger.where("role = 'M0'").count()
    with scratch(ledger.sparkSession) as result:
        while True:
            with scratch(ledger.sparkSession) as keep:
                hits = cut_lineage(on_free_positions(formulas_of(stepped(anchors(ledger), units, steps)), ledger, adducts))
                grown = keep(run_pass(ledger, hits, RULES[rule], cal, only=hits))
            release(ledger)
            ledger, before, have = grown, have, grown.where("role = 'M0'").count()
            if have <= before:
                return result(ledger)


def completion(ledger: DataFrame, adducts: Sequence[str], cal=None) -> DataFrame:
    """Pass 5: other channels of trusted neutrals, and gaps between two of them on a CH2 ladder."""
    trusted = anchors(ledger)
    known = trusted.select("sample_item_id", F.col("anchor").alias("formula"))
    own = trusted.select("sample_item_id", F.col("anchor").alias("formula"), "el")
    ladder = stepped(trusted, ["CH2"], [2, 3]).join(known, ["sample_item_id", "formula"], "left_semi")
    ends = ladder.select("sample_item_id", "anchor", F.col("n_steps").alias("k"))
    inner = stepped(trusted, ["CH2"], [1, 2]).join(ends, ["sample_item_id", "anchor"]).where(F.col("n_steps") < F.col("k"))
    gaps = inner.select("sample_item_id", "formula", "el").join(known, ["sample_item_id", "formula"], "left_anti")
    with scratch(ledger.sparkSession) as keep:
        hits = cut_lineage(on_free_positions(formulas_of(own.unionByName(gaps)), ledger, adducts))
        return keep(run_pass(ledger, hits, RULES["completion"], cal, only=hits))


def ladder_fill(ledger: DataFrame, adducts: Sequence[str], cal=None) -> DataFrame:
    """Pass 6: up to four steps of nine units; fewer steps, smaller error, stronger anchor first.

    How far a formula lies from a position is up to the formula, so of its ways there only the one of
    fewest steps from the strongest anchor can win, and it alone meets the peaks.
    """
    units = ("CH2", "O", "H2O", "CO", "CO2", "C2H2O", "C2H4O", "C3H6O", "CH2O")
    with scratch(ledger.sparkSession) as keep:
        ways = stepped(cut_lineage(anchors(ledger)), units, [-4, -3, -2, -1, 1, 2, 3, 4])
        # Numbers are combined before the shuffle; of the few distances left per formula the least is taken.
        weak = F.coalesce(-F.col("strength"), F.lit(float("-inf")))
        ways = ways.groupBy("sample_item_id", "formula", "el", F.abs("n_steps").alias("far")).agg(F.min(weak).alias("weak"))
        ways = ways.groupBy("sample_item_id", "formula", "el").agg(F.min(F.struct("far", "weak")).alias("way"))
        hits = on_free_positions(ways, ledger, adducts)
        best = hits.groupBy("sample_item_id", "mz").agg(
            F.min_by(
                F.struct("formula", "el", "adduct"),
                F.struct("way.far", F.abs(F.col("mz") - F.col("theo")), "way.weak", F.col("formula"), F.col("adduct")),
            ).alias("b")
        ).select("sample_item_id", "mz", "b.*")
        best = cut_lineage(best)
        return keep(run_pass(ledger, best, RULES["ladder"], cal, only=best))


def halogens_in_ion(element: str) -> Column:
    """Atoms of a halogen in the ion of a candidate row (``el``, ``adduct``)."""
    add = F.lit(0)
    for a, (delta, _) in fx.ADDUCTS.items():
        if delta.get(element):
            add = add + F.when(F.col("adduct") == a, delta[element]).otherwise(0)
    return F.col("el")[element] + add


def pair_pass(ledger: DataFrame, grid: DataFrame, adducts: Sequence[str], cal=None) -> DataFrame:
    """Pass 4A: light members of isotope doublets, with the halogen count the doublet shows."""
    pairs = cut_lineage(chem.isotope_pairs(free_peaks(ledger)))
    light = pairs.select("sample_item_id", F.col("light").alias("peak_id"), F.col("light_mz").alias("mz"), "element", "n_halogen")
    hits = chem.candidates(light, grid, adducts)
    br, cl = halogens_in_ion("Br"), halogens_in_ion("Cl")
    want = (
        F.when(F.col("element") == "Br", br == F.col("n_halogen"))
        .when(F.col("element") == "Cl", cl == F.col("n_halogen"))
        .otherwise((br == 1) & (cl == 1))
    )
    hits = cut_lineage(hits.where(want & ((F.col("el")["F"] == 0) | (F.col("el")["O"] <= 6))))
    return run_pass(ledger, hits, RULES["pairs"], cal, only=hits)


def known_species(
    ledger: DataFrame, species: DataFrame, adducts: Sequence[str], prior: DataFrame | None = None, cal=None, tol_ppm: float = 2.0
) -> DataFrame:
    """Pass 0: listed species within tolerance of the sample's prior offset.

    Phosphorus needs a second channel, bromine and silicon their own satellites;
    the latter is what the isotope score carries.
    """
    targets = chem.list_targets(species, adducts)
    rows = free_peaks(ledger)
    if prior is not None:
        rows = rows.join(prior.select("sample_item_id", "offset_ppm"), "sample_item_id", "left")
    else:
        rows = rows.withColumn("offset_ppm", F.lit(0.0))
    shifted = rows.withColumn("raw_mz", F.col("mz")).withColumn("mz", F.col("mz") * (1.0 - F.coalesce("offset_ppm", F.lit(0.0)) * 1e-6))
    hits = chem.match_lists(shifted, targets, tol_ppm).withColumn("el", fx.counts(F.col("formula")))
    channels = hits.groupBy("sample_item_id", "formula").agg(F.count_distinct("adduct").alias("n_ch"))
    hits = hits.join(channels, ["sample_item_id", "formula"]).where((F.col("el")["P"] == 0) | (F.col("n_ch") >= 2))
    hits = cut_lineage(hits.select(*PEAK, "formula", "el", "adduct"))
    return run_pass(ledger, hits, RULES["known"], cal, only=hits)


def list_rescue(ledger: DataFrame, species: DataFrame, adducts: Sequence[str], cal=None, scorer=chem.score_candidates) -> DataFrame:
    """Decision per unexplained peak on a list: confirmed, too dim to confirm, or coincidence."""
    hits = cut_lineage(
        chem.match_lists(free_peaks(ledger, 0.0), chem.list_targets(species, adducts), 4.0).withColumn("el", fx.counts(F.col("formula")))
    )
    scored = scorer(ledger.select(*PEAK, "mz", "height"), hits.select("sample_item_id", "formula", "el", "adduct").distinct())
    key = ["sample_item_id", "compound_formula"]
    base = scored.where("is_base AND sample_peak_id IS NOT NULL").select(*key, F.col("sample_peak_id").alias("peak_id"), "ion_score", "ppm_error")
    proof = scored.where("NOT is_base AND iso_score > 0.4").select(*key).distinct().withColumn("_iso", F.lit(True))
    from ionloom.operators.claims import with_calibration, z_score

    rows = with_calibration(
        hits.withColumnRenamed("formula", "compound_formula").drop("ppm").join(base, [*key, "peak_id"]).join(proof, key, "left"), cal
    )
    z = F.coalesce(z_score(F.col("ppm_error"), F.col("cal_mu"), F.col("cal_sigma")), F.lit(0.0))
    ok = (F.col("ion_score") >= 0.70) & (z <= 2.0)
    visible = F.col("el")["C"] * F.lit(0.011) * F.col("height") >= 100.0
    decision = F.when(~ok, "poor match").when(F.col("_iso"), "confirmed").when(~visible, "too dim").otherwise("coincidence")
    return rows.select(*PEAK, F.col("compound_formula").alias("formula"), "adduct", "list_id", "ion_score", decision.alias("decision"))


def labelled_candidates(ledger: DataFrame, grid: DataFrame, adducts: Sequence[str], labels: Sequence[int] = (1, 2)) -> DataFrame:
    """Readings with one or two labelled nitrogens on unexplained peaks (three oxygens or more per label)."""
    variants = F.array(*[F.struct(F.lit(j).alias("j"), fx.shifted(F.col("el"), {"N": -1, "^N": 1}, j).alias("el")) for j in labels])
    heavy = grid.where((F.col("el")["N"] >= 1) & (F.col("el")["C"] >= 1)).withColumn("v", F.explode(variants)).where(
        F.col("v.el").isNotNull()
    ).select(fx.mass(F.col("v.el")).alias("mass"), F.col("v.el").alias("el"), fx.text(F.col("v.el")).alias("formula"), F.col("v.j").alias("j"))
    heavy = heavy.where((F.col("el")["O"] >= F.col("j") * 3) & (F.col("el")["O"] <= F.col("el")["C"] * 1.3))
    return chem.candidates(free_peaks(ledger), heavy, adducts)


# Shares of 29Si and 13C per atom, the 29Si step, how near its line must lie, and
# the least share of the predicted M+1 that has to be there.
SI29_SHARE, C13_SHARE, SI29_STEP, M1_REACH, M1_LEAST = 0.0468, 0.0107, 0.999568, 6e-3, 0.6


def silicon_confirmed(scored: DataFrame, peaks: DataFrame) -> DataFrame:
    """Scored rows of the ions that show a silicon line and an M+1 as high as their silicon count asks."""
    ion = ["sample_item_id", "compound_formula", "ion_formula"]
    matched = scored.where(F.col("sample_peak_id").isNotNull())
    lines = matched.where(~F.col("is_base") & (F.col("iso_score") > 0.4) & F.col("iso_label").contains("Si")).select(*ion).distinct()
    base = matched.where("is_base").select(*ion, "sample_peak_intensity", (F.col("sample_peak_mz") + SI29_STEP).alias("m1"))
    base = fx.with_counts(base.join(lines, ion, "left_semi"), "ion_formula")
    hit = axis.nearest(base, peaks.select("sample_item_id", "mz", "height"), "m1", "mz", ["height"], tol_ppm=1e-3,
                       floor_da=M1_REACH, keys=["sample_item_id"], order=("height",))
    wanted = F.col("el")["Si"] * SI29_SHARE + F.col("el")["C"] * C13_SHARE
    seen = F.coalesce(F.col("hit.height"), F.lit(0.0)) / F.col("sample_peak_intensity")
    good = hit.where((F.col("sample_peak_intensity") > 0) & (seen >= M1_LEAST * wanted)).select(*ion).distinct()
    return scored.join(good, ion, "left_semi")


def siloxane_pass(ledger: DataFrame, grid: DataFrame, adducts: Sequence[str], cal=None) -> DataFrame:
    """Silicon-rich readings on chains of three or more peaks one siloxane unit apart.

    A reading counts only if its silicon lines are there, and as high as its silicon count asks.
    """
    chains = series.exclusive_chains(free_peaks(ledger, 0.0), fx.unit_mass("C2H6OSi"), 4.0, min_len=3)
    on = free_peaks(ledger, 0.0).join(chains.select(*PEAK).distinct(), PEAK, "left_semi")
    hits = cut_lineage(chem.candidates(on, grid.where(F.col("el")["Si"] >= 3), adducts))

    def scorer(peaks: DataFrame, cands: DataFrame) -> DataFrame:
        return silicon_confirmed(cut_lineage(chem.score_candidates(peaks, cands)), peaks)

    return run_pass(ledger, hits, RULES["siloxane"], cal, only=hits, scorer=scorer)


def isotope_recovery(ledger: DataFrame, grid: DataFrame, adducts: Sequence[str], cal=None) -> DataFrame:
    """Halogen-bearing readings on peaks whose doublet shows that halogen count; no N, S or P."""
    plain = grid.where((fx.n(F.col("el"), "N", "S", "P") == 0))
    pairs = cut_lineage(chem.isotope_pairs(free_peaks(ledger)))
    light = pairs.select("sample_item_id", F.col("light").alias("peak_id"), F.col("light_mz").alias("mz"), "element", "n_halogen")
    hits = chem.candidates(light, plain, adducts)
    want = F.when(F.col("element") == "Br", halogens_in_ion("Br")).when(F.col("element") == "Cl", halogens_in_ion("Cl")) == F.col("n_halogen")
    hits = cut_lineage(hits.where(want))
    return run_pass(ledger, hits, RULES["isotope_recovery"], cal, only=hits)


def reagent_isotopologues(ledger: DataFrame, tol_ppm: float = 12.0, gate: float = 3.0) -> DataFrame:
    """Claims of satellites of labelled reagent ions, unless far brighter than predicted."""
    reagents = ledger.where("role = 'reagent' AND ion_formula IS NOT NULL").select(
        "sample_item_id", F.col("peak_id").alias("parent_peak_id"), F.col("mz").alias("p_mz"), F.col("height").alias("p_h"), "ion_formula",
    )
    ions = reagents.select("ion_formula").distinct().withColumn("el", fx.counts(F.regexp_replace("ion_formula", r"[+-]$", "")))
    lines = chem.isotope_templates(ions, floor=0.004, merge_da=0.003).where("line_no > 0")
    targets = reagents.join(lines, "ion_formula").withColumn("target", F.col("p_mz") + F.col("step"))
    free = ledger.where("role = 'unexplained'").select("sample_item_id", "mz", "height", "peak_id")
    hit = axis.nearest(targets, free, "target", "mz", ["height", "peak_id"], tol_ppm=tol_ppm, keys=["sample_item_id"], order=("height", "peak_id"))
    ok = hit.where(F.col("hit").isNotNull() & (F.coalesce("hit.height", F.lit(0.0)) <= F.lit(gate) * F.col("rel") * F.col("p_h")))
    return ok.groupBy("sample_item_id", F.col("hit.peak_id").alias("peak_id")).agg(
        F.min_by(F.struct("parent_peak_id", "ion_formula", "label"), F.struct(F.abs(F.col("hit.mz") - F.col("target")), F.col("parent_peak_id"))).alias("b")
    ).select("sample_item_id", "peak_id", "b.*")
