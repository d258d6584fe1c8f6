"""Arbitration of scored candidates, calibration, commit gates and tiers.

Every pass is one table of candidate claims filtered by the rule of that pass
and folded into the ledger, for all samples at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.functions import formula as fx
from ionloom.functions.quantiles import exact_quantiles
from ionloom.operators import ledger as led
from ionloom.operators.rules import implausible
from ionloom.session import cut_lineage

PEAK = ["sample_item_id", "peak_id"]
MINOR_CHANNELS = ("[M+CO3]-", "[M+O2]-", "[M]-.")
BACKGROUND_CHANNELS = ("[M+CO3]-", "[M+HBr+CO3]-", "[M+O2]-", "[M]-.")
TIE_MARGIN, CLOSE_MARGIN = 0.05, 0.10
Z_ACCEPT, Z_PATTERN, Z_TAIL = 2.0, 4.0, 2.6
TAU_HIGH, TAU_GOOD, TAU_LOW, TAU_SUSPECT = 0.90, 0.80, 0.70, 0.50
# Diagnostic line and gate penalty of the elements that have one.
DIAGNOSTIC = {
    "Cl": ("37Cl", 0.30),
    "Br": ("81Br", 0.30),
    "S": ("34S", 0.12),
    "Si": ("29Si|30Si", 0.12),
}


@dataclass(frozen=True)
class Rule:
    """Commit rule of one pass."""

    pass_no: int
    method: str
    min_score: float
    series_like: bool = False
    only_unexplained: bool = True
    lock_high: bool = False
    suffix: str = ""
    cap_good: bool = False


# Commit rule of every assignment pass.
RULES = {
    "known": Rule(0, "known", 0.70, lock_high=True),
    "backbone": Rule(1, "grid", 0.70, only_unexplained=False, lock_high=True),
    "series": Rule(2, "series", 0.60, series_like=True, suffix="series"),
    "family": Rule(3, "family", 0.50, suffix="family"),
    "pairs": Rule(4, "pairs", 0.50, cap_good=True, suffix="pair"),
    "deep_series": Rule(4, "series-deep", 0.50, series_like=True, cap_good=True, suffix="series"),
    "completion": Rule(5, "completion", 0.50, series_like=True, suffix="completion"),
    "ladder": Rule(6, "series-ladder", 0.80, series_like=True, cap_good=True, suffix="ladder"),
    "certified": Rule(7, "certified", 0.50, cap_good=True, suffix="certified"),
    "siloxane": Rule(8, "siloxane", 0.50, cap_good=True, suffix="siloxane"),
    "labelled": Rule(8, "labelled", 0.80, cap_good=True, suffix="labelled"),
    "isotope_recovery": Rule(8, "isotope-recovery", 0.65, cap_good=True, suffix="isotope"),
    "list_rescue": Rule(8, "list-rescue", 0.70, cap_good=True, suffix="literature"),
}


def z_score(ppm: Column, mu: Column, sigma: Column) -> Column:
    return F.abs(ppm - mu) / sigma


def with_calibration(rows: DataFrame, cal: DataFrame | None) -> DataFrame:
    """Attach per-sample ``cal_mu`` and ``cal_sigma`` (null where uncalibrated)."""
    if cal is None:
        return rows.withColumn("cal_mu", F.lit(None).cast("double")).withColumn("cal_sigma", F.lit(None).cast("double"))
    return rows.join(cal.select("sample_item_id", "cal_mu", "cal_sigma"), "sample_item_id", "left")


# ------------------------------------------------------------------ arbitration
def _starts_with(line: str):
    """Predicate on a satellite label: the given line, once or several times."""
    return lambda s: s.rlike(rf"^(\d+x)?({line})")


def arbitrate(
    scored: DataFrame, cal: DataFrame | None = None, listed: DataFrame | None = None,
    reagent_element: str | None = None, keep: int = 6,
) -> tuple[DataFrame, DataFrame]:
    """Best owner per (sample, peak) with its runners-up, and the satellites of the owners.

    The effective score is the raw score less what the formula leaves unproven,
    less a minor-channel and an off-calibration penalty, plus a small bonus for
    listed neutrals. Ranking keeps the first few per peak before the shuffle.
    """
    ion = ["sample_item_id", "compound_formula", "ion_formula"]
    matched = scored.where(F.col("sample_peak_id").isNotNull())
    iso = matched.where(~F.col("is_base") & (F.coalesce("iso_score", F.lit(0.0)) > 0.4))
    proof = iso.groupBy(*ion).agg(
        F.count_distinct("sample_peak_id").alias("n_iso"),
        F.array_distinct(F.flatten(F.collect_set(F.split("iso_label", r"\+")))).alias("labels"),
    )
    base = matched.where(F.col("is_base") & F.col("ion_score").isNotNull()).withColumn(
        "raw_score", F.least("ion_score", "compound_score")
    )
    base = fx.with_counts(with_calibration(base.join(proof, ion, "left"), cal), "compound_formula")
    el, labels = F.col("el"), F.coalesce("labels", F.array().cast("array<string>"))
    penalty = F.lit(0.0)
    for e, weight in fx.COMPLEXITY.items():
        prior = F.least(el[e] * F.lit(weight * 0.01), F.lit(0.20))
        cost = prior
        if e in DIAGNOSTIC:
            line, gate = DIAGNOSTIC[e]
            seen = F.exists(labels, _starts_with(line))
            waived = prior if e == reagent_element else F.lit(0.0)
            cost = F.when(seen, waived).otherwise(prior + gate)
        penalty = penalty + F.when(el[e] > 0, cost).otherwise(0.0)
    penalty = F.least(penalty, F.lit(0.50))
    z = z_score(F.col("ppm_error"), F.col("cal_mu"), F.col("cal_sigma"))
    off = F.coalesce(F.greatest(F.lit(0.0), z - Z_ACCEPT) * 0.04, F.lit(0.0))
    minor = F.when(F.col("adduct").isin(*MINOR_CHANNELS), 0.12).otherwise(0.0)
    eff = F.col("raw_score") - penalty - minor - off
    if listed is not None:
        names = listed.select(F.col("formula").alias("compound_formula")).distinct().withColumn("_l", F.lit(0.04))
        base = base.join(names, "compound_formula", "left")
        eff = eff + F.coalesce("_l", F.lit(0.0))
    base = base.withColumn("eff_score", eff)
    order = Window.partitionBy("sample_item_id", "sample_peak_id").orderBy(
        F.desc("eff_score"), "compound_formula", "adduct", "ion_formula", F.desc("raw_score"), "ppm_error"
    )
    ranked = base.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= keep + 1)
    entry = F.struct(
        "rn", F.col("compound_formula").alias("formula"), "adduct", "ion_score", "raw_score", "eff_score",
        F.col("ppm_error").alias("ppm"), "ion_formula", "compound_score", F.coalesce("n_iso", F.lit(0)).alias("n_iso"),
    )
    packed = ranked.groupBy("sample_item_id", F.col("sample_peak_id").alias("peak_id")).agg(
        F.array_sort(F.collect_list(entry)).alias("all")
    )
    top, rest = F.col("all")[0], F.expr("slice(all, 2, size(all))")
    runner = F.try_element_at("all", F.lit(2))["eff_score"]
    alternatives = F.transform(
        rest, lambda a: F.struct(*[a[c].alias(c) for c in ("formula", "adduct", "ion_score", "raw_score", "eff_score", "ppm")])
    )
    winners = packed.select(
        *PEAK, top["formula"].alias("neutral_formula"), top["adduct"].alias("adduct"), top["ion_formula"].alias("ion_formula"),
        top["ion_score"].alias("ion_score"), top["compound_score"].alias("compound_score"), top["raw_score"].alias("raw_score"),
        top["eff_score"].alias("eff_score"), (top["eff_score"] - runner).alias("eff_margin"), top["ppm"].alias("ppm_error"),
        top["n_iso"].alias("n_iso"), F.coalesce(top["eff_score"] - runner < TIE_MARGIN, F.lit(False)).alias("tied"),
        alternatives.alias("alternatives"),
    )
    won = winners.select(
        "sample_item_id", F.col("neutral_formula").alias("compound_formula"), "ion_formula", F.col("peak_id").alias("parent_peak_id"), "eff_score"
    )
    children = iso.join(won, ion).where(F.col("sample_peak_id") != F.col("parent_peak_id")).select(
        "sample_item_id", F.col("sample_peak_id").alias("peak_id"), "parent_peak_id", "iso_label",
        F.col("iso_score").alias("iso_match_score"), F.col("eff_score").alias("parent_score"),
    )
    return winners, children


def margin_and_density(winners: DataFrame) -> DataFrame:
    """Add the margin to the best stored alternative, how many are close, capped and tied flags.

    Alternatives that are the winner's own ion in another split are no
    competitors and are dropped first.
    """
    own = _ion_key(fx.counts(F.col("neutral_formula")), F.col("adduct"))
    rows = winners.withColumn("_own", own).withColumn("n_stored", F.size("alternatives"))
    counted = F.transform("alternatives", lambda a: F.struct(a.alias("a"), fx.counts(a["formula"]).alias("el")))
    keyed = F.transform(counted, lambda e: F.struct(e["a"].alias("a"), _ion_key(e["el"], e["a"]["adduct"]).alias("key")))
    real = F.transform(F.filter(keyed, lambda e: e["key"] != F.col("_own")), lambda e: e["a"])
    out = rows.withColumn("alternatives", real).drop("_own")
    gaps = F.transform("alternatives", lambda a: F.col("eff_score") - a["eff_score"])
    out = out.withColumn("_g", F.filter(gaps, lambda g: g.isNotNull()))
    close = F.size(F.filter("_g", lambda g: g < CLOSE_MARGIN))
    return out.select(
        *[c for c in out.columns if c not in ("_g", "tied")],
        F.array_min("_g").alias("margin"),
        (F.lit(1) + close).alias("density"),
        ((F.col("n_stored") >= 3) & (close > 0) & (close >= F.size("alternatives"))).alias("density_capped"),
        F.coalesce(F.array_min("_g") < TIE_MARGIN, F.lit(False)).alias("tied"),
    )


def _ion_key(el: Column, adduct: Column) -> Column:
    """Atoms of the ion of a (neutral counts, ion form) reading, as one text."""
    table = F.create_map(
        *[
            x
            for a, (delta, _) in fx.ADDUCTS.items()
            for x in (F.lit(a), F.array(*[F.lit(delta.get(e, 0)) for e in fx.FIELDS]))
        ]
    )
    own = F.array(*[el[f] for f in fx.FIELDS.values()])
    total = F.zip_with(own, F.try_element_at(table, adduct), lambda x, y: x + y)
    return F.coalesce(F.array_join(total.cast("array<string>"), ","), F.concat(F.array_join(own.cast("array<string>"), ","), adduct))


# ------------------------------------------------------------------ calibration
def calibrate(owners: DataFrame, sigma_floor: float = 0.25, min_n: int = 20, recentre: bool = False) -> DataFrame:
    """Robust (mu, sigma) of the mass error per sample over its trusted core.

    ``owners``: the core rows with ``ppm_error``. ``recentre`` first keeps what
    lies within 2 of the median. Samples with too small a core are absent.
    """
    # Read once per statistic below, so it is written once.
    rows = cut_lineage(owners.select("sample_item_id", "ppm_error").where(F.col("ppm_error").isNotNull()))
    n = rows.groupBy("sample_item_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_n)
    rows = rows.join(n, "sample_item_id", "left_semi")
    if recentre:
        mid = exact_quantiles(rows, ["sample_item_id"], "ppm_error", {"mid": 0.5})
        near = rows.join(mid, "sample_item_id").where(F.abs(F.col("ppm_error") - F.col("mid")) <= 2.0)
        enough = near.groupBy("sample_item_id").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= min_n)
        core = near.join(enough, "sample_item_id", "left_semi").select("sample_item_id", "ppm_error")
        rows = core.unionByName(rows.join(enough, "sample_item_id", "left_anti"))
    mu = exact_quantiles(rows, ["sample_item_id"], "ppm_error", {"cal_mu": 0.5})
    dev = rows.join(mu, "sample_item_id").withColumn("dev", F.abs(F.col("ppm_error") - F.col("cal_mu")))
    mad = exact_quantiles(dev, ["sample_item_id"], "dev", {"mad": 0.5})
    return mu.join(mad, "sample_item_id").join(n, "sample_item_id").select(
        "sample_item_id", "cal_mu", F.greatest(F.lit(1.4826) * F.col("mad"), F.lit(sigma_floor)).alias("cal_sigma"), "n"
    )


def backbone_core(ledger: DataFrame) -> DataFrame:
    """Well-scored owners of plain C, H, N, O formulas."""
    good = ledger.where((F.col("role") == "M0") & F.col("ppm_error").isNotNull() & (F.coalesce("ion_score", F.lit(0.0)) >= TAU_GOOD))
    odd = fx.n(F.col("_el"), "^N", "S", "P", "Si", "F", "Cl", "Br", "I")
    return fx.with_counts(good, "neutral_formula", "_el").where(odd == 0).drop("_el")


def confidence_label(score: Column, ppm: Column, n_iso: Column, tied: Column, mu: Column, suffix: str = "") -> Column:
    a = F.coalesce(F.abs(ppm - F.coalesce(mu, F.lit(0.0))), F.lit(99.0))
    grade = (
        F.when((score >= TAU_HIGH) & (a <= 1.5) & (n_iso >= 1) & ~tied, "High")
        .when((score >= TAU_GOOD) & (a <= 2.0), "Good")
        .when(score >= TAU_LOW, "Low")
        .when(score >= TAU_SUSPECT, "Suspect")
        .otherwise("Reject")
    )
    return F.when(grade == "Reject", grade).otherwise(F.concat(grade, F.lit(f" ({suffix})" if suffix else "")))


def relabel(ledger: DataFrame, cal: DataFrame) -> DataFrame:
    """Grade unlocked owners again against the calibrated centre; the suffix stays."""
    kids = ledger.where("role = 'iso_child'").groupBy("sample_item_id", F.col("parent_peak_id").alias("peak_id")).agg(
        F.count_distinct("peak_id").alias("_kids")
    )
    rows = with_calibration(ledger.join(kids, PEAK, "left"), cal)
    suffix = F.regexp_extract("confidence", r"\(([^)]+)\)", 1)
    grade = confidence_label(
        F.coalesce("ion_score", F.lit(0.0)), F.col("ppm_error"), F.coalesce("_kids", F.lit(0)),
        F.coalesce("tied", F.lit(False)), F.col("cal_mu"),
    )
    new = F.when((suffix == "") | (grade == "Reject"), grade).otherwise(F.concat(grade, F.lit(" ("), suffix, F.lit(")")))
    due = (F.col("role") == "M0") & ~F.coalesce("locked", F.lit(False)) & F.col("cal_mu").isNotNull()
    return rows.withColumn("confidence", F.when(due, new).otherwise(F.col("confidence"))).select(*ledger.columns)


# ------------------------------------------------------------------ commit gates
def gated(winners: DataFrame, ledger: DataFrame, rule: Rule, cal: DataFrame | None = None) -> DataFrame:
    """Winners that may be committed under a rule, with the confidence they get."""
    state = ledger.select(
        *PEAK, F.col("role").alias("_role"), F.coalesce("locked", F.lit(False)).alias("_locked"), F.col("ion_score").alias("_have")
    )
    primary = ledger.where((F.col("role") == "M0") & ~F.col("adduct").isin(*MINOR_CHANNELS)).select(
        "sample_item_id", "neutral_formula"
    ).distinct().withColumn("_primary", F.lit(True))
    rows = with_calibration(winners.join(state, PEAK), cal).join(primary, ["sample_item_id", "neutral_formula"], "left")
    z = z_score(F.col("ppm_error"), F.col("cal_mu"), F.col("cal_sigma"))
    pattern = (F.col("n_iso") >= 1) | F.lit(rule.series_like)
    mass_ok = F.col("cal_mu").isNull() | (z <= Z_ACCEPT) | ((z <= Z_PATTERN) & pattern)
    minor_ok = (
        ~F.col("adduct").isin(*MINOR_CHANNELS) | (F.col("raw_score") >= TAU_GOOD) | F.lit(rule.series_like)
        | F.coalesce("_primary", F.lit(False))
    )
    free = F.col("_role") == "unexplained"
    weaker = (F.col("_role") != "M0") | F.col("_have").isNull() | (F.col("_have") < F.col("raw_score"))
    label = confidence_label(F.col("raw_score"), F.col("ppm_error"), F.col("n_iso"), F.col("tied"), F.col("cal_mu"), rule.suffix)
    if rule.cap_good:
        label = F.regexp_replace(label, "^High", "Good")
    return (
        rows.where(
            (F.col("raw_score") >= rule.min_score) & F.col("ppm_error").isNotNull() & mass_ok & minor_ok & ~F.col("_locked") & weaker
        )
        .where(free if rule.only_unexplained else F.lit(True))
        .withColumn("confidence", label)
        .where(F.col("confidence") != "Reject")
        .withColumn("pass_no", F.lit(rule.pass_no).cast("long"))
        .withColumn("method", F.lit(rule.method))
        .drop("_role", "_locked", "_have", "_primary", "cal_mu", "cal_sigma")
    )


def commit(
    ledger: DataFrame, winners: DataFrame, children: DataFrame, rule: Rule, cal: DataFrame | None = None,
    only: DataFrame | None = None,
) -> DataFrame:
    """Ledger after one pass: owners first, then displaced and attached satellites.

    An unlocked owner below High confidence gives way when a parent at least as
    well scored predicts it as a satellite.
    """
    if only is not None:
        winners = winners.join(only.select(*PEAK).distinct(), PEAK, "left_semi")
    payload = ["neutral_formula", "adduct", "ion_formula", "ion_score", "ppm_error", "confidence", "method", "pass_no"]
    extra = [c for c in ("eff_score", "eff_margin", "tied", "alternatives", "compound_score") if c in ledger.columns]
    claims = cut_lineage(gated(winners, ledger, rule, cal).select(*PEAK, *payload, *extra, F.lit("M0").alias("role")))
    # What follows asks for few columns of the owners and satellites only; whole rows are joined once, at the end.
    slim = led.fold_claims(ledger.select(*PEAK, "role", "locked", "ion_score", "confidence", "parent_peak_id"), claims)
    slim = cut_lineage(slim.where("role = 'M0' OR parent_peak_id IS NOT NULL").withColumn("locked", F.coalesce("locked", F.lit(False))))
    owners = slim.where("role = 'M0'").select("sample_item_id", F.col("peak_id").alias("parent_peak_id"), F.col("ion_score").alias("_ps"))
    wanted = cut_lineage(children.join(owners, ["sample_item_id", "parent_peak_id"]))
    held = slim.where((F.col("role") == "M0") & ~F.col("locked") & ~F.coalesce("confidence", F.lit("")).startswith("High")).select(
        *PEAK, F.col("ion_score").alias("_cs")
    )
    displaced = wanted.join(held, PEAK).where(F.col("_cs").isNull() | (F.col("_ps") >= F.col("_cs"))).select(*PEAK).distinct()
    orphans = slim.where("parent_peak_id IS NOT NULL AND NOT locked").join(
        displaced.withColumnRenamed("peak_id", "parent_peak_id"), ["sample_item_id", "parent_peak_id"], "left_semi"
    )
    gone = cut_lineage(displaced.unionByName(orphans.select(*PEAK)).distinct())
    still = owners.select("sample_item_id", "parent_peak_id").join(
        gone.withColumnRenamed("peak_id", "parent_peak_id"), ["sample_item_id", "parent_peak_id"], "left_anti"
    )
    out = led.reset(led.fold_claims(ledger, claims), gone)
    out = led.attach(out, wanted.join(still, ["sample_item_id", "parent_peak_id"], "left_semi").select(
        *PEAK, "parent_peak_id", "iso_label", "iso_match_score"))
    if rule.lock_high:
        fresh = (F.col("role") == "M0") & (F.col("pass_no") == rule.pass_no) & F.col("confidence").startswith("High")
        out = out.withColumn("locked", F.coalesce("locked", F.lit(False)) | F.coalesce(fresh, F.lit(False)))
    return out


# ------------------------------------------------------------------ tiers
def compute_tiers(ledger: DataFrame, cal: DataFrame | None, degeneracy: DataFrame | None = None) -> DataFrame:
    """Tier, reason code and candidate density of every owner, by one ordered rule table.

    ``ledger`` carries the owners' ``density``, ``density_capped`` and ``tied``
    (see :func:`margin_and_density`). Nothing but evidence moves an owner to
    Candidate: satellites, a second channel, or a series anchor corroborate it.
    """
    m0 = fx.with_counts(ledger.where("role = 'M0'"), "neutral_formula")
    kids = ledger.where("role = 'iso_child'").groupBy("sample_item_id", F.col("parent_peak_id").alias("peak_id")).agg(
        F.count(F.lit(1)).alias("_kids")
    )
    channels = m0.groupBy("sample_item_id", "neutral_formula").agg(F.count_distinct("adduct").alias("_channels"))
    strong = m0.where((F.col("method") == "grid") & F.coalesce("confidence", F.lit("")).startswith("High"))
    primary = strong.select("sample_item_id", "adduct").distinct().withColumn("_primary", F.lit(True))
    rows = (
        with_calibration(m0.join(kids, PEAK, "left"), cal)
        .join(channels, ["sample_item_id", "neutral_formula"], "left")
        .join(primary, ["sample_item_id", "adduct"], "left")
    )
    if degeneracy is not None:
        rows = rows.join(degeneracy.select(*PEAK, F.col("density").alias("_deg")), PEAK, "left")
    else:
        rows = rows.withColumn("_deg", F.lit(None).cast("long"))
    el = F.col("el")
    grade = F.regexp_extract("confidence", r"^(\w+)", 1)
    iso, cross = F.coalesce("_kids", F.lit(0)) > 0, F.coalesce("_channels", F.lit(0)) >= 2
    anchor = F.col("series_unit").isNotNull() if "series_unit" in ledger.columns else F.lit(False)
    backed = iso | cross | anchor
    z = z_score(F.col("ppm_error"), F.col("cal_mu"), F.col("cal_sigma"))
    density, tied = F.coalesce("density", F.lit(1)), F.coalesce("tied", F.lit(False))
    reason = (
        F.when(F.coalesce("method", F.lit("")).startswith("known"), "known species")
        .when(grade.isin("Low", "Suspect"), "weak score")
        .when(el["O"] > 11, "oxygen beyond validated chemistry")
        .when((el["Br"] >= 1) & (el["Cl"] >= 1), "mixed halogens")
        .when((el["F"] >= 1) & (el["H"] > 1) & (el["F"] < el["H"] * 2) & ~iso, "partly fluorinated")
        .when((el["Si"] >= 1) & ~backed, "silicon unproven")
        .when((fx.n(el, "P", "I") >= 1) & ~backed, "monoisotopic heteroatom unproven")
        .when(tied & ~(cross | anchor), "near tie")
        .when((density > 1) & ~backed, "close alternatives")
        .when(F.col("adduct").isin(*BACKGROUND_CHANNELS) & F.col("_primary").isNull() & ~backed, "background channel")
        .when(F.coalesce(z > Z_TAIL, F.lit(False)) & ~backed, "off calibration")
        .when(F.coalesce(F.col("_deg") > 2, F.lit(False)) & ~backed, "mass degenerate")
        .otherwise("supported")
    )
    return rows.withColumn("tier_reason", reason).select(
        *PEAK,
        F.when(F.col("tier_reason").isin("known species", "supported"), "Assigned").otherwise("Candidate").alias("tier"),
        "tier_reason", density.cast("long").alias("candidate_density"),
        F.coalesce("density_capped", F.lit(False)).alias("density_capped"),
    )


def calibrated_ppm(ledger: DataFrame, cal: DataFrame) -> DataFrame:
    """Add ``ppm_error_cal``: error less the sample's centre, or less its Assigned median without one."""
    fallback = exact_quantiles(
        ledger.where("role = 'M0' AND tier = 'Assigned'"), ["sample_item_id"], "ppm_error", {"_alt": 0.5}
    )
    rows = with_calibration(ledger, cal).join(fallback, "sample_item_id", "left")
    return rows.withColumn("ppm_error_cal", F.col("ppm_error") - F.coalesce("cal_mu", "_alt")).drop("cal_mu", "cal_sigma", "_alt")


def below_assignability(ledger: DataFrame, degeneracy: DataFrame, saturation: int = 2) -> DataFrame:
    """Owners of eleven oxygens or more in a saturated mass window."""
    el = fx.counts(F.col("neutral_formula"))
    return ledger.where((F.col("role") == "M0") & (el["O"] >= 11)).join(
        degeneracy.where(F.col("density") > saturation), PEAK, "left_semi"
    ).select(*PEAK)


# ------------------------------------------------------------------ clears, demotions, re-readings
def mass_gate_clears(ledger: DataFrame, cal: DataFrame) -> DataFrame:
    """Unlocked owners whose calibrated error cannot be right, with the reason."""
    parents = ledger.where("role = 'iso_child'").select("sample_item_id", F.col("parent_peak_id").alias("peak_id")).distinct().withColumn("_kids", F.lit(True))
    rows = with_calibration(ledger.where((F.col("role") == "M0") & ~F.coalesce("locked", F.lit(False))), cal).join(parents, PEAK, "left")
    weak = ~F.coalesce("confidence", F.lit("")).rlike("^(High|Good)")
    bare = F.col("_kids").isNull()
    z = z_score(F.col("ppm_error"), F.col("cal_mu"), F.col("cal_sigma"))
    reason = (
        F.when(F.col("cal_mu").isNull(), F.lit(None))
        .when(F.col("ppm_error").isNull() & weak & bare, "no mass error")
        .when(z > Z_PATTERN, "beyond pattern band")
        .when((z > Z_ACCEPT) & weak & bare, "no pattern evidence")
    )
    return rows.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*PEAK, "reason")


def demotions(ledger: DataFrame, degeneracy: DataFrame | None = None) -> DataFrame:
    """Owners that lose the Assigned tier, one audit row each: before, after, reason."""
    el, hc = F.col("el"), None
    rows = fx.with_counts(ledger.where("role = 'M0'"), "neutral_formula")
    hc = (el["H"] + el["F"]) / F.greatest(el["C"], F.lit(1))
    pfca = (el["O"] == 2) & (el["H"] == 1) & (el["F"] == el["C"] * 2 - 1)
    if degeneracy is not None:
        rows = rows.join(degeneracy.select(*PEAK, F.col("density").alias("_deg")), PEAK, "left")
    else:
        rows = rows.withColumn("_deg", F.lit(0))
    reason = (
        F.when((el["F"] >= 4) & ~pfca & (fx.n(el, "Cl", "Br", "S") == 0), "unconfirmed fluorine")
        .when((el["C"] >= 2) & (hc < 0.35), "carbon-rich")
        .when((implausible(el) == "oxygen lattice") & (F.coalesce("_deg", F.lit(0)) > 2), "oxygen monster")
        .when(implausible(el) == "carbon cluster", "carbon cluster")
    )
    return rows.withColumn("reason", reason).where(F.col("reason").isNotNull() & (F.col("tier") == "Assigned")).select(
        *PEAK, "neutral_formula", F.col("tier").alias("before_tier"), F.lit("Candidate").alias("after_tier"), "reason"
    )


def apply_demotions(ledger: DataFrame, audit: DataFrame) -> DataFrame:
    hit = audit.select(*PEAK, F.col("after_tier").alias("_t")).dropDuplicates(PEAK)
    return ledger.join(hit, PEAK, "left").withColumn("tier", F.coalesce("_t", "tier")).select(*ledger.columns)


def prefer_adduct_reading(rows: DataFrame, element: str) -> DataFrame:
    """Read a reagent halogen in the neutral as part of the ion form where that is the same ion.

    With Y = X - HX valid and carbon-bearing: deprotonated X reads as Y with the
    halide, X on the halide channel as Y on the HX cluster, and any other
    channel as Y with HX in front, if such a form is modelled.
    """
    hx = f"H{element}"
    base = fx.with_counts(rows, "neutral_formula", "_el").withColumn(
        "_y", fx.shifted(F.col("_el"), {"H": -1, element: -1})
    )
    y = F.col("_y")
    ok = y.isNotNull() & fx.structure_ok(y) & (y["O"] <= fx.oxygen_cap(y)) & (y["C"] >= 1)
    target = F.when(F.col("adduct") == "[M-H]-", f"[M+{element}]-")
    for a in fx.ADDUCTS:
        new = f"[M+{hx}+{a[3:-2]}]-"
        if a.startswith("[M+") and a.endswith("]-") and hx not in a and new in fx.ADDUCTS:
            target = target.when(F.col("adduct") == a, new)
    moves = F.coalesce(ok, F.lit(False)) & target.isNotNull()
    return base.select(
        *[c for c in rows.columns if c not in ("neutral_formula", "adduct")],
        F.when(moves, fx.text(y)).otherwise(F.col("neutral_formula")).alias("neutral_formula"),
        F.when(moves, target).otherwise(F.col("adduct")).alias("adduct"),
    )


def rearbitrate(ledger: DataFrame, cal: DataFrame, winner_dbe_per_c: float = 0.5, min_score: float = 0.6, max_drop: float = 0.25) -> DataFrame:
    """Replacement readings for uncorroborated, off-calibration, highly unsaturated owners.

    Output: ``(sample, peak, formula, adduct, score, ppm)`` of the best stored
    alternative that is on calibration, plausible and less unsaturated.
    """
    kids = ledger.where("role = 'iso_child'").select("sample_item_id", F.col("parent_peak_id").alias("peak_id")).distinct()
    m0 = ledger.where("role = 'M0'")
    lone = m0.groupBy("sample_item_id", "neutral_formula").agg(F.count_distinct("adduct").alias("c")).where("c < 2").drop("c")
    rows = with_calibration(m0.join(kids, PEAK, "left_anti").join(lone, ["sample_item_id", "neutral_formula"], "left_semi"), cal)
    el = F.col("_el")
    own_dbe = fx.dbe(el)
    z = z_score(F.col("ppm_error"), F.col("cal_mu"), F.col("cal_sigma"))
    rows = rows.where((z > Z_TAIL) & ~F.coalesce("locked", F.lit(False)) & ~F.coalesce("method", F.lit("")).startswith("known"))
    rows = fx.with_counts(rows, "neutral_formula", "_el").where(
        (el["C"] >= 1) & (own_dbe / F.greatest(el["C"], F.lit(1)) >= winner_dbe_per_c)
    ).withColumn("own_dbe", own_dbe)

    def fit(a: Column) -> Column:
        c = fx.counts(a["formula"])
        score = F.coalesce(a["raw_score"], a["ion_score"])
        return (
            (z_score(a["ppm"], F.col("cal_mu"), F.col("cal_sigma")) <= Z_ACCEPT) & (fx.dbe(c) < F.col("own_dbe"))
            & implausible(c).isNull() & (score >= min_score) & (F.col("ion_score") - score <= max_drop)
        )

    best = F.array_min(
        F.transform(
            F.filter("alternatives", fit),
            lambda a: F.struct(
                (-F.coalesce(a["raw_score"], a["ion_score"])).alias("ns"),
                z_score(a["ppm"], F.col("cal_mu"), F.col("cal_sigma")).alias("z"), a["formula"].alias("formula"),
                a["adduct"].alias("adduct"), a["ppm"].alias("ppm"),
            ),
        )
    )
    return rows.withColumn("b", best).where(F.col("b").isNotNull()).select(
        *PEAK, F.col("b.formula").alias("formula"), F.col("b.adduct").alias("adduct"), (-F.col("b.ns")).alias("score"), F.col("b.ppm").alias("ppm")
    )


def corroborating_channel(ledger: DataFrame, adducts: Sequence[str]) -> DataFrame:
    """(sample, neutral) pairs owned under any of the given ion forms."""
    return ledger.where((F.col("role") == "M0") & F.col("adduct").isin(*adducts)).select("sample_item_id", "neutral_formula").distinct()
