"""Queries over formulas, homologous series and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionloom.functions import formula as fx
from ionloom.operators import ledger as led
from ionloom.operators import matrix, report, rules, sampling, series
from ionloom.plans import adapters as ad
from ionloom.plans.adapters import CELLS, FORMULAS, LEDGER, LROWS, PEAKS
from ionloom.plans.registry import query
from ionloom.session import cut_lineage


def _n(e: str) -> str:
    return (
        f"CASE WHEN NOT contains(neutral_formula, '{e}') THEN 0 WHEN regexp_extract(neutral_formula, '{e}([0-9]*)', 1) = '' THEN 1 "
        f"ELSE CAST(regexp_extract(neutral_formula, '{e}([0-9]*)', 1) AS INT) END"
    )


FC = f"""{FORMULAS},
fc AS (SELECT *, 1 + nc + nn / 2.0 - nh / 2.0 AS dbe FROM (
  SELECT neutral_formula, {_n('C')} AS nc, {_n('H')} AS nh, {_n('N')} AS nn, {_n('O')} AS no FROM formulas))"""
TEXT = """CASE WHEN nc = 1 THEN 'C' WHEN nc > 1 THEN 'C' || nc ELSE '' END || CASE WHEN nh = 1 THEN 'H' WHEN nh > 1 THEN 'H' || nh ELSE '' END
  || CASE WHEN nn = 1 THEN 'N' WHEN nn > 1 THEN 'N' || nn ELSE '' END || CASE WHEN no = 1 THEN 'O' WHEN no > 1 THEN 'O' || no ELSE '' END"""
BACKBONE = "CASE WHEN ns > 0 THEN 'CHOS' WHEN nn > 0 THEN 'CHON' ELSE 'CHO' END"
MASS = "nc * 12.0::DOUBLE + nh * 1.0078250319::DOUBLE + nn * 14.0030740052::DOUBLE + no * 15.9949146221::DOUBLE"


@query("FX_formula_columns", f"""WITH {FC}
SELECT neutral_formula, nc, nh, nn, no, {TEXT} AS canonical, round({MASS}, 7) AS mass, dbe,
  dbe >= 0 AND dbe = floor(dbe) AND dbe <= nc + nn / 2.0 + 1 AS valid, no <= 2 * (nc + nn) + 4 AS o_ok,
  round(least(3 * nn * 0.01, 0.2), 6) AS penalty, CASE WHEN nn > 0 THEN 'CHON' ELSE 'CHO' END AS klass,
  round({MASS} - round_even({MASS}, 0), 7) AS defect,
  round(({MASS}) * 14 / 14.0156500638 - round_even(({MASS}) * 14 / 14.0156500638, 0), 6) + 0.0 AS kmd
FROM fc""")
def fx_cols(spark, sf):
    el, m = F.col("el"), F.col("mass")
    d = ad.formulas(spark, sf).withColumn("el", fx.counts(F.col("neutral_formula"))).withColumn("mass", fx.mass(F.col("el")))
    return d.select(
        "neutral_formula", el["C"].alias("nc"), el["H"].alias("nh"), el["N"].alias("nn"), el["O"].alias("no"),
        fx.text(el).alias("canonical"), F.round(m, 7).alias("mass"), fx.dbe(el).alias("dbe"), fx.structure_ok(el).alias("valid"),
        (el["O"] <= fx.oxygen_cap(el)).alias("o_ok"), F.round(fx.complexity_penalty(el), 6).alias("penalty"),
        fx.full_class(el).alias("klass"), F.round(fx.mass_defect(m), 7).alias("defect"),
        F.round(fx.kendrick_defect(m, "CH2", 14), 6).alias("kmd"),
    )


PROFILE = rules.Profile(h_to_c=(0.4, 2.6), o_to_c=(0.0, 1.2), n_to_c=(0.0, 0.5), dbe_to_c=(0.0, 0.9), caps={"N": 1}, min_carbon={"N": 2})


@query("F6_profile_filter", f"""WITH {FC}
SELECT neutral_formula, CASE WHEN dbe < 0 THEN 'negative DBE' WHEN dbe <> floor(dbe) THEN 'half-integer DBE'
  WHEN dbe > nc + nn / 2.0 + 1 THEN 'above Senior cap' WHEN nc = 0 THEN 'no carbon' WHEN nn > 1 THEN 'N above 1'
  WHEN nn >= 1 AND nc < 2 THEN 'N needs C>=2'
  WHEN nc >= 3 AND NOT nh / nc BETWEEN 0.4 AND 2.6 THEN 'H/C out of window' WHEN nc >= 3 AND NOT no / nc BETWEEN 0 AND 1.2 THEN 'O/C out of window'
  WHEN nc >= 3 AND NOT nn / nc BETWEEN 0 AND 0.5 THEN 'N/C out of window' WHEN nc >= 3 AND NOT dbe / nc BETWEEN 0 AND 0.9 THEN 'DBE/C out of window'
  WHEN nc < 3 AND no > 2 * nc + 2 THEN 'too much O' WHEN nc < 3 AND nn > nc + 1 THEN 'too much N' END AS reason FROM fc""")
def f6(spark, sf):
    return rules.filter_by_profile(ad.formulas(spark, sf), PROFILE)


IMPLAUSIBLE = """CASE WHEN nc = 0 THEN NULL WHEN no / nc > 1.3 THEN 'oxygen lattice' WHEN nn >= 3 AND no / nc >= 1 THEN 'N and O/C'
  WHEN nn >= 4 AND no >= 8 THEN 'N and O' WHEN nc >= 2 AND dbe = floor(dbe) AND dbe / nc >= 1 THEN 'carbon cluster'
  WHEN nh / nc < 0.35 THEN 'carbon-rich' END"""


@query("F7_implausible", f"WITH {FC} SELECT neutral_formula, {IMPLAUSIBLE} AS reason FROM fc")
def f7(spark, sf):
    d = ad.formulas(spark, sf)
    return d.select("neutral_formula", rules.implausible(fx.counts(F.col("neutral_formula"))).alias("reason"))


@query("F8_scan_implausible", f"""WITH {LROWS},
g AS (SELECT neutral_formula, nc, nh, nn, no, ns, nsi, 1 + nc + nsi + nn / 2.0 - nh / 2.0 AS dbe, bool_or(tier = 'Assigned') AS a, max(ion_score) AS ion_score
  FROM lrows WHERE role = 'M0' GROUP BY ALL)
SELECT neutral_formula, {IMPLAUSIBLE} AS reason, round(ion_score, 6) AS ion_score FROM g WHERE NOT a AND {IMPLAUSIBLE} IS NOT NULL""")
def f8(spark, sf):
    m0 = ad.ledger_rows(spark, sf).where("role = 'M0'")
    return rules.scan_implausible(m0).withColumn("ion_score", F.round("ion_score", 6))


@query("F9_family_gate", f"""WITH {FC} SELECT neutral_formula, dbe >= 0 AND dbe = floor(dbe) AND dbe <= nc + nn / 2.0 + 1
  AND no <= 2 * (nc + nn) + 4 AND nn <= 1 AND no <= 6 AS ok FROM fc""")
def f9(spark, sf):
    el = fx.counts(F.col("neutral_formula"))
    return ad.formulas(spark, sf).select("neutral_formula", rules.family_ok(el, {"N": 1, "O": 6}).alias("ok"))


@query("F13_oligomers", f"""WITH {LROWS} SELECT DISTINCT neutral_formula, nc AS "nC", no AS "nO" FROM lrows
WHERE role = 'M0' AND nc BETWEEN 18 AND 40 AND no >= 7 AND nsi = 0""")
def f13(spark, sf):
    return report.oligomers(ad.ledger_rows(spark, sf).where("role = 'M0'"))


@query("F3_split_categories", f"""WITH {LROWS}, r AS (
  SELECT l.sample_item_id, l.peak_id, l.mz, CASE l.role WHEN 'M0' THEN 'parent' WHEN 'iso_child' THEN 'iso' ELSE 'unexplained' END AS kind,
    CASE WHEN l.role = 'iso_child' THEN p.tier ELSE l.tier END AS t
  FROM lrows l LEFT JOIN lrows p ON l.role = 'iso_child' AND p.role = 'M0' AND p.sample_item_id = l.sample_item_id AND p.peak_id = l.parent_peak_id
  WHERE l.role IN ('M0', 'iso_child', 'unexplained'))
SELECT sample_item_id, peak_id, round(mz - round_even(mz, 0), 7) AS md,
  CASE WHEN kind = 'unexplained' THEN kind WHEN t = 'Assigned' THEN 'assigned_' || kind WHEN t = 'Candidate' THEN 'cand_' || kind END AS category
FROM r WHERE kind = 'unexplained' OR t IS NOT NULL""")
def f3(spark, sf):
    c = report.split_categories(ad.ledger_rows(spark, sf))
    return c.select("sample_item_id", "peak_id", F.round("md", 7).alias("md"), "category")


@query("F4_ppm_points", f"""WITH {LROWS} SELECT sample_item_id, peak_id, round(ppm_error - 0.1, 6) AS ppm_error, tier FROM lrows WHERE role = 'M0'""")
def f4(spark, sf):
    l = ad.ledger_rows(spark, sf).withColumn("ppm_error_cal", F.col("ppm_error") - 0.1)
    return report.ppm_points(l).select("sample_item_id", "peak_id", F.round("ppm_error", 6).alias("ppm_error"), "tier")


@query("F5_plot_points", f"""WITH {LROWS} SELECT round_even(mz, 4) AS mz, CAST(round_even(log10(greatest(height, 1)) * 10, 0) AS BIGINT) AS db,
  CASE WHEN role = 'M0' THEN CASE WHEN tier = 'Assigned' THEN 0 ELSE 1 END ELSE 2 END AS category
FROM lrows WHERE role IN ('M0', 'unexplained') AND height < 90000""")
def f5(spark, sf):
    return report.plot_points(ad.ledger_rows(spark, sf).withColumn("synthetic", F.col("height") >= 90000))


@query("J17_isotopologue_sheet", f"""WITH {LROWS}
SELECT l.sample_item_id, l.peak_id, l.iso_label, p.neutral_formula AS parent_neutral_formula, p.adduct AS parent_adduct, round(p.mz, 7) AS parent_mz
FROM lrows l LEFT JOIN lrows p ON p.role = 'M0' AND p.sample_item_id = l.sample_item_id AND p.peak_id = l.parent_peak_id WHERE l.role = 'iso_child'""")
def j17(spark, sf):
    s = report.isotopologue_sheet(ad.ledger_rows(spark, sf))
    return s.select("sample_item_id", "peak_id", "iso_label", "parent_neutral_formula", "parent_adduct", F.round("parent_mz", 7).alias("parent_mz"))


NEUTRALS = "neu AS (SELECT DISTINCT neutral_formula, nc, nh, nn, no, ns, nsi FROM lrows WHERE role = 'M0')"
TWINS = """tw AS (SELECT a.neutral_formula, a.ns, a.nn, b.neutral_formula AS twin FROM neu a JOIN neu b
  ON b.nc = a.nc AND b.nh = a.nh - 3 AND b.nn = a.nn - 1 AND b.no = a.no AND b.ns = a.ns AND b.nsi = a.nsi WHERE a.nn >= 1 AND a.nh >= 3)"""


@query("J20_shadowed_amines", f"WITH {LROWS}, {NEUTRALS}, {TWINS} SELECT neutral_formula, twin FROM tw")
def j20(spark, sf):
    return report.shadowed_amines(ad.ledger_rows(spark, sf).where("role = 'M0'"))


@query("A12_collapsed_composition", f"""WITH {LROWS}, {NEUTRALS}, {TWINS},
a AS (SELECT {BACKBONE} AS klass, count(*) AS n FROM neu GROUP BY 1), d AS (SELECT {BACKBONE} AS klass, count(*) AS k FROM tw GROUP BY 1)
SELECT klass, n AS as_assigned, n - coalesce(k, 0) AS collapsed FROM a LEFT JOIN d USING (klass)""")
def a12(spark, sf):
    return report.collapsed_composition(ad.ledger_rows(spark, sf).where("role = 'M0'"))


@query("A11_signal_by_backbone", f"""WITH {LROWS}, s AS (SELECT neutral_formula, {BACKBONE} AS klass, sum(height) AS s FROM lrows WHERE role = 'M0' GROUP BY 1, 2)
SELECT klass, count(*) AS n_neutrals, round(sum(s), 2) AS signal, round(sum(s) / sum(sum(s)) OVER (), 9) AS share FROM s GROUP BY 1""")
def a11(spark, sf):
    s = report.signal_by_backbone(report.neutral_signal(ad.ledger_rows(spark, sf)))
    return s.select("klass", "n_neutrals", F.round("signal", 2).alias("signal"), F.round("share", 9).alias("share"))


@query("W14_top_species", f"""WITH {LROWS}, s AS (SELECT neutral_formula, {BACKBONE} AS klass, sum(height) AS s FROM lrows WHERE role = 'M0' GROUP BY 1, 2)
SELECT neutral_formula, round(s, 2) AS signal, round(s / (SELECT sum(s) FROM s), 9) AS frac, klass FROM s ORDER BY s DESC, neutral_formula LIMIT 8""")
def w14(spark, sf):
    t = report.top_species(report.neutral_signal(ad.ledger_rows(spark, sf)))
    return t.select("neutral_formula", F.round("signal", 2).alias("signal"), F.round("frac", 9).alias("frac"), "klass")


STATS = """st AS (SELECT role, count(*) FILTER (height < 90000) AS n_peaks, sum(height * CASE WHEN tier = 'Candidate' THEN 0.75 ELSE 1 END) AS signal FROM lrows GROUP BY 1)"""


def _stats(spark, sf):
    l = ad.ledger_rows(spark, sf).withColumn("synthetic", F.col("height") >= 90000)
    l = l.withColumn("assigned_fraction", F.when(F.col("tier") == "Candidate", 0.75))
    return l, led.effective_stats(l)


@query("A10_effective_stats", f"""WITH {LROWS}, {STATS} SELECT role, n_peaks, round(signal, 2) AS signal,
  round(n_peaks / sum(n_peaks) OVER (), 9) AS count_share, round(signal / sum(signal) OVER (), 9) AS signal_share FROM st""")
def a10(spark, sf):
    s = _stats(spark, sf)[1]
    return s.select("role", "n_peaks", F.round("signal", 2).alias("signal"), F.round("count_share", 9).alias("count_share"),
                    F.round("signal_share", 9).alias("signal_share"))


@query("A15_summary_stats", f"""WITH {LROWS}, {STATS}
SELECT 'Run' AS section, 'peaks total' AS metric, CAST(CAST(sum(n_peaks) AS BIGINT) AS VARCHAR) AS value FROM st
UNION ALL SELECT 'Coverage', role, printf('%d (%.1f%% of peaks, %.1f%% of signal)', n_peaks, 100.0 * n_peaks / (SELECT sum(n_peaks) FROM st)::DOUBLE, 100.0 * signal / (SELECT sum(signal) FROM st)) FROM st
UNION ALL SELECT 'Tiers', tier, CAST(count(*) AS VARCHAR) FROM lrows WHERE role = 'M0' GROUP BY tier
UNION ALL SELECT 'Confidence', split_part(confidence, ' ', 1), CAST(count(*) AS VARCHAR) FROM lrows WHERE role = 'M0' GROUP BY 2
UNION ALL SELECT 'Methods', method, CAST(count(*) AS VARCHAR) FROM lrows WHERE role = 'M0' GROUP BY 2""")
def a15(spark, sf):
    l, s = _stats(spark, sf)
    return report.summary_stats(s, l)


@query("A13_by_class", f"""WITH {LROWS} SELECT {BACKBONE} AS compound_class, CASE WHEN nsi > 0 THEN 'Si' ELSE '' END AS heteroatoms, count(*) AS n_peaks,
  count(*) FILTER (tier = 'Assigned') AS n_identified, count(*) FILTER (tier <> 'Assigned') AS n_candidates, round(sum(height), 2) AS signal
FROM lrows WHERE role = 'M0' GROUP BY 1, 2""")
def a13(spark, sf):
    return report.by_class(ad.ledger_rows(spark, sf)).withColumn("signal", F.round("signal", 2))


@query("A14_unique_formulas", f"""WITH {LROWS} SELECT neutral_formula, count(*) AS n_peaks, array_to_string(list_sort(list(DISTINCT adduct)), '; ') AS adducts,
  CASE WHEN bool_or(tier = 'Assigned') THEN 'Assigned' ELSE 'Candidate' END AS best_tier, round(max(ion_score), 6) AS best_score, round(sum(height), 2) AS signal
FROM lrows WHERE role = 'M0' GROUP BY 1""")
def a14(spark, sf):
    u = report.unique_formulas(ad.ledger_rows(spark, sf))
    return u.withColumn("signal", F.round("signal", 2)).withColumn("best_score", F.round("best_score", 6))


@query("A16_analyte_table", f"""WITH {LROWS}, m AS (SELECT * FROM lrows WHERE role = 'M0' AND nc > 0 AND nsi = 0),
b AS (SELECT *, row_number() OVER (PARTITION BY neutral_formula ORDER BY CASE tier WHEN 'Assigned' THEN 0 ELSE 1 END, mz, peak_id) AS k FROM m),
c AS (SELECT neutral_formula, string_agg(adduct, ' / ' ORDER BY mz, peak_id) AS channels FROM (
   SELECT *, row_number() OVER (PARTITION BY neutral_formula, adduct ORDER BY mz, peak_id) AS k FROM m) WHERE k = 1 GROUP BY 1)
SELECT neutral_formula, peak_id, round(mz, 7) AS mz, tier, nc AS "nC", nh AS "nH", no AS "nO", nn AS "nN", ns AS "nS",
  round(nh / nc, 9) AS hc, round(no / nc, 9) AS oc, {BACKBONE} AS klass, channels FROM b JOIN c USING (neutral_formula) WHERE k = 1""")
def a16(spark, sf):
    a = report.analyte_table(ad.ledger_rows(spark, sf))
    for c, d in (("mz", 7), ("hc", 9), ("oc", 9)):
        a = a.withColumn(c, F.round(c, d))
    return a


@query("A19_run_rollups", f"""WITH {LROWS}, s AS (SELECT 'role' AS grouping, role AS name, height, ion_score FROM lrows
  UNION ALL SELECT 'tier', tier, height, ion_score FROM lrows WHERE role = 'M0' UNION ALL SELECT 'adduct', adduct, height, ion_score FROM lrows WHERE role = 'M0')
SELECT grouping, name, count(*) AS n, round(sum(height), 2) AS signal, round(avg(ion_score), 8) AS mean_score,
  round(sum(height) / sum(sum(height)) OVER (PARTITION BY grouping), 9) AS share FROM s GROUP BY 1, 2""")
def a19(spark, sf):
    r = report.run_rollups(ad.ledger_rows(spark, sf))
    return r.select("grouping", "name", "n", F.round("signal", 2).alias("signal"), F.round("mean_score", 8).alias("mean_score"), F.round("share", 9).alias("share"))


APPENDIX = """kid AS (SELECT p.neutral_formula, p.adduct, l.iso_label FROM lrows l JOIN lrows p ON p.role = 'M0' AND p.sample_item_id = l.sample_item_id
   AND p.peak_id = l.parent_peak_id WHERE l.role = 'iso_child'),
ki AS (SELECT neutral_formula, adduct, array_to_string(list_sort(list(DISTINCT iso_label)), ', ') AS isotopes FROM kid GROUP BY 1, 2),
ch AS (SELECT neutral_formula, adduct, max(height) AS max_height, count(DISTINCT src) AS n_files, avg(mz) AS mz, any_value(mass) AS mass FROM lrows WHERE role = 'M0' GROUP BY 1, 2)"""


@query("A19_A29_assignment_appendix", f"""WITH {LROWS}, {APPENDIX}
SELECT neutral_formula, adduct, round(max_height, 2) AS max_height, n_files, round(mz, 6) AS mz, isotopes, round(mass, 6) AS mass
FROM ch LEFT JOIN ki USING (neutral_formula, adduct)""")
def a29(spark, sf):
    a = report.appendix(ad.ledger_rows(spark, sf))
    return a.withColumn("mz", F.round("mz", 6)).withColumn("mass", F.round("mass", 6)).withColumn("max_height", F.round("max_height", 2))


@query("A22_channels_per_neutral", f"""WITH {LROWS} SELECT neutral_formula, count(DISTINCT adduct) AS n_channels,
  array_to_string(list_sort(list(DISTINCT adduct)), ',') AS adducts FROM lrows WHERE role = 'M0' GROUP BY 1""")
def a22(spark, sf):
    return report.channels_per_neutral(ad.ledger_rows(spark, sf))


@query("A21_best_evidence", f"""WITH {LROWS}, k AS (SELECT sample_item_id, parent_peak_id AS peak_id, count(*) AS iso FROM lrows WHERE role = 'iso_child' GROUP BY 1, 2),
m AS (SELECT l.*, coalesce(k.iso, 0) AS iso, row_number() OVER (PARTITION BY neutral_formula ORDER BY abs(ppm_error), l.peak_id) AS rn
  FROM lrows l LEFT JOIN k ON k.sample_item_id = l.sample_item_id AND k.peak_id = l.peak_id WHERE role = 'M0')
SELECT neutral_formula, round(ppm_error, 6) AS ppm, iso, round(eff_margin, 6) AS margin,
  CASE WHEN NOT (nn + 2 >= 3 AND (no + 9) / nc >= 1.0 OR (no + 9) / nc > 1.3 OR nn + 2 >= 4 AND no + 9 >= 8) THEN 'C' || nc || 'H' || (2 * nc) || 'N' || (nn + 2) || 'O' || (no + 9)
       ELSE 'C30H50O3' END AS sane_alt FROM m WHERE rn = 1""")
def a21(spark, sf):
    el = F.col("el")
    l = ad.ledger_rows(spark, sf).withColumn("el", fx.counts(F.col("neutral_formula")))
    monster = F.concat(F.lit("C"), el["C"].cast("string"), F.lit("H"), (el["C"] * 2).cast("string"),
                       F.lit("N"), (el["N"] + 2).cast("string"), F.lit("O"), (el["O"] + 9).cast("string"))
    l = l.withColumn("alternatives", F.array(
        F.struct(monster.alias("formula"), F.col("ppm_error").alias("ppm")),
        F.struct(F.lit("C30H50O3").alias("formula"), F.lit(0.0).alias("ppm"))))
    e = report.best_evidence(l)
    return e.withColumn("ppm", F.round("ppm", 6)).withColumn("margin", F.round("margin", 6))


@query("A26_drift_trend", f"""WITH {LROWS} SELECT count(*) AS n, round(regr_slope(ppm_error, mz), 10) AS slope, round(regr_intercept(ppm_error, mz), 8) AS intercept,
  round(median(ppm_error), 8) AS median FROM lrows WHERE role = 'M0'""")
def a26(spark, sf):
    d = report.drift_trend(ad.ledger_rows(spark, sf).where("role = 'M0'").select("mz", "ppm_error"))
    return d.select("n", F.round("slope", 10).alias("slope"), F.round("intercept", 8).alias("intercept"), F.round("median", 8).alias("median"))


@query("A27_event_fold", f"""WITH {PEAKS}, s AS (SELECT datetime_utc, sum(height) AS total FROM peaks GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY datetime_utc) - 1 AS t, count(*) OVER () AS n,
  (epoch(datetime_utc) - epoch(min(datetime_utc) OVER ())) / 3600.0 AS hours FROM s)
SELECT round(max(total), 2) AS peak, round(median(total) FILTER (t >= greatest(1, floor(n * 2 / 3))), 3) AS base, round(arg_max(hours, total), 6) AS peak_hour,
  round(max(total) / median(total) FILTER (t >= greatest(1, floor(n * 2 / 3))), 8) AS fold FROM r""")
def a27(spark, sf):
    from ionloom.operators import traces as tr

    s = sampling.sample_table(ad.peaks(spark, sf)).select(
        "sample_item_id", F.col("tic").alias("total"), (F.unix_micros("datetime_utc") / 3.6e9).cast("long").alias("hr")
    )
    e = report.event_fold(cut_lineage(tr.with_axis(s, "hr", 1.0)))
    return e.select(F.round("peak", 2).alias("peak"), F.round("base", 3).alias("base"), F.round("peak_hour", 6).alias("peak_hour"), F.round("fold", 8).alias("fold"))


@query("A28_family_rollup", f"""WITH {LROWS}, m AS (SELECT src AS cluster, neutral_formula, nc, no, median(height) AS med FROM lrows WHERE role = 'M0' GROUP BY 1, 2, 3, 4),
b AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY med DESC, neutral_formula) AS k FROM m)
SELECT cluster, count(*) AS n, round(median(no / nc), 9) AS median_oc, string_agg(neutral_formula, ', ' ORDER BY k) FILTER (k <= 4) AS brightest FROM b GROUP BY 1""")
def a28(spark, sf):
    from ionloom.functions.quantiles import exact_quantiles

    m0 = ad.ledger_rows(spark, sf).where("role = 'M0'").withColumnRenamed("src", "cluster")
    m = exact_quantiles(m0, ["cluster", "neutral_formula"], "height", {"median": 0.5})
    return report.family_rollup(m).withColumn("median_oc", F.round("median_oc", 9))


ISO_ERR = """kidsmz AS (SELECT sample_item_id, mz AS kid_mz FROM lrows WHERE role = 'iso_child'),
ie AS (SELECT l.sample_item_id, l.peak_id, coalesce(max(CASE WHEN k.kid_mz < l.mz + 1.0033548 THEN k.kid_mz END), min(CASE WHEN k.kid_mz >= l.mz + 1.0033548 THEN k.kid_mz END)) AS kid, l.mz + 1.0033548 AS tgt
  FROM lrows l JOIN kidsmz k ON k.sample_item_id = l.sample_item_id AND abs(k.kid_mz - (l.mz + 1.0033548)) / (l.mz + 1.0033548) * 1e6 <= 6 WHERE l.role = 'M0' GROUP BY ALL),
iso_ppm AS (SELECT sample_item_id, peak_id, (kid - tgt) / tgt * 1e6 AS ppm FROM ie)"""


@query("J22_isotopologue_error", f"WITH {LROWS}, {ISO_ERR} SELECT sample_item_id, peak_id, round(ppm, 6) AS ppm FROM iso_ppm")
def j22(spark, sf):
    return report.isotopologue_error(ad.ledger_rows(spark, sf)).withColumn("ppm", F.round("ppm", 6))


@query("A30_error_quartiles", f"""WITH {LROWS}, {ISO_ERR}, a AS (SELECT tier AS category, ppm_error AS ppm FROM lrows WHERE role = 'M0' UNION ALL SELECT 'isotopologue', ppm FROM iso_ppm)
SELECT category, round(quantile_cont(ppm, 0.25), 6) AS q1, round(median(ppm), 6) AS q2, round(quantile_cont(ppm, 0.75), 6) AS q3 FROM a GROUP BY 1""")
def a30(spark, sf):
    q = report.error_quartiles(ad.ledger_rows(spark, sf))
    return q.select("category", *[F.round(c, 6).alias(c) for c in ("q1", "q2", "q3")])


@query("J21_explained_bins", f"""WITH {CELLS}, {LEDGER}, s AS (SELECT bin, sum(height) AS s FROM cells GROUP BY 1),
h AS (SELECT DISTINCT bin FROM bins JOIN ledger l ON abs(l.mz - bin_mz) / bin_mz * 1e6 <= 3)
SELECT count(*) AS n_bins, count(h.bin) AS n_explained, round(sum(CASE WHEN h.bin IS NOT NULL THEN s ELSE 0 END), 2) AS s_explained, round(sum(s), 2) AS s_total
FROM s LEFT JOIN h USING (bin)""")
def j21(spark, sf):
    binned = matrix.binned_peaks(ad.peaks(spark, sf))
    e = report.explained_share(matrix.matrix_cells(binned), matrix.bin_table(binned), ad.ledger_ions(spark, sf), 3.0)
    return e.select("n_bins", "n_explained", F.round("s_explained", 2).alias("s_explained"), F.round("s_total", 2).alias("s_total"))


@query("A20_channel_batch_max", f"""WITH {CELLS}, {LEDGER}, k AS (SELECT neutral_formula || '|' || adduct || '|' || CAST(round(mz * 1000) AS BIGINT) AS key, mz FROM ledger),
hit AS (SELECT * FROM (SELECT k.key, b.bin, row_number() OVER (PARTITION BY key ORDER BY abs(bin_mz - mz), bin_mz) AS rn FROM k JOIN bins b ON abs(bin_mz - mz) / mz * 1e6 <= 8) WHERE rn = 1)
SELECT key, round(max(height), 2) AS max_height FROM hit JOIN cells USING (bin) GROUP BY 1""")
def a20(spark, sf):
    from ionloom.plans.matrix_queries import ion_keys

    binned = matrix.binned_peaks(ad.peaks(spark, sf))
    m = report.batch_maxima(matrix.matrix_cells(binned), matrix.bin_table(binned), ion_keys(spark, sf))
    return m.withColumn("max_height", F.round("max_height", 2))


# ------------------------------------------------------------------ homologous series
SERIES_UNITS = {"a": 0.1, "b": 0.3, "c": 0.7317}
LADDER = "lad AS (SELECT 'b' || (p_size % 2) AS sample_item_id, p_retailprice AS mz, p_partkey || '' AS peak_id FROM part)"


def ladder(spark, sf):
    return ad.table(spark, sf, "part").select(
        F.concat(F.lit("b"), (F.col("p_size") % 2).cast("string")).alias("sample_item_id"),
        F.col("p_retailprice").alias("mz"), F.col("p_partkey").cast("string").alias("peak_id"),
    )


def _hit(shift: str) -> str:
    return (f"EXISTS (SELECT 1 FROM pos q WHERE q.sample_item_id = p.sample_item_id AND q.mz BETWEEN (p.mz + {shift}) * (1 - 6e-6) AND (p.mz + {shift}) * (1 + 6e-6) "
            f"AND abs(q.mz - (p.mz + {shift})) <= (p.mz + {shift}) * 5e-6)")


EVIDENCE = f"""{LADDER}, pos AS (SELECT sample_item_id, mz, count(*) AS k FROM lad GROUP BY 1, 2),
u AS (SELECT * FROM (VALUES ('a', 0.1::DOUBLE), ('b', 0.3::DOUBLE), ('c', 0.7317::DOUBLE)) t(unit, mass)),
x AS (SELECT p.sample_item_id, unit, sum(CASE WHEN {_hit('mass')} THEN k ELSE 0 END) AS n,
   sum(CASE WHEN {_hit('mass')} AND {_hit('mass * 2')} THEN k ELSE 0 END) AS c3,
   (sum(CASE WHEN {_hit('mass + 0.0317')} THEN k ELSE 0 END) + sum(CASE WHEN {_hit('mass - 0.0473')} THEN k ELSE 0 END) + sum(CASE WHEN {_hit('mass + 0.0689')} THEN k ELSE 0 END)) / 3.0 AS dm
  FROM pos p CROSS JOIN u GROUP BY 1, 2),
ev AS (SELECT sample_item_id, unit, CAST(n AS BIGINT) AS n_links, CAST(c3 AS BIGINT) AS n_chains3, round_even(dm, 1) AS decoy_mean,
  round_even(CASE WHEN dm > 0 THEN n / dm ELSE n END, 2) AS enrichment, n >= 12 AND CASE WHEN dm > 0 THEN n / dm ELSE n END >= 3 AS significant FROM x)"""


@query("G1_G2_unit_evidence", f"WITH {EVIDENCE} SELECT * FROM ev")
def g1(spark, sf):
    return series.unit_evidence(ladder(spark, sf), SERIES_UNITS)


@query("G4_unit_members", f"""WITH {LADDER}, pos AS (SELECT DISTINCT sample_item_id, mz FROM lad)
SELECT p.sample_item_id, p.peak_id FROM lad p WHERE {_hit('0.3')} OR {_hit('(-0.3)')}""")
def g4(spark, sf):
    return series.unit_members(ladder(spark, sf), 0.3).select("sample_item_id", "peak_id")


@query("G4_opened_families", f"""WITH {EVIDENCE}
SELECT DISTINCT CASE unit WHEN 'a' THEN 'fam_a' WHEN 'c' THEN 'fam_c' END AS family FROM ev WHERE significant AND unit IN ('a', 'c')""")
def g4f(spark, sf):
    ev = series.unit_evidence(ladder(spark, sf), SERIES_UNITS)
    return series.opened_families(ev, {"a": "fam_a", "c": "fam_c"})


@query("G3_unit_chains", f"""WITH RECURSIVE {LADDER}, pos AS (SELECT DISTINCT sample_item_id, mz FROM lad),
nxt AS (SELECT p.sample_item_id, p.mz, min(q.mz) AS n FROM pos p JOIN pos q ON q.sample_item_id = p.sample_item_id AND abs(q.mz - (p.mz + 0.7)) <= (p.mz + 0.7) * 5e-6 GROUP BY 1, 2),
heads AS (SELECT * FROM pos p WHERE NOT EXISTS (SELECT 1 FROM pos q WHERE q.sample_item_id = p.sample_item_id AND abs(q.mz - (p.mz - 0.7)) <= (p.mz - 0.7) * 5e-6)),
w AS (SELECT sample_item_id, mz AS head_mz, 0 AS rank, mz FROM heads
      UNION ALL SELECT w.sample_item_id, w.head_mz, w.rank + 1, n.n FROM w JOIN nxt n ON n.sample_item_id = w.sample_item_id AND n.mz = w.mz)
SELECT sample_item_id, head_mz, rank, mz FROM (SELECT *, count(*) OVER (PARTITION BY sample_item_id, head_mz) AS c FROM w) WHERE c >= 3""")
def g3(spark, sf):
    return series.unit_chains(ladder(spark, sf), 0.7, min_len=3)


SERIES = """k AS (SELECT *, least(nc, nh // 2) AS k FROM fc),
r AS (SELECT DISTINCT nc - k AS rc, nh - 2 * k AS rh, nn, no, k FROM k),
run AS (SELECT *, k - row_number() OVER (PARTITION BY rc, rh, nn, no ORDER BY k) AS g FROM r),
ser AS (SELECT *, count(*) OVER (PARTITION BY rc, rh, nn, no, g) AS length, min(k) OVER (PARTITION BY rc, rh, nn, no, g) AS start FROM run)"""


@query("G5_formula_series", f"WITH {FC}, {SERIES} SELECT rc, rh, nn, no, start, length, k FROM ser WHERE length >= 3")
def g5(spark, sf):
    s = series.formula_series(ad.formulas(spark, sf), "CH2")
    part = F.split("residue", ",")
    return s.select(
        part[0].cast("long").alias("rc"), part[1].cast("long").alias("rh"), part[2].cast("long").alias("nn"),
        part[4].cast("long").alias("no"), "start", "length", "k",
    )


@query("G6_family_summary", f"""WITH {FC}, {SERIES}, d AS (SELECT DISTINCT rc, rh, nn, no, start, length FROM ser WHERE length >= 3)
SELECT 'CH2' AS unit, count(*) AS n_series, CAST(sum(length) AS BIGINT) AS n_members, max(length) AS longest, max(length) > 3 AS present FROM d""")
def g6(spark, sf):
    return series.family_summary(series.formula_series(ad.formulas(spark, sf), "CH2"))


@query("T27_diel_class_panels", f"""WITH {LROWS}, {NEUTRALS}, c AS (SELECT *, CASE WHEN nsi > 0 THEN 'Si / siloxane' WHEN nn > 0 AND ns > 0 THEN 'CHONS' WHEN ns > 0 THEN 'CHOS' WHEN nn > 0 THEN 'CHON' ELSE 'CHO' END AS cls FROM neu)
SELECT neutral_formula, 'CHO oxygenated (O>=3)' AS panel FROM c WHERE cls = 'CHO' AND no >= 3
UNION ALL SELECT neutral_formula, 'CHON organonitrates' FROM c WHERE cls = 'CHON'
UNION ALL SELECT neutral_formula, 'fatty acids  CnH2nO2' FROM c WHERE cls = 'CHO' AND nh = 2 * nc AND no = 2
UNION ALL SELECT neutral_formula, 'dicarboxylic  CnH(2n-2)O4' FROM c WHERE cls = 'CHO' AND no = 4 AND nh = 2 * nc - 2
UNION ALL SELECT neutral_formula, 'CHOS / CHONS organosulfur' FROM c WHERE cls IN ('CHOS', 'CHONS')
UNION ALL SELECT neutral_formula, 'Si / siloxane' FROM c WHERE cls = 'Si / siloxane'""")
def t27(spark, sf):
    return rules.class_panels(ad.ledger_rows(spark, sf).where("role = 'M0'"))
