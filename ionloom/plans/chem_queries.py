"""Queries over candidates, isotope partners, claims, tiers and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionloom.functions import formula as fx
from ionloom.operators import audit, axis, certified, chem, claims, factor, matrix, passes, rules
from ionloom.plans import adapters as ad
from ionloom.plans.adapters import BINS, CELLS, LEDGER, LROWS, PEAKS, SPECTRA
from ionloom.plans.registry import query
from ionloom.session import cut_lineage

PEAK = ["sample_item_id", "peak_id"]
ADDUCTS = ("[M-H]-", "[M+Br]-")
BOX = {"C": (4, 23), "H": (0, 60), "N": (0, 2), "O": (0, 8), "S": (0, 1)}
GRID = """grid AS (
  SELECT nc, nh, nn, no, ns, nc * 12.0::DOUBLE + nh * 1.0078250319::DOUBLE + nn * 14.0030740052::DOUBLE + no * 15.9949146221::DOUBLE + ns * 31.97207069::DOUBLE AS mass,
    'C' || nc || CASE WHEN nh = 1 THEN 'H' WHEN nh > 1 THEN 'H' || nh ELSE '' END || CASE WHEN nn = 1 THEN 'N' WHEN nn > 1 THEN 'N' || nn ELSE '' END
      || CASE WHEN no = 1 THEN 'O' WHEN no > 1 THEN 'O' || no ELSE '' END || CASE WHEN ns = 1 THEN 'S' ELSE '' END AS formula
  FROM (SELECT nc, nn, ns, no, 2 * (1 + nc) + nn - 2 * d AS nh FROM (SELECT unnest(range(4, 24)) AS nc), (SELECT unnest(range(0, 3)) AS nn), (SELECT unnest(range(0, 2)) AS ns),
        (SELECT unnest(range(0, 9)) AS no), (SELECT unnest(range(0, 27)) AS d)
        WHERE d <= floor(nc + nn / 2.0 + 1) AND no <= 2 * (nc + nn + ns) + 4) WHERE nh BETWEEN 0 AND 60)"""
SHIFTS = """ads AS (SELECT * FROM (VALUES ('[M-H]-', -1.0078250319::DOUBLE + 0.0005485799::DOUBLE), ('[M+Br]-', 78.9183371::DOUBLE + 0.0005485799::DOUBLE)) t(adduct, shift))"""


def grid(spark, sf):
    return chem.candidate_grid(spark, BOX)


def spectrum_ledger(spark, sf):
    """Spectra as a fresh ledger."""
    s = ad.spectra(spark, sf)
    typed = {"neutral_formula": "string", "adduct": "string", "ion_formula": "string", "ion_score": "double", "ppm_error": "double",
             "confidence": "string", "method": "string", "pass_no": "long", "tier": "string", "parent_peak_id": "string",
             "iso_label": "string", "iso_match_score": "double"}
    s = s.withColumn("role", F.lit("unexplained")).withColumn("locked", F.lit(False))
    for c, t in typed.items():
        s = s.withColumn(c, F.lit(None).cast(t))
    return s


@query("C1_J5_grid_candidates", f"""WITH {SPECTRA}, {GRID}, {SHIFTS},
t AS (SELECT sample_item_id, peak_id, mz, adduct, mz - shift AS m FROM spectra, ads)
SELECT sample_item_id, peak_id, adduct, formula FROM t JOIN grid g ON g.mass BETWEEN t.m - t.m * 3 * 1e-6 AND t.m + t.m * 3 * 1e-6
WHERE abs(g.mass - t.m) <= t.m * 3 * 1e-6 AND g.mass BETWEEN 30 AND 900""")
def c1(spark, sf):
    hits = chem.candidates(ad.spectra(spark, sf).select(*PEAK, "mz"), grid(spark, sf), ADDUCTS)
    return hits.select(*PEAK, "adduct", "formula")


STEPS_SQL = """steps AS (SELECT * FROM (VALUES ('13C', 1.003355::DOUBLE), ('81Br', 1.9979521::DOUBLE), ('81Br2', 3.9959042::DOUBLE), ('37Cl', 1.997050::DOUBLE), ('34S', 1.995796::DOUBLE), ('29Si', 0.999568::DOUBLE)) t(step, delta))"""


@query("J11_offset_partners", f"""WITH {SPECTRA}, st AS (SELECT * FROM (VALUES ('13C', 1.003355::DOUBLE), ('81Br', 1.9979521::DOUBLE)) t(step, delta)),
tg AS (SELECT a.sample_item_id, a.peak_id, s.step, a.mz + s.delta AS target, CAST(floor((a.mz + s.delta) / 0.02) AS BIGINT) + d AS cell
   FROM spectra a CROSS JOIN st s CROSS JOIN (SELECT unnest([-1, 0, 1]) AS d)),
lib AS (SELECT sample_item_id, mz, height, CAST(floor(mz / 0.02) AS BIGINT) AS cell FROM spectra),
h AS (SELECT t.sample_item_id, t.peak_id, t.step, max(b.height) AS h, arg_max(b.mz, (b.height, b.mz)) AS x FROM tg t JOIN lib b
   ON b.sample_item_id = t.sample_item_id AND b.cell = t.cell WHERE abs(b.mz - t.target) <= t.target * 8e-6 GROUP BY 1, 2, 3)
SELECT sample_item_id, peak_id, step, round(h, 4) AS partner_height, round(x, 7) AS partner_mz FROM h""")
def j11(spark, sf):
    s = ad.spectra(spark, sf)
    out = chem.offset_partners(s, s, {"13C": 1.003355, "81Br": 1.9979521})
    return out.select(*PEAK, "step", F.round("partner.h", 4).alias("partner_height"), F.round("partner.x", 7).alias("partner_mz"))


PRESCAN = f"""{STEPS_SQL},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_item_id ORDER BY height DESC, peak_id) AS pl FROM spectra) WHERE pl <= 400),
r0 AS (SELECT a.sample_item_id, a.peak_id, s.step, max(b.height) / any_value(a.height) AS r FROM top a CROSS JOIN steps s JOIN spectra b ON b.sample_item_id = a.sample_item_id
   AND b.mz BETWEEN (a.mz + s.delta) * (1 - 1e-5) AND (a.mz + s.delta) * (1 + 1e-5) WHERE abs(b.mz - (a.mz + s.delta)) <= (a.mz + s.delta) * 8e-6 GROUP BY 1, 2, 3),
r AS (SELECT sample_item_id, peak_id, max(r) FILTER (step = '13C') AS c, max(r) FILTER (step = '81Br') AS b, max(r) FILTER (step = '81Br2') AS b2, max(r) FILTER (step = '37Cl') AS cl,
   max(r) FILTER (step = '34S') AS s, max(r) FILTER (step = '29Si') AS si FROM r0 GROUP BY 1, 2),
f AS (SELECT *, coalesce(b BETWEEN 0.6 AND 1.4, false) AS one, coalesce(b BETWEEN 1.5 AND 2.6 AND b2 BETWEEN 0.6 AND 1.4, false) AS two FROM r),
pre AS (SELECT sample_item_id, bool_or(one OR two) AS has_br, bool_or(two) AS has_multi_br, coalesce(bool_or(NOT one AND NOT two AND cl BETWEEN 0.22 AND 0.45), false) AS has_cl,
   coalesce(bool_or(NOT one AND NOT two AND s BETWEEN 0.025 AND 0.09), false) AS has_s, coalesce(bool_or(NOT one AND NOT two AND si BETWEEN 0.035 AND 0.08), false) AS has_si,
   CAST(coalesce(max(CASE WHEN c BETWEEN 0.003 AND 0.9 THEN round_even(c / 0.0107, 0) END), 0) AS BIGINT) AS max_c FROM f GROUP BY 1)"""


@query("C3_prescan", f"WITH {SPECTRA}, {PRESCAN} SELECT * FROM pre")
def c3(spark, sf):
    return chem.prescan(ad.spectra(spark, sf))


@query("C2_sample_box", f"""WITH {SPECTRA}, {PRESCAN} SELECT sample_item_id, CASE WHEN max_c > 0 THEN greatest(least(23, max_c + 4), 4) ELSE 23 END AS "hi_C",
  CASE WHEN has_br THEN 2 ELSE 0 END AS "hi_Br", CASE WHEN has_cl THEN 2 ELSE 0 END AS "hi_Cl", CASE WHEN has_s THEN 1 ELSE 0 END AS "hi_S", CASE WHEN has_si THEN 1 ELSE 0 END AS "hi_Si" FROM pre""")
def c2(spark, sf):
    return chem.sample_box(chem.prescan(ad.spectra(spark, sf)), BOX, {"Br": 2, "Cl": 2, "S": 1, "Si": 1})


@query("J12_satellite_parents", f"""WITH {CELLS}, m AS (SELECT bin, median(height) AS med FROM cells GROUP BY 1),
b AS (SELECT bins.bin, bin_mz, med FROM bins JOIN m USING (bin)), st AS (SELECT * FROM (VALUES (0, 1.003355::DOUBLE), (1, 0.997035::DOUBLE), (2, 1.995796::DOUBLE), (3, 1.997050::DOUBLE), (4, 1.997953::DOUBLE), (5, 2.004246::DOUBLE)) t(i, s)),
h AS (SELECT b.bin, st.i, k.bin_mz AS x, row_number() OVER (PARTITION BY b.bin ORDER BY st.i, k.bin_mz) AS rn FROM b CROSS JOIN st JOIN b k
   ON abs(k.bin_mz - (b.bin_mz - st.s)) / b.bin_mz * 1e6 <= 8 AND k.med > b.med)
SELECT bin, i AS step_no, round(x, 7) AS parent_mz FROM h WHERE rn = 1""")
def j12(spark, sf):
    from ionloom.functions.quantiles import exact_quantiles

    binned = matrix.binned_peaks(ad.peaks(spark, sf))
    med = exact_quantiles(matrix.matrix_cells(binned), ["bin"], "height", {"median": 0.5})
    b = cut_lineage(matrix.bin_table(binned).join(med, "bin").select("bin", "bin_mz", "median"))
    known = b.select(F.col("bin_mz").alias("x"), F.col("median").alias("known_median"))
    return chem.satellite_parents(b, known, chem.SATELLITE_STEPS).withColumn("parent_mz", F.round("parent_mz", 7))


@query("J14_ringing", f"""WITH {LROWS}, u AS (SELECT * FROM lrows WHERE role = 'unexplained'),
h AS (SELECT u.sample_item_id, u.peak_id, p.mz, p.height, row_number() OVER (PARTITION BY u.sample_item_id, u.peak_id ORDER BY p.height DESC, p.mz DESC) AS rn
  FROM u JOIN lrows p ON p.sample_item_id = u.sample_item_id AND abs(p.mz - u.mz) <= 0.012 AND abs(p.mz - u.mz) > 1e-4 AND p.height >= 50000 AND p.height >= 3 * u.height)
SELECT sample_item_id, peak_id, round(mz, 7) AS parent_mz, height AS parent_height FROM h WHERE rn = 1""")
def j14(spark, sf):
    r = chem.ringing(ad.ledger_rows(spark, sf), factor=3.0)
    return r.withColumn("parent_mz", F.round("parent_mz", 7))


@query("J13_isotope_pairs")
def j13(spark, sf):
    s = ad.spectra(spark, sf)
    return chem.isotope_pairs(s)


OFFSETS = [("[M-H]-", 0, fx.adduct_shift("[M-H]-")), ("[M+Br]-", 0, fx.adduct_shift("[M+Br]-"))]


@query("J15_J16_certificates")
def j15(spark, sf):
    return chem.certificates(ad.spectra(spark, sf), OFFSETS)


@query("A31_certificate_table")
def a31(spark, sf):
    members = cut_lineage(chem.certificates(ad.spectra(spark, sf), OFFSETS))
    return chem.certificate_table(members, grid(spark, sf))


SPECIES = """sp AS (SELECT 'L' || (nc % 3) AS list_id, neutral_formula AS formula, mass, nn > 0 AS radical FROM (SELECT DISTINCT neutral_formula, nc, nn, mass FROM lrows WHERE role = 'M0'))"""


def species(spark, sf):
    el = fx.counts(F.col("neutral_formula"))
    d = ad.ledger_rows(spark, sf).where("role = 'M0'").select("neutral_formula").distinct()
    return d.select(
        F.concat(F.lit("L"), (el["C"] % 3).cast("string")).alias("list_id"), F.col("neutral_formula").alias("formula"), (el["N"] > 0).alias("radical")
    )


@query("J6_match_lists", f"""WITH {SPECTRA}, {SPECIES}, {SHIFTS}, tg AS (SELECT mass + shift AS target_mz, formula, adduct, list_id FROM sp, ads),
h AS (SELECT s.sample_item_id, s.peak_id, s.mz, t.*, row_number() OVER (PARTITION BY s.sample_item_id, s.peak_id ORDER BY abs(s.mz - target_mz), target_mz, formula, adduct, list_id) AS rn
  FROM spectra s JOIN tg t ON t.target_mz BETWEEN s.mz * (1 - 6e-6) AND s.mz * (1 + 6e-6) WHERE abs(s.mz - target_mz) / s.mz * 1e6 <= 5)
SELECT sample_item_id, peak_id, round_even((mz - target_mz) / mz * 1e6, 3) AS ppm FROM h WHERE rn = 1""")
def j6(spark, sf):
    t = chem.list_targets(species(spark, sf), ADDUCTS)
    m = chem.match_lists(ad.spectra(spark, sf), t)
    return m.select(*PEAK, F.bround("ppm", 3).alias("ppm"))


@query("J7_match_assigned", f"""WITH {LROWS}, {SPECIES} SELECT DISTINCT n.neutral_formula, s.list_id AS lists FROM lrows n JOIN sp s ON s.formula = n.neutral_formula AND NOT s.radical WHERE n.role = 'M0'""")
def j7(spark, sf):
    return chem.match_assigned(ad.ledger_rows(spark, sf).where("role = 'M0'"), species(spark, sf))


LIB = """lib AS (SELECT DISTINCT ion_formula AS label, ion_formula, round_even(mz, 2) AS ion_mz FROM lrows WHERE role = 'reagent')"""


def library(spark, sf):
    r = ad.ledger_rows(spark, sf).where("role = 'reagent'")
    return r.select(F.col("ion_formula").alias("label"), "ion_formula", F.bround("mz", 2).alias("ion_mz")).distinct()


@query("J8_label_reagents", f"""WITH {LROWS}, {LIB}, h AS (SELECT u.sample_item_id, u.peak_id, u.mz, l.*, row_number() OVER (PARTITION BY u.sample_item_id, u.peak_id ORDER BY abs(u.mz - ion_mz), ion_mz, label) AS rn
  FROM lrows u JOIN lib l ON abs(u.mz - ion_mz) / u.mz * 1e6 <= 15 WHERE role = 'unexplained')
SELECT sample_item_id, peak_id, label, round((mz - ion_mz) / ion_mz * 1e6, 6) AS ppm FROM h WHERE rn = 1""")
def j8(spark, sf):
    r = chem.label_reagents(ad.ledger_rows(spark, sf), library(spark, sf))
    return r.select(*PEAK, "label", F.round("ppm", 6).alias("ppm"))


@query("J9_reclaim_reagents", f"""WITH {LROWS}, {LIB}, h AS (SELECT u.sample_item_id, u.peak_id, u.role, l.label, l.ion_mz, row_number() OVER (PARTITION BY u.sample_item_id, ion_mz, label ORDER BY height DESC, u.peak_id) AS rn
  FROM lrows u JOIN lib l ON abs(u.mz - ion_mz) <= ion_mz * 12e-6)
SELECT sample_item_id, peak_id, label, role = 'M0' AS displaces FROM h WHERE rn = 1 AND role <> 'reagent'""")
def j9(spark, sf):
    r = chem.reclaim_reagents(ad.ledger_rows(spark, sf).withColumn("locked", F.lit(False)), library(spark, sf))
    return r.select(*PEAK, "label", "displaces")


@query("J10_strip_reagents", f"""WITH {LROWS}, {LIB}, mg AS (SELECT neutral_formula, adduct, avg(mz) AS mz FROM lrows WHERE role = 'M0' GROUP BY 1, 2)
SELECT neutral_formula, adduct, EXISTS (SELECT 1 FROM lib WHERE abs(ion_mz - mz) <= mz * 12e-6) AS stripped FROM mg""")
def j10(spark, sf):
    m0 = ad.ledger_rows(spark, sf).where("role = 'M0'").groupBy("neutral_formula", "adduct").agg(F.avg("mz").alias("mz"))
    kept, gone = chem.strip_reagents(m0, library(spark, sf))
    flag = lambda d, v: d.select("neutral_formula", "adduct", F.lit(v).alias("stripped"))
    return flag(kept, False).unionByName(flag(gone, True))


@query("J23_parent_channels", f"""WITH {LROWS} SELECT DISTINCT sample_item_id, neutral_formula FROM lrows WHERE role = 'M0' AND adduct IN ('[M-H]-', '[M+CO3]-')""")
def j23(spark, sf):
    return claims.corroborating_channel(ad.ledger_rows(spark, sf), ("[M-H]-", "[M+CO3]-"))


# ------------------------------------------------------------------ arbitration
SCORED = """scored AS (SELECT l_linestatus AS sample_item_id, 'p' || l_orderkey AS sample_peak_id, f AS compound_formula, f || '-' AS ion_formula, nc, nh, nn, no, ns, nsi,
  1.0::DOUBLE - l_discount AS ion_score, 1.0::DOUBLE - l_tax AS compound_score, CASE WHEN l_returnflag = 'R' THEN '[M+CO3]-' ELSE '[M-H]-' END AS adduct,
  (l_quantity - 25) / 10.0::DOUBLE AS ppm_error, l_linenumber <= 5 AS is_base, CASE WHEN l_linenumber = 6 THEN '34S' ELSE '13C' END AS iso_label, 1.0::DOUBLE - l_discount * 6 AS iso_score FROM lr2)"""
CAL = "cal AS (SELECT * FROM (VALUES ('F', 0.2::DOUBLE, 0.5::DOUBLE), ('O', -0.1::DOUBLE, 0.4::DOUBLE)) t(sample_item_id, cal_mu, cal_sigma))"
ARB = f"""{SCORED}, {CAL},
pf AS (SELECT sample_item_id, compound_formula, ion_formula, count(DISTINCT sample_peak_id) AS n_iso, bool_or(iso_label = '34S') AS s34 FROM scored
   WHERE NOT is_base AND iso_score > 0.4 GROUP BY 1, 2, 3),
bs AS (SELECT s.*, coalesce(p.n_iso, 0) AS n_iso, cal_mu, cal_sigma, least(ion_score, compound_score) AS raw_score,
   least(least(3 * nn * 0.01, 0.2) + CASE WHEN ns > 0 AND NOT coalesce(s34, false) THEN least(8 * ns * 0.01, 0.2) + 0.12 ELSE 0 END
     + CASE WHEN nsi > 0 THEN least(80 * nsi * 0.01, 0.2) + 0.12 ELSE 0 END, 0.5) AS pen
   FROM scored s JOIN cal USING (sample_item_id) LEFT JOIN pf p USING (sample_item_id, compound_formula, ion_formula) WHERE is_base),
ef AS (SELECT *, raw_score - pen - CASE WHEN adduct = '[M+CO3]-' THEN 0.12 ELSE 0 END - greatest(0, abs(ppm_error - cal_mu) / cal_sigma - 2) * 0.04 AS eff FROM bs),
rk AS (SELECT *, row_number() OVER (PARTITION BY sample_item_id, sample_peak_id ORDER BY eff DESC, compound_formula, adduct, ion_formula, raw_score DESC, ppm_error) AS rn,
   lead(eff) OVER (PARTITION BY sample_item_id, sample_peak_id ORDER BY eff DESC, compound_formula, adduct, ion_formula, raw_score DESC, ppm_error) AS nxt,
   count(*) OVER (PARTITION BY sample_item_id, sample_peak_id) AS n FROM ef),
win AS (SELECT sample_item_id, sample_peak_id AS peak_id, compound_formula AS neutral_formula, adduct, ion_formula, raw_score, ion_score, eff, eff - nxt AS margin, ppm_error, n_iso,
   coalesce(eff - nxt < 0.05, false) AS tied, least(n - 1, 6) AS n_alts FROM rk WHERE rn = 1)"""


def scored(spark, sf):
    formula = F.col("_formula")
    return ad.counted_lines(spark, sf).select(
        F.col("l_linestatus").alias("sample_item_id"), F.concat(F.lit("p"), F.col("l_orderkey").cast("string")).alias("sample_peak_id"),
        formula.alias("compound_formula"), F.concat(formula, F.lit("-")).alias("ion_formula"),
        (F.lit(1.0) - F.col("l_discount")).alias("ion_score"), (F.lit(1.0) - F.col("l_tax")).alias("compound_score"),
        F.when(F.col("l_returnflag") == "R", "[M+CO3]-").otherwise("[M-H]-").alias("adduct"),
        ((F.col("l_quantity") - 25) / 10.0).alias("ppm_error"), (F.col("l_linenumber") <= 5).alias("is_base"),
        F.when(F.col("l_linenumber") == 6, "34S").otherwise("13C").alias("iso_label"),
        (F.lit(1.0) - F.col("l_discount") * 6).alias("iso_score"),
    )


def cal(spark, sf):
    """Calibration of the two samples of the scored table."""
    s = scored(spark, sf).select("sample_item_id").distinct()
    f = F.col("sample_item_id") == "F"
    return s.select("sample_item_id", F.when(f, 0.2).otherwise(-0.1).alias("cal_mu"), F.when(f, 0.5).otherwise(0.4).alias("cal_sigma"))


def arbitrated(spark, sf):
    return claims.arbitrate(scored(spark, sf), cal(spark, sf))


@query("W4_arbitrate", f"""WITH {LROWS}, {ARB} SELECT sample_item_id, peak_id, neutral_formula, adduct, round(raw_score, 6) AS raw_score, round(eff, 6) AS eff_score,
  round(margin, 6) AS eff_margin, n_iso, tied, n_alts FROM win""")
def w4(spark, sf):
    w, _ = arbitrated(spark, sf)
    return w.select(*PEAK, "neutral_formula", "adduct", *[F.round(c, 6).alias(c) for c in ("raw_score", "eff_score", "eff_margin")], "n_iso", "tied",
                    F.size("alternatives").alias("n_alts"))


@query("W5_arbitrated_children", f"""WITH {LROWS}, {ARB} SELECT s.sample_item_id, s.sample_peak_id AS peak_id, w.peak_id AS parent_peak_id, s.iso_label, round(s.iso_score, 6) AS iso_match_score
FROM scored s JOIN win w ON w.sample_item_id = s.sample_item_id AND w.neutral_formula = s.compound_formula AND w.ion_formula = s.ion_formula
WHERE NOT is_base AND iso_score > 0.4 AND s.sample_peak_id <> w.peak_id""")
def w5(spark, sf):
    _, k = arbitrated(spark, sf)
    return k.select(*PEAK, "parent_peak_id", "iso_label", F.round("iso_match_score", 6).alias("iso_match_score"))


@query("W13_candidate_rows", f"""WITH {LROWS}, {ARB} SELECT sample_item_id, sample_peak_id AS peak_id, rn AS rank, compound_formula AS formula, adduct, round(raw_score, 6) AS score,
  round(eff, 6) AS eff_score FROM rk WHERE rn <= 7""")
def w13(spark, sf):
    from ionloom.operators import report

    w, _ = arbitrated(spark, sf)
    r = report.candidate_rows(w.withColumn("mz", F.lit(0.0)).withColumn("height", F.lit(0.0)))
    return r.select(*PEAK, F.col("rank").cast("long").alias("rank"), "formula", "adduct", F.round("score", 6).alias("score"), F.round("eff_score", 6).alias("eff_score"))


ALTS = """al AS (SELECT a.sample_item_id, a.sample_peak_id AS peak_id, count(*) FILTER (keep) AS n_real, min(gap) FILTER (keep) AS margin, count(*) FILTER (keep AND gap < 0.1) AS n_close, count(*) AS n_stored
  FROM (SELECT r.*, w.eff - r.eff AS gap, NOT (CASE WHEN r.adduct = w.adduct THEN r.compound_formula = w.neutral_formula ELSE
     r.nc + CASE WHEN r.adduct = '[M+CO3]-' THEN 1 ELSE 0 END = q.nc + CASE WHEN w.adduct = '[M+CO3]-' THEN 1 ELSE 0 END
     AND r.nh - CASE WHEN r.adduct = '[M-H]-' THEN 1 ELSE 0 END = q.nh - CASE WHEN w.adduct = '[M-H]-' THEN 1 ELSE 0 END AND r.nn = q.nn AND r.ns = q.ns AND r.nsi = q.nsi
     AND r.no + CASE WHEN r.adduct = '[M+CO3]-' THEN 3 ELSE 0 END = q.no + CASE WHEN w.adduct = '[M+CO3]-' THEN 3 ELSE 0 END END) AS keep
   FROM rk r JOIN win w ON w.sample_item_id = r.sample_item_id AND w.peak_id = r.sample_peak_id JOIN rk q ON q.sample_item_id = r.sample_item_id AND q.sample_peak_id = r.sample_peak_id AND q.rn = 1
   WHERE r.rn BETWEEN 2 AND 7) a GROUP BY 1, 2)"""


@query("W16_W17_margin_density", f"""WITH {LROWS}, {ARB}, {ALTS}
SELECT w.sample_item_id, w.peak_id, round(al.margin, 6) AS margin, 1 + coalesce(n_close, 0) AS density,
  coalesce(n_stored >= 3 AND n_close > 0 AND n_close >= n_real, false) AS density_capped, coalesce(al.margin < 0.05, false) AS tied, coalesce(n_real, 0) AS n_real
FROM win w LEFT JOIN al ON al.sample_item_id = w.sample_item_id AND al.peak_id = w.peak_id""")
def w16(spark, sf):
    w, _ = arbitrated(spark, sf)
    m = claims.margin_and_density(cut_lineage(w))
    return m.select(*PEAK, F.round("margin", 6).alias("margin"), "density", "density_capped", "tied", F.size("alternatives").alias("n_real"))


LEDSC = """led AS (SELECT sample_item_id, sample_peak_id AS peak_id, CASE WHEN length(sample_peak_id) % 2 = 0 THEN 'M0' ELSE 'unexplained' END AS role,
   CASE WHEN length(sample_peak_id) % 2 = 0 THEN min(compound_formula) END AS neutral_formula, CASE WHEN length(sample_peak_id) % 2 = 0 THEN 0.93::DOUBLE END AS have FROM scored GROUP BY 1, 2)"""
LABEL = """CASE WHEN raw_score >= 0.9 AND abs(ppm_error - cal_mu) <= 1.5 AND n_iso >= 1 AND NOT tied THEN 'High' WHEN raw_score >= 0.8 AND abs(ppm_error - cal_mu) <= 2 THEN 'Good'
   WHEN raw_score >= 0.7 THEN 'Low' WHEN raw_score >= 0.5 THEN 'Suspect' ELSE 'Reject' END"""


def scored_ledger(spark, sf):
    s = scored(spark, sf)
    owned = F.length("peak_id") % 2 == 0
    g = s.groupBy("sample_item_id", F.col("sample_peak_id").alias("peak_id")).agg(F.min("compound_formula").alias("f"))
    return g.select(
        *PEAK, F.when(owned, "M0").otherwise("unexplained").alias("role"), F.when(owned, F.col("f")).alias("neutral_formula"),
        F.when(owned, "[M-H]-").alias("adduct"), F.when(owned, 0.93).alias("ion_score"), F.lit(False).alias("locked"),
    )


@query("C7_C8_commit_gates", f"""WITH {LROWS}, {ARB}, {LEDSC}, pr AS (SELECT DISTINCT sample_item_id, neutral_formula FROM led WHERE role = 'M0')
SELECT w.sample_item_id, w.peak_id, w.neutral_formula, {LABEL} AS confidence
FROM win w JOIN cal USING (sample_item_id) JOIN led l ON l.sample_item_id = w.sample_item_id AND l.peak_id = w.peak_id
LEFT JOIN pr ON pr.sample_item_id = w.sample_item_id AND pr.neutral_formula = w.neutral_formula
WHERE raw_score >= 0.7 AND (abs(ppm_error - cal_mu) / cal_sigma <= 2 OR (abs(ppm_error - cal_mu) / cal_sigma <= 4 AND n_iso >= 1))
  AND (w.adduct <> '[M+CO3]-' OR raw_score >= 0.8 OR pr.neutral_formula IS NOT NULL) AND (l.role <> 'M0' OR l.have < raw_score)""")
def c7(spark, sf):
    w, _ = arbitrated(spark, sf)
    g = claims.gated(w, scored_ledger(spark, sf), claims.RULES["backbone"], cal(spark, sf))
    return g.select(*PEAK, "neutral_formula", "confidence")


CORE = """core AS (SELECT sample_item_id, ppm_error FROM lrows WHERE role = 'M0' AND ion_score >= 0.8 AND ns = 0 AND nsi = 0),
cn AS (SELECT sample_item_id, count(*) AS n FROM core GROUP BY 1 HAVING count(*) >= 20),
cmu AS (SELECT sample_item_id, median(ppm_error) AS mu FROM core JOIN cn USING (sample_item_id) GROUP BY 1),
lcal AS (SELECT c.sample_item_id, any_value(mu) AS cal_mu, greatest(1.4826::DOUBLE * median(abs(ppm_error - mu)), 0.25) AS cal_sigma, any_value(n) AS n FROM core c JOIN cmu USING (sample_item_id) JOIN cn USING (sample_item_id) GROUP BY 1)"""


def lcal(spark, sf):
    return cut_lineage(claims.calibrate(claims.backbone_core(ad.ledger_rows(spark, sf))))


@query("A9_calibrate", f"WITH {LROWS}, {CORE} SELECT sample_item_id, round(cal_mu, 8) AS cal_mu, round(cal_sigma, 8) AS cal_sigma, n FROM lcal")
def a9(spark, sf):
    return lcal(spark, sf).select("sample_item_id", F.round("cal_mu", 8).alias("cal_mu"), F.round("cal_sigma", 8).alias("cal_sigma"), "n")


@query("C8_relabel", f"""WITH {LROWS}, {CORE}, k AS (SELECT sample_item_id, parent_peak_id AS peak_id, count(DISTINCT peak_id) AS kids FROM lrows WHERE role = 'iso_child' GROUP BY 1, 2)
SELECT l.sample_item_id, l.peak_id, CASE WHEN cal_mu IS NULL THEN confidence ELSE
  CASE WHEN ion_score >= 0.9 AND abs(ppm_error - cal_mu) <= 1.5 AND coalesce(kids, 0) >= 1 THEN 'High' WHEN ion_score >= 0.8 AND abs(ppm_error - cal_mu) <= 2 THEN 'Good'
   WHEN ion_score >= 0.7 THEN 'Low' ELSE 'Suspect' END || CASE WHEN contains(confidence, '(') THEN ' (series)' ELSE '' END END AS confidence
FROM lrows l LEFT JOIN lcal USING (sample_item_id) LEFT JOIN k ON k.sample_item_id = l.sample_item_id AND k.peak_id = l.peak_id WHERE role = 'M0'""")
def c8(spark, sf):
    l = ad.ledger_rows(spark, sf).withColumn("locked", F.lit(False)).withColumn("tied", F.lit(False))
    return claims.relabel(l, lcal(spark, sf)).where("role = 'M0'").select(*PEAK, "confidence")


@query("C20_mass_gate", f"""WITH {LROWS}, {CORE}, k AS (SELECT DISTINCT sample_item_id, parent_peak_id AS peak_id FROM lrows WHERE role = 'iso_child'),
r AS (SELECT l.sample_item_id, l.peak_id, abs(ppm_error * 3 - cal_mu) / cal_sigma AS z, confidence NOT LIKE 'High%' AND confidence NOT LIKE 'Good%' AS weak, k.peak_id IS NULL AS bare
  FROM lrows l JOIN lcal USING (sample_item_id) LEFT JOIN k ON k.sample_item_id = l.sample_item_id AND k.peak_id = l.peak_id WHERE role = 'M0')
SELECT sample_item_id, peak_id, CASE WHEN z > 4 THEN 'beyond pattern band' ELSE 'no pattern evidence' END AS reason FROM r WHERE z > 4 OR (z > 2 AND weak AND bare)""")
def c20(spark, sf):
    l = ad.ledger_rows(spark, sf).withColumn("locked", F.lit(False)).withColumn("ppm_error", F.col("ppm_error") * 3)
    return claims.mass_gate_clears(l, lcal(spark, sf))


@query("C20_carbon_clamp", f"""WITH {LROWS}, k AS (SELECT sample_item_id, parent_peak_id AS peak_id, max(height) AS hs FROM lrows WHERE role = 'iso_child' AND iso_label = '13C' GROUP BY 1, 2)
SELECT l.sample_item_id, l.peak_id FROM lrows l JOIN k ON k.sample_item_id = l.sample_item_id AND k.peak_id = l.peak_id
WHERE role = 'M0' AND nc >= 8 AND nsi = 0 AND hs >= 100 AND abs(hs / height / 0.0107 - nc) > greatest(2.5, 0.35 * nc)""")
def c20b(spark, sf):
    return audit.carbon_inconsistent(ad.ledger_rows(spark, sf).withColumn("locked", F.lit(False)))


DEG = """deg AS (SELECT sample_item_id, peak_id, pass_no * 2 AS density FROM lrows WHERE role = 'M0')"""


def deg(l):
    return l.where("role = 'M0'").select(*PEAK, (F.col("pass_no") * 2).alias("density"))


@query("C24_tiers", f"""WITH {LROWS}, {CORE}, {DEG}, k AS (SELECT DISTINCT sample_item_id, parent_peak_id AS peak_id FROM lrows WHERE role = 'iso_child'),
ch AS (SELECT sample_item_id, neutral_formula, count(DISTINCT adduct) AS c FROM lrows WHERE role = 'M0' GROUP BY 1, 2),
r AS (SELECT l.*, k.peak_id IS NOT NULL AS iso, ch.c >= 2 AS crs, abs(ppm_error - cal_mu) / cal_sigma AS z, d.density AS dg, eff_margin < 0.05 AS tied, CASE WHEN eff_margin < 0.07 THEN 2 ELSE 1 END AS dens
  FROM lrows l LEFT JOIN lcal USING (sample_item_id) LEFT JOIN k ON k.sample_item_id = l.sample_item_id AND k.peak_id = l.peak_id
  JOIN ch ON ch.sample_item_id = l.sample_item_id AND ch.neutral_formula = l.neutral_formula JOIN deg d ON d.sample_item_id = l.sample_item_id AND d.peak_id = l.peak_id WHERE role = 'M0'),
t AS (SELECT sample_item_id, peak_id, dens, CASE WHEN method = 'known:1' THEN 'known species' WHEN confidence LIKE 'Low%' THEN 'weak score' WHEN no > 11 THEN 'oxygen beyond validated chemistry'
  WHEN nsi >= 1 AND NOT (iso OR crs) THEN 'silicon unproven' WHEN tied AND NOT crs THEN 'near tie' WHEN dens > 1 AND NOT (iso OR crs) THEN 'close alternatives'
  WHEN z > 2.6 AND NOT (iso OR crs) THEN 'off calibration' WHEN dg > 2 AND NOT (iso OR crs) THEN 'mass degenerate' ELSE 'supported' END AS why FROM r)
SELECT sample_item_id, peak_id, CASE WHEN why IN ('known species', 'supported') THEN 'Assigned' ELSE 'Candidate' END AS tier, why AS tier_reason, dens AS candidate_density FROM t""")
def c24(spark, sf):
    l = cut_lineage(ad.ledger_rows(spark, sf))
    l = l.withColumn("method", F.when(F.col("method") == "known:1", "known:1").otherwise("m")).withColumn("tied", F.col("eff_margin") < 0.05)
    l = l.withColumn("density", F.when(F.col("eff_margin") < 0.07, 2).otherwise(1)).withColumn("density_capped", F.lit(False))
    return claims.compute_tiers(l, lcal(spark, sf), deg(l)).select(*PEAK, "tier", "tier_reason", "candidate_density")


@query("C25_calibrated_ppm", f"""WITH {LROWS}, {CORE}, f AS (SELECT sample_item_id, median(ppm_error) AS alt FROM lrows WHERE role = 'M0' AND tier = 'Assigned' GROUP BY 1)
SELECT l.sample_item_id, l.peak_id, round(ppm_error - coalesce(cal_mu, alt), 8) AS ppm_error_cal FROM lrows l LEFT JOIN lcal USING (sample_item_id) LEFT JOIN f USING (sample_item_id) WHERE role = 'M0'""")
def c25(spark, sf):
    l = ad.ledger_rows(spark, sf)
    return claims.calibrated_ppm(l, lcal(spark, sf)).where("role = 'M0'").select(*PEAK, F.round("ppm_error_cal", 8).alias("ppm_error_cal"))


@query("C26_demotions", f"""WITH {LROWS}, {DEG}, r AS (SELECT l.*, d.density AS dg, 1 + nc + nsi + nn / 2.0 - nh / 2.0 AS dbe FROM lrows l JOIN deg d USING (sample_item_id, peak_id) WHERE role = 'M0' AND tier = 'Assigned')
SELECT sample_item_id, peak_id, neutral_formula, tier AS before_tier, 'Candidate' AS after_tier,
  CASE WHEN nh / nc < 0.35 THEN 'carbon-rich' WHEN no / nc > 1.3 AND dg > 2 THEN 'oxygen monster' ELSE 'carbon cluster' END AS reason FROM r
WHERE nh / nc < 0.35 OR (no / nc > 1.3 AND dg > 2) OR (NOT no / nc > 1.3 AND dbe = floor(dbe) AND dbe / nc >= 1)""")
def c26(spark, sf):
    l = cut_lineage(ad.ledger_rows(spark, sf))
    return claims.demotions(l, deg(l))


@query("C27_prefer_adduct_reading", f"""WITH {LROWS}, x AS (SELECT sample_item_id, peak_id, nc, nh, nn, no, ns, nsi, neutral_formula, adduct,
   1 + nc + nsi + nn / 2.0 - (nh - 1) / 2.0 AS dbe FROM lrows WHERE role = 'M0' AND nh >= 1)
SELECT sample_item_id, peak_id, neutral_formula, CASE WHEN dbe >= 0 AND dbe = floor(dbe) AND dbe <= nc + nsi + nn / 2.0 + 1 AND no <= 2 * (nc + nn + ns) + 4
  THEN CASE adduct WHEN '[M-H]-' THEN '[M+Br]-' WHEN '[M+Br]-' THEN '[M+HBr+Br]-' END ELSE adduct END AS adduct FROM x""")
def c27(spark, sf):
    el = F.col("_el")
    m0 = fx.with_counts(ad.ledger_rows(spark, sf).where("role = 'M0'"), "neutral_formula", "_el").withColumn("own", F.col("neutral_formula")).where(el["H"] >= 1)
    brominated = m0.withColumn("neutral_formula", fx.text(fx.shifted(el, {"Br": 1})))
    out = claims.prefer_adduct_reading(brominated.select(*PEAK, "own", "neutral_formula", "adduct"), "Br")
    return out.select(*PEAK, F.col("own").alias("neutral_formula"), "adduct")


@query("C23_degeneracy", f"""WITH {LROWS}, {CORE}, {GRID}, {SHIFTS},
t AS (SELECT l.sample_item_id, l.peak_id, l.mz, ads.adduct, shift, mz - shift AS m, cal_mu, cal_sigma FROM lrows l JOIN lcal USING (sample_item_id), ads WHERE role = 'M0'),
h AS (SELECT t.sample_item_id, t.peak_id, nc, nh + CASE WHEN adduct = '[M-H]-' THEN -1 ELSE 0 END AS ih, nn, no, ns, adduct = '[M+Br]-' AS br FROM t JOIN grid g ON g.mass BETWEEN t.m * (1 - 2e-5) AND t.m * (1 + 2e-5)
  WHERE abs(g.mass - t.m) <= t.m * 15e-6 AND abs((t.m - g.mass) / (g.mass + t.shift) * 1e6 - cal_mu) <= cal_sigma * 2 AND NOT (adduct = '[M-H]-' AND nh < 1))
SELECT sample_item_id, peak_id, count(*) AS density FROM (SELECT DISTINCT * FROM h) GROUP BY 1, 2""")
def c23(spark, sf):
    d = audit.degeneracy(ad.ledger_rows(spark, sf), grid(spark, sf), list(ADDUCTS), lcal(spark, sf))
    return d.select(*PEAK, "density")


@query("C34_residual_classes", f"""WITH {LROWS}, mv AS (SELECT * FROM (VALUES ('uc', 1.0033548::DOUBLE), ('ub', 1.997795::DOUBLE), ('ul', 1.997050::DOUBLE), ('dc', -1.0033548::DOUBLE), ('db', -1.997795::DOUBLE), ('dl', -1.997050::DOUBLE)) t(mv, d)),
h AS (SELECT u.sample_item_id, u.peak_id, mv, p.height, row_number() OVER (PARTITION BY u.sample_item_id, u.peak_id, mv ORDER BY abs(p.mz - (u.mz + d)), p.mz, p.height, p.peak_id) AS rn
  FROM lrows u CROSS JOIN mv JOIN lrows p ON p.sample_item_id = u.sample_item_id AND p.height > 0 AND p.mz BETWEEN (u.mz + d) * (1 - 7e-6) AND (u.mz + d) * (1 + 7e-6)
  WHERE u.role = 'unexplained' AND abs(p.mz - (u.mz + d)) / (u.mz + d) * 1e6 <= 6),
w AS (SELECT sample_item_id, peak_id, max(height) FILTER (mv = 'uc') AS uc, max(height) FILTER (mv = 'ub') AS ub, max(height) FILTER (mv = 'ul') AS ul,
  max(height) FILTER (mv = 'dc') AS dc, max(height) FILTER (mv = 'db') AS db, max(height) FILTER (mv = 'dl') AS dl FROM h WHERE rn = 1 GROUP BY 1, 2),
r AS (SELECT u.sample_item_id, u.peak_id, u.height AS h, w.* EXCLUDE (sample_item_id, peak_id) FROM lrows u LEFT JOIN w ON w.sample_item_id = u.sample_item_id AND w.peak_id = u.peak_id WHERE role = 'unexplained'),
x AS (SELECT *, CASE WHEN h < dc * 1.45 THEN '13C' WHEN h < db * 1.45 THEN '81Br' WHEN h < dl * 1.45 THEN '37Cl' END AS tw, coalesce(uc < h, false) AS cl,
  CASE WHEN ub / h BETWEEN 0.55 AND 1.45 THEN 1 WHEN ub / h > 1.45 AND ub / h <= 2.6 THEN 2 ELSE 0 END AS nb FROM r),
y AS (SELECT *, CASE WHEN nb = 0 AND ul / h BETWEEN 0.18 AND 0.5 THEN 1 ELSE 0 END AS nl FROM x)
SELECT sample_item_id, peak_id, CASE WHEN tw IS NOT NULL THEN 'iso-partner' WHEN cl OR nb > 0 OR nl > 0 THEN 'has-constraints' ELSE 'isolated' END AS tier, tw AS twin_of,
  CAST(CASE WHEN cl THEN greatest(1, floor(uc / h / 0.0107) - 1) END AS BIGINT) AS c_lo, CAST(CASE WHEN cl THEN ceil(uc / h / 0.0107) + 1 END AS BIGINT) AS c_hi, nb AS n_br, nl AS n_cl FROM y""")
def c34(spark, sf):
    return audit.residual_classes(ad.ledger_rows(spark, sf))


# ------------------------------------------------------------------ passes on spectra
@query("C4_isotope_templates")
def c4(spark, sf):
    m0 = ad.ledger_rows(spark, sf).where("role = 'M0'").select("ion_formula").distinct()
    return chem.isotope_templates(m0.withColumn("el", fx.counts(F.regexp_replace("ion_formula", "-$", ""))))


@query("C5_isotope_scores")
def c5(spark, sf):
    m0 = ad.ledger_rows(spark, sf).where("role = 'M0'").select("sample_item_id", F.col("neutral_formula").alias("formula"), "adduct").distinct()
    return chem.score_candidates(ad.spectra(spark, sf), m0.withColumn("el", fx.counts(F.col("formula"))))


PROFILE = rules.Profile(h_to_c=(0.2, 3.0), o_to_c=(0.0, 1.5), n_to_c=(0.0, 1.0), caps={"S": 1})


@query("C6_backbone_pass")
def c6(spark, sf):
    out = passes.backbone(cut_lineage(spectrum_ledger(spark, sf)), cut_lineage(grid(spark, sf)), ADDUCTS, PROFILE)
    return out.where("role <> 'unexplained'").select(*PEAK, "role", "neutral_formula", "adduct", "confidence", "parent_peak_id", "iso_label")


def _seeded(spark, sf):
    """Spectra whose bromide-form base lines are owned already; the rest is open."""
    own = ad.ledger_rows(spark, sf).where("role = 'M0' AND adduct = '[M+Br]-'").select(
        "sample_item_id", F.concat("peak_id", F.lit("-0")).alias("peak_id"), "neutral_formula", "adduct", "ion_formula", "ion_score", "ppm_error",
        F.lit("High").alias("confidence"), F.lit("seed").alias("method"), F.lit(1).cast("long").alias("pass_no"), F.lit("M0").alias("role"),
    )
    from ionloom.operators import ledger as led

    return cut_lineage(led.fold_claims(spectrum_ledger(spark, sf), own))


def _owned(ledger, pass_no):
    return ledger.where((F.col("role") == "M0") & (F.col("pass_no") == pass_no) & (F.col("method") != "seed")).select(
        *PEAK, "neutral_formula", "adduct", "confidence", "method")


@query("C9_series_walk")
def c9(spark, sf):
    return _owned(passes.series_walk(_seeded(spark, sf), ADDUCTS), 2)


@query("C12_deep_series")
def c12(spark, sf):
    return _owned(passes.series_walk(_seeded(spark, sf), ADDUCTS, rule="deep_series"), 4)


@query("C13_completion_pass")
def c13(spark, sf):
    return _owned(passes.completion(_seeded(spark, sf), ADDUCTS), 5)


@query("C14_ladder_pass")
def c14(spark, sf):
    return _owned(passes.ladder_fill(_seeded(spark, sf), ADDUCTS), 6)


@query("C11_C32_pair_pass")
def c11(spark, sf):
    return _owned(passes.pair_pass(cut_lineage(spectrum_ledger(spark, sf)), cut_lineage(grid(spark, sf)), ADDUCTS), 4)


CERT_BOX = {"C": (4, 23), "H": (0, 60), "N": (0, 2), "O": (0, 8), "P": (0, 2), "S": (0, 3), "Cl": (0, 2)}


@query("C15_certified_pass")
def c15(spark, sf):
    wide = cut_lineage(chem.candidate_grid(spark, CERT_BOX))
    return _owned(certified.certified_pass(cut_lineage(spectrum_ledger(spark, sf)), wide, OFFSETS)[0], 7)


@query("C16_known_species")
def c16(spark, sf):
    return _owned(passes.known_species(cut_lineage(spectrum_ledger(spark, sf)), species(spark, sf), ADDUCTS), 0)


@query("C29_list_rescue")
def c29(spark, sf):
    return passes.list_rescue(cut_lineage(spectrum_ledger(spark, sf)), species(spark, sf), ADDUCTS)


@query("C30_labelled_candidates")
def c30(spark, sf):
    return passes.labelled_candidates(spectrum_ledger(spark, sf), grid(spark, sf), ADDUCTS).select(*PEAK, "adduct", "formula", "j")


SI_BOX = {"C": (2, 28), "H": (6, 84), "N": (0, 2), "O": (1, 16), "Si": (3, 13)}


@query("C31_siloxane_ladder")
def c31(spark, sf):
    wide = cut_lineage(chem.candidate_grid(spark, SI_BOX))
    return _owned(passes.siloxane_pass(cut_lineage(spectrum_ledger(spark, sf)), wide, ADDUCTS), 8)


@query("C33_reagent_isotopologues")
def c33(spark, sf):
    return passes.reagent_isotopologues(cut_lineage(ad.ledger_rows(spark, sf)))


@query("C18_satellite_claims")
def c18(spark, sf):
    return audit.satellite_claims(_seeded(spark, sf))


@query("C17_complete_envelopes")
def c17(spark, sf):
    out = audit.complete_envelopes(_seeded(spark, sf))
    return out.where("role = 'iso_child'").select(*PEAK, "parent_peak_id", "iso_label")


@query("C21_U5_composites")
def c21(spark, sf):
    s = _seeded(spark, sf)
    found = cut_lineage(audit.composites(s))
    return audit.split_composites(s, found).where("synthetic OR assigned_fraction IS NOT NULL").select(
        *PEAK, "height", "role", "assigned_fraction", "synthetic")


@query("C22_rearbitrate")
def c22(spark, sf):
    w, _ = arbitrated(spark, sf)
    l = w.withColumn("role", F.lit("M0")).withColumn("locked", F.lit(False)).withColumn("method", F.lit("grid")).withColumn(
        "parent_peak_id", F.lit(None).cast("string"))
    return claims.rearbitrate(cut_lineage(l), cal(spark, sf))


# ------------------------------------------------------------------ time-series audits
@query("T22_dispositions", f"""WITH {CELLS}, {LEDGER}, k AS (SELECT neutral_formula, adduct, tier, mz FROM ledger),
hit AS (SELECT * FROM (SELECT k.*, b.bin, row_number() OVER (PARTITION BY k.mz ORDER BY abs(bin_mz - k.mz), bin_mz) AS rn FROM k LEFT JOIN bins b ON abs(bin_mz - k.mz) / k.mz * 1e6 <= 5) WHERE rn = 1),
m AS (SELECT bin, stddev_samp(height) / avg(height) AS cv FROM cells GROUP BY 1)
SELECT neutral_formula, adduct, round(hit.mz, 7) AS mz, tier, round(cv, 7) AS cv, CASE WHEN cv < 0.25 THEN 'background:flat (TS-flat)' WHEN cv >= 0.45 THEN 'ambient:variable' ELSE 'intermediate' END AS ts_disposition
FROM hit LEFT JOIN m USING (bin)""")
def t22(spark, sf):
    binned = matrix.binned_peaks(ad.peaks(spark, sf))
    cells, bins = matrix.matrix_cells(binned), matrix.bin_table(binned)
    met = matrix.bin_metrics(cells).select("bin", "cv")
    hit = axis.nearest(ad.ledger_ions(spark, sf), bins, "mz", "bin_mz", ["bin"], tol_ppm=5.0)
    rows = hit.withColumn("bin", F.col("hit.bin")).drop("hit").join(met, "bin", "left")
    for c, t in (("r_mono", "double"), ("r_formic", "double"), ("ion_formula", "string")):
        rows = rows.withColumn(c, F.lit(None).cast(t))
    return audit.disposition(rows).select("neutral_formula", "adduct", F.round("mz", 7).alias("mz"), "tier", F.round("cv", 7).alias("cv"), "ts_disposition")


@query("T23_sidelobe_channels")
def t23(spark, sf):
    merged = ad.ledger_ions(spark, sf)
    found = audit.sidelobe_channels(merged, ad.peaks(spark, sf), factor=1.05, min_parent=20000.0, cv_max=0.6, min_pairs=8, reach=0.3)
    return audit.flag_sidelobes(merged, found).select("neutral_formula", "adduct", "mz", "tier", "intensity_suspect", "sidelobe_parent_mz")


@query("T24_covariation", f"""WITH {PEAKS}, {LEDGER}, mem AS (SELECT neutral_formula AS cert, mz FROM ledger),
tr AS (SELECT m.mz AS m, datetime_utc, log10(greatest(max(height), 1)) AS g FROM (SELECT DISTINCT mz FROM mem) m JOIN peaks p ON abs(p.mz - m.mz) < 0.006 GROUP BY 1, 2),
pr AS (SELECT a.cert, a.mz AS a, b.mz AS b, count(x.g) AS n, corr(x.g, y.g) AS r FROM mem a JOIN mem b ON a.cert = b.cert AND a.mz < b.mz
   LEFT JOIN tr x ON x.m = a.mz LEFT JOIN tr y ON y.m = b.mz AND y.datetime_utc = x.datetime_utc WHERE y.g IS NOT NULL OR x.g IS NULL GROUP BY 1, 2, 3)
SELECT cert, round(CASE WHEN bool_and(n >= 8) THEN min(r) END, 8) AS min_r FROM pr GROUP BY 1""")
def t24(spark, sf):
    members = ad.ledger_ions(spark, sf).select(F.col("neutral_formula").alias("cert"), "mz")
    return audit.covariation(ad.peaks(spark, sf), members).withColumn("min_r", F.round("min_r", 8))


AMINE = """tr AS (SELECT 'N' || (user_id % 6) AS neutral_formula, CASE event_type WHEN (SELECT min(event_type) FROM events) THEN 'kid' ELSE 'par' || (user_id % 2) END AS adduct,
   CAST(floor(epoch(ts) / 7200.0) AS BIGINT) AS tb, median(value) AS y FROM events GROUP BY 1, 2, 3)"""


@query("C28_amine_verdicts", f"""WITH {AMINE}, k AS (SELECT * FROM tr WHERE adduct = 'kid' AND y > 0), p AS (SELECT * FROM tr WHERE adduct LIKE 'par%' AND y > 0),
s AS (SELECT p.neutral_formula, p.adduct, count(*) AS n, corr(log10(p.y), log10(k.y)) AS r, stddev_pop(p.y) / avg(p.y) AS cv FROM p JOIN k USING (neutral_formula, tb) GROUP BY 1, 2 HAVING count(*) >= 12),
v AS (SELECT neutral_formula, max(r) AS r, bool_or(cv >= 0.3) AS shaped FROM s GROUP BY 1)
SELECT neutral_formula, round(r, 7) AS r, shaped, CASE WHEN r >= 0.6 THEN 'keep' WHEN r <= 0.3 AND shaped THEN 'reject' WHEN r > 0.3 THEN 'ambiguous' ELSE 'presence-cap' END AS verdict FROM v""")
def c28(spark, sf):
    from ionloom.functions.quantiles import exact_quantiles

    e = ad.table(spark, sf, "events")
    first = F.broadcast(e.agg(F.min("event_type").alias("first_type")).withColumn("one", F.lit(1)))
    t = e.withColumn("one", F.lit(1)).join(first, "one").select(
        F.concat(F.lit("N"), (F.col("user_id") % 6).cast("string")).alias("neutral_formula"),
        F.when(F.col("event_type") == F.col("first_type"), "kid").otherwise(F.concat(F.lit("par"), (F.col("user_id") % 2).cast("string"))).alias("adduct"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 7200.0).alias("tb"), "value",
    )
    tr = cut_lineage(exact_quantiles(t, ["neutral_formula", "adduct", "tb"], "value", {"y": 0.5}))
    rows = audit.parent_tracking(tr, "kid", ["par0", "par1"]).withColumn("present", F.lit(True))
    return audit.amine_verdict(rows).select("neutral_formula", F.round("r", 7).alias("r"), "shaped", "verdict")


# ------------------------------------------------------------------ factorisation
NMF_IN = f"""nin AS (SELECT s.sample_item_id, b.bin, coalesce(c.height, 0) AS x, c.height IS NOT NULL AS seen FROM (SELECT DISTINCT sample_item_id FROM cells) s
   CROSS JOIN (SELECT DISTINCT bin FROM kc) b LEFT JOIN kc c ON c.sample_item_id = s.sample_item_id AND c.bin = b.bin)"""


def nmf_input(spark, sf):
    cells = matrix.matrix_cells(matrix.binned_peaks(ad.peaks(spark, sf)))
    return factor.sparse_input(cells, 0.1)


@query("N1_factor_input", f"""WITH {CELLS}, kb AS (SELECT bin FROM cells GROUP BY 1 HAVING count(*) / (SELECT count(DISTINCT sample_item_id) FROM cells) >= 0.1),
kc AS (SELECT * FROM cells WHERE bin IN (SELECT bin FROM kb)), {NMF_IN},
sc AS (SELECT median(height) AS med, max(height) AS top FROM kc WHERE height > 0)
SELECT sample_item_id, bin, round(x, 2) AS x, round(CASE WHEN seen THEN sqrt((0.15 * x) ** 2 + (0.1 * med) ** 2) ELSE 3 * sqrt((0.15 * top) ** 2 + (0.1 * med) ** 2) END, 4) AS sigma FROM nin, sc""")
def n1(spark, sf):
    cells = matrix.matrix_cells(matrix.binned_peaks(ad.peaks(spark, sf)))
    return factor.build_input(cells, 0.1).select("sample_item_id", "bin", F.round("x", 2).alias("x"), F.round("sigma", 4).alias("sigma"))


@query("N2_N4_factor_timeseries")
def n2(spark, sf):
    g, _, _ = factor.wnmf(nmf_input(spark, sf), 2)
    return factor.factor_timeseries(g, matrix.sample_clock(ad.peaks(spark, sf)))


@query("N3_rank_scan")
def n3(spark, sf):
    return factor.rank_scan(nmf_input(spark, sf), [2, 3, 4])


@query("W15_factor_top_ions")
def w15(spark, sf):
    _, h, _ = factor.wnmf(nmf_input(spark, sf), 2)
    return factor.factor_top_ions(h, matrix.bin_table(matrix.binned_peaks(ad.peaks(spark, sf))))
