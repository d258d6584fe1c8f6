"""Queries over annotation, cross-file consensus, run comparison and table sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionloom.functions.quantiles import exact_quantiles
from ionloom.operators import annotate, ledger as led, merge
from ionloom.plans import adapters as ad
from ionloom.plans.adapters import LEDGER, LROWS, OWNERS, PEAKS, gap_sql
from ionloom.plans.registry import query
from ionloom.sources import tables, trees

MATCH = f"""{PEAKS}, {LEDGER},
m0 AS (SELECT p.*, l.mz AS ion_mz, l.neutral_formula, l.adduct, l.tier, p.mz - l.mz AS off,
    row_number() OVER (PARTITION BY p.sample_item_id, p.peak_id ORDER BY abs(p.mz - l.mz), l.mz, l.neutral_formula, l.adduct) AS rn
  FROM peaks p JOIN ledger l ON abs(p.mz - l.mz) <= greatest(p.mz * 5.0::DOUBLE * 1e-6::DOUBLE, 0.0015::DOUBLE)),
m AS (SELECT * FROM m0 WHERE rn = 1)"""
CONSENSUS = """c0 AS (SELECT ion_mz, off, greatest(height, 0) AS h, greatest(ion_mz * 5.0::DOUBLE * 1e-6::DOUBLE, 0.0015::DOUBLE) / 3.0 AS half FROM m),
c1 AS (SELECT *, CASE WHEN off - lag(off) OVER (PARTITION BY ion_mz ORDER BY off) > half THEN 1 ELSE 0 END AS brk FROM c0),
c2 AS (SELECT *, sum(brk) OVER (PARTITION BY ion_mz ORDER BY off) AS track FROM c1),
c3 AS (SELECT ion_mz, track, max(h) AS bright, CASE WHEN sum(h) > 0 THEN sum(off * h) / sum(h) ELSE avg(off) END AS pos,
              min(abs(off)) AS dist, max(half) AS half FROM c2 GROUP BY 1, 2),
c4 AS (SELECT ion_mz, min(dist) AS dist, max(half) AS half,
              arg_min(bright, (-bright, track)) AS tb, arg_min(pos, (-bright, track)) AS tp,
              arg_min(bright, (dist, track)) AS hb, arg_min(pos, (dist, track)) AS hp FROM c3 GROUP BY 1),
cons AS (SELECT ion_mz, CASE WHEN dist <= half AND tb <= 2.0 * hb THEN hp ELSE tp END AS cons FROM c4)"""


@query("J1_nearest_ion", f"""WITH {MATCH}
SELECT p.sample_item_id, p.peak_id, round(m.ion_mz, 8) AS ion_mz, m.neutral_formula, m.adduct, m.tier
FROM peaks p LEFT JOIN m ON m.sample_item_id = p.sample_item_id AND m.peak_id = p.peak_id""")
def j1(spark, sf):
    m = annotate.match_nearest(ad.peaks(spark, sf), ad.ledger_ions(spark, sf))
    return m.select(
        "sample_item_id", "peak_id", F.round("ion.mz", 8).alias("ion_mz"),
        *[F.col(f"ion.{c}").alias(c) for c in ("neutral_formula", "adduct", "tier")],
    )


@query("J3_consensus_offsets", f"""WITH {MATCH}, {CONSENSUS}
SELECT round(ion_mz, 8) AS ion_mz, round(cons, 9) AS cons FROM cons""")
def j3(spark, sf):
    m = annotate.match_nearest(ad.peaks(spark, sf), ad.ledger_ions(spark, sf))
    return annotate.consensus_offsets(m).select(F.round("ion_mz", 8).alias("ion_mz"), F.round("cons", 9).alias("cons"))


@query("J1_J2_J3_annotate_peaks", f"""WITH {MATCH}, {CONSENSUS},
r AS (SELECT m.*, row_number() OVER (PARTITION BY sample_item_id, m.ion_mz
        ORDER BY abs(off - cons.cons), -height, peak_id) AS place FROM m JOIN cons ON cons.ion_mz = m.ion_mz)
SELECT p.sample_item_id, p.peak_id, p.height,
       CASE WHEN place = 1 THEN r.neutral_formula END AS neutral_formula, CASE WHEN place = 1 THEN r.adduct END AS adduct,
       CASE WHEN place = 1 THEN r.tier END AS tier, round(CASE WHEN place = 1 THEN r.ion_mz END, 8) AS ion_mz,
       coalesce(place > 1, false) AS dup_candidate
FROM peaks p LEFT JOIN r ON r.sample_item_id = p.sample_item_id AND r.peak_id = p.peak_id""")
def j123(spark, sf):
    a = annotate.annotate_peaks(ad.peaks(spark, sf), ad.ledger_ions(spark, sf))
    return a.select(
        "sample_item_id", "peak_id", "height", "neutral_formula", "adduct", "tier",
        F.round("ion_mz", 8).alias("ion_mz"), "dup_candidate",
    )


@query("J2_bare_one_to_one", f"""WITH {MATCH},
r AS (SELECT *, row_number() OVER (PARTITION BY sample_item_id, ion_mz ORDER BY abs(off), -height, peak_id) AS place FROM m)
SELECT sample_item_id, peak_id, place = 1 AS winner FROM r""")
def j2(spark, sf):
    m = annotate.match_nearest(ad.peaks(spark, sf), ad.ledger_ions(spark, sf))
    r = annotate.resolve_one_to_one(m, None)
    return r.where(F.col("ion").isNotNull()).select("sample_item_id", "peak_id", "winner")


IDENTIFIED = """ident AS (
  SELECT l.mz, l.role, CASE WHEN l.role IN ('M0', 'reagent') THEN l.ion_formula WHEN l.role = 'iso_child' THEN p.ion_formula END AS ion_formula,
         CASE WHEN l.role = 'reagent' THEN l.tag WHEN l.role = 'iso_child' THEN l.iso_label END AS iso_label,
         l.neutral_formula, l.adduct
  FROM lrows l LEFT JOIN lrows p ON p.sample_item_id = l.sample_item_id AND p.peak_id = l.parent_peak_id
  WHERE l.role IN ('M0', 'artifact') OR (l.role = 'reagent') OR (l.role = 'iso_child' AND p.ion_formula IS NOT NULL))"""


@query("F2_identified_rows", f"""WITH {LROWS}, {IDENTIFIED}
SELECT round(mz, 7) AS mz, role, ion_formula, iso_label, neutral_formula, adduct FROM ident""")
def f2(spark, sf):
    return annotate.identified_rows(ad.ledger_rows(spark, sf)).withColumn("mz", F.round("mz", 7))


MERGED_LR = """merged AS (SELECT neutral_formula, adduct, avg(mz) AS mz, min(tier) AS tier, max(ion_score) AS ion_score
  FROM lrows WHERE role = 'M0' GROUP BY 1, 2)"""


def merged_rows(spark, sf):
    return (
        ad.ledger_rows(spark, sf).where("role = 'M0'").groupBy("neutral_formula", "adduct")
        .agg(F.avg("mz").alias("mz"), F.min("tier").alias("tier"), F.max("ion_score").alias("ion_score"))
    )


@query("A24_U2_stamping_frame", f"""WITH {LROWS}, {IDENTIFIED}, {MERGED_LR},
mode AS (SELECT neutral_formula, adduct, arg_min(ion_formula, (-n, ion_formula)) AS ion_formula FROM (
   SELECT neutral_formula, adduct, ion_formula, count(*) AS n FROM ident WHERE role = 'M0' GROUP BY 1, 2, 3) GROUP BY 1, 2),
art AS (SELECT mz FROM ident WHERE role = 'artifact'),
{gap_sql("art", "ghosts", "mz", da=0.003, bin_name="track")}
SELECT neutral_formula, adduct, round(m.mz, 6) AS mz, tier, 'M0' AS role, mode.ion_formula, NULL AS iso_label
FROM merged m LEFT JOIN mode USING (neutral_formula, adduct)
UNION ALL SELECT NULL, NULL, round(median(mz), 6), NULL, min(role), ion_formula, iso_label
FROM ident WHERE role IN ('reagent', 'iso_child') GROUP BY ion_formula, iso_label
UNION ALL SELECT NULL, NULL, round(median(mz), 6), NULL, 'artifact', NULL, NULL FROM ghosts GROUP BY track""")
def a24(spark, sf):
    f = annotate.stamping_frame(merged_rows(spark, sf), annotate.identified_rows(ad.ledger_rows(spark, sf)))
    return f.select("neutral_formula", "adduct", F.round("mz", 6).alias("mz"), "tier", "role", "ion_formula", "iso_label")


# ------------------------------------------------------------------ cross-file consensus
POSITION = """pos AS (SELECT *, 100.0::DOUBLE + CAST(substr(neutral_formula, 2) AS BIGINT) * 0.2508387::DOUBLE AS theo,
   (mz - (100.0::DOUBLE + CAST(substr(neutral_formula, 2) AS BIGINT) * 0.2508387::DOUBLE))
   / (100.0::DOUBLE + CAST(substr(neutral_formula, 2) AS BIGINT) * 0.2508387::DOUBLE) * 1e6 AS ppm FROM owners)"""
OFFSETS = "offs AS (SELECT src, median(ppm) AS offset_ppm FROM pos GROUP BY 1)"
ALIGNED = f"""{OWNERS}, {POSITION}, {OFFSETS},
adj AS (SELECT p.*, offset_ppm, p.mz * (1.0::DOUBLE - offset_ppm / 1e6::DOUBLE) AS mz_adj FROM pos p JOIN offs USING (src)),
{gap_sql("adj", "al", "mz_adj", ppm=6, bin_name="cluster")}"""


def owner_rows(spark, sf):
    theo = F.lit(100.0) + F.substring("neutral_formula", 2, 9).cast("long") * F.lit(0.2508387)
    return ad.owners(spark, sf).withColumn("ppm", (F.col("mz") - theo) / theo * 1e6)


def aligned(spark, sf):
    rows = owner_rows(spark, sf)
    return merge.aligned_rows(rows, merge.file_offsets(rows))


@query("A5_U1_merge_clusters", f"""WITH {ALIGNED},
rk AS (SELECT *, CASE tier WHEN 'Assigned' THEN 2 WHEN 'Candidate' THEN 1 ELSE 0 END AS r FROM al),
sup AS (SELECT cluster, neutral_formula, sum(CASE WHEN r >= 2 THEN 1 ELSE 0 END) AS na, count(DISTINCT src) AS nf,
               max(r) AS br, max(ion_score) AS bs FROM rk GROUP BY 1, 2),
win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY na DESC, nf DESC, br DESC, bs DESC, neutral_formula) AS k FROM sup) WHERE k = 1),
best AS (SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r.cluster ORDER BY r.r DESC, r.ion_score DESC, r.adduct, r.tier) AS k
         FROM rk r JOIN win w ON w.cluster = r.cluster AND w.neutral_formula = r.neutral_formula) WHERE k = 1),
whole AS (SELECT cluster, avg(mz) AS mz, count(DISTINCT src) AS n_files, array_to_string(list_sort(list(DISTINCT src)), ',') AS srcs,
   count(DISTINCT neutral_formula) <= 1 AS formula_agree,
   CASE WHEN count(*) > 1 THEN (max(mz) - min(mz)) / avg(mz) * 1e6 ELSE 0 END AS jr,
   CASE WHEN count(*) > 1 THEN (max(mz_adj) - min(mz_adj)) / avg(mz_adj) * 1e6 ELSE 0 END AS ja FROM al GROUP BY 1)
SELECT w.cluster, round(w.mz, 7) AS mz, b.neutral_formula, b.adduct, b.tier, b.ion_score, w.n_files, w.srcs, w.formula_agree,
       round_even(w.jr, 3) AS mz_jitter_ppm_raw, round_even(w.ja, 3) AS mz_jitter_ppm_caldj
FROM whole w JOIN best b USING (cluster)""")
def a5(spark, sf):
    return merge.merge_clusters(aligned(spark, sf)).withColumn("mz", F.round("mz", 7))


@query("A6_jitter_rows", f"""WITH {ALIGNED}
SELECT cluster, src, round(mz, 8) AS mz, neutral_formula, adduct, tier, ion_score FROM al""")
def a6(spark, sf):
    return merge.jitter_rows(aligned(spark, sf)).withColumn("mz", F.round("mz", 8))


@query("A7_file_offsets", f"WITH {OWNERS}, {POSITION}, {OFFSETS} SELECT src, round(offset_ppm, 6) AS offset_ppm FROM offs")
def a7o(spark, sf):
    return merge.file_offsets(owner_rows(spark, sf)).withColumn("offset_ppm", F.round("offset_ppm", 6))


BY_FORMULA = """bf AS (SELECT neutral_formula, adduct, count(DISTINCT src) AS n_files, avg(mz) AS mz,
   round_even(max(ppm) - min(ppm), 3) AS mz_jitter_raw,
   round_even(max(ppm - offset_ppm) - min(ppm - offset_ppm), 3) AS mz_jitter_resid,
   array_to_string(list_sort(list(DISTINCT tier)), ',') AS tiers, count(DISTINCT tier) = 1 AS tier_stable,
   round_even(min(ion_score), 3) AS ion_score_min, round_even(max(ion_score), 3) AS ion_score_max
   FROM adj GROUP BY 1, 2 HAVING count(DISTINCT src) >= 2)"""
DISAGREE = """dis AS (SELECT cluster, avg(mz) AS mz, count(DISTINCT src) AS n_files, count(DISTINCT neutral_formula) AS n_formulas,
   array_to_string(list_sort(list(DISTINCT neutral_formula)), '; ') AS formulas, count(DISTINCT neutral_formula) > 1 AS disagree
   FROM al GROUP BY 1 HAVING count(DISTINCT src) >= 2)"""


@query("A7_jitter_by_formula", f"WITH {ALIGNED}, {BY_FORMULA} SELECT * REPLACE (round(mz, 7) AS mz) FROM bf")
def a7f(spark, sf):
    rows = owner_rows(spark, sf)
    return merge.jitter_by_formula(rows, merge.file_offsets(rows)).withColumn("mz", F.round("mz", 7))


@query("A7_formula_disagreements", f"WITH {ALIGNED}, {DISAGREE} SELECT * REPLACE (round(mz, 7) AS mz) FROM dis")
def a7d(spark, sf):
    return merge.formula_disagreements(aligned(spark, sf)).withColumn("mz", F.round("mz", 7))


@query("A7_jitter_summary", f"""WITH {ALIGNED}, {BY_FORMULA}, {DISAGREE}
SELECT count(*) AS shared_assignments, count(*) FILTER (NOT tier_stable) AS tier_unstable,
  (SELECT count(*) FROM dis WHERE disagree) AS formula_disagreements,
  (SELECT round_even(max(offset_ppm) - min(offset_ppm), 3) FROM offs) AS offset_spread_ppm,
  round_even(median(mz_jitter_raw), 3) AS raw_median, round_even(quantile_cont(mz_jitter_raw, 0.95), 3) AS raw_p95,
  round_even(median(mz_jitter_resid), 3) AS resid_median, round_even(quantile_cont(mz_jitter_resid, 0.95), 3) AS resid_p95
FROM bf""")
def a7s(spark, sf):
    rows = owner_rows(spark, sf)
    offs = merge.file_offsets(rows)
    return merge.jitter_summary(
        merge.jitter_by_formula(rows, offs), merge.formula_disagreements(merge.aligned_rows(rows, offs)), offs
    )


@query("A8_estimate_offset", f"""WITH {LROWS}
SELECT sample_item_id, count(*) FILTER (abs(ppm_error) <= 1.3) AS n,
       CASE WHEN count(*) FILTER (abs(ppm_error) <= 1.3) >= 8 THEN round(median(CASE WHEN abs(ppm_error) <= 1.3 THEN ppm_error END), 6) END AS offset_ppm
FROM lrows WHERE role = 'M0' GROUP BY 1""")
def a8(spark, sf):
    m0 = ad.ledger_rows(spark, sf).where("role = 'M0'")
    return merge.estimate_offset(m0, keep_ppm=1.3).withColumn("offset_ppm", F.round("offset_ppm", 6))


@query("J18_U3_run_diff", """WITH l AS (SELECT *, strftime(l_shipdate, '%Y-%m') AS s,
   concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS pid FROM lineitem),
a AS (SELECT s, pid, 'F' || l_partkey AS fa, CASE WHEN l_discount < 0.05 THEN 'Assigned' ELSE 'Candidate' END AS ta, 1 - l_discount AS sa
      FROM l WHERE l_returnflag <> 'R'),
b AS (SELECT s, pid, CASE WHEN l_linenumber = 7 THEN 'X' ELSE 'F' END || l_partkey AS fb,
             CASE WHEN l_discount + l_tax < 0.08 THEN 'Assigned' ELSE 'Candidate' END AS tb, 1 - l_discount - l_tax / 2 AS sb
      FROM l WHERE l_linestatus = 'O' OR l_returnflag = 'A'),
j AS (SELECT *, a.pid IS NOT NULL AND b.pid IS NOT NULL AS inboth FROM a FULL JOIN b ON a.s = b.s AND a.pid = b.pid)
SELECT count(*) FILTER (inboth) AS n_both, count(*) FILTER (fb IS NULL) AS only_a, count(*) FILTER (fa IS NULL) AS only_b,
  round(count(*) FILTER (inboth AND fa = fb) / count(*) FILTER (inboth), 9) AS agree,
  count(*) FILTER (inboth AND ta = 'Assigned' AND tb = 'Candidate') AS demoted,
  count(*) FILTER (inboth AND ta = 'Candidate' AND tb = 'Assigned') AS promoted,
  round(avg(CASE WHEN inboth THEN sb - sa END), 9) AS mean_shift, round(avg(CASE WHEN inboth THEN abs(sb - sa) END), 9) AS mae FROM j""")
def j18(spark, sf):
    li = ad.table(spark, sf, "lineitem").select(
        "*",
        F.date_format("l_shipdate", "yyyy-MM").alias("sample_item_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.round(F.col("l_extendedprice") * 100).cast("long")).alias("peak_id"),
    )
    part = F.col("l_partkey").cast("string")
    tier = lambda c: F.when(c, "Assigned").otherwise("Candidate")
    a = li.where("l_returnflag <> 'R'").select(
        "sample_item_id", "peak_id", F.concat(F.lit("F"), part).alias("neutral_formula"),
        tier(F.col("l_discount") < 0.05).alias("tier"), (1 - F.col("l_discount")).alias("ion_score"),
    )
    b = li.where("l_linestatus = 'O' OR l_returnflag = 'A'").select(
        "sample_item_id", "peak_id",
        F.concat(F.when(F.col("l_linenumber") == 7, "X").otherwise("F"), part).alias("neutral_formula"),
        tier(F.col("l_discount") + F.col("l_tax") < 0.08).alias("tier"),
        (1 - F.col("l_discount") - F.col("l_tax") / 2).alias("ion_score"),
    )
    return merge.run_diff(a, b).select(
        "n_both", "only_a", "only_b", F.round("agree", 9).alias("agree"), "demoted", "promoted",
        F.round("mean_shift", 9).alias("mean_shift"), F.round("mae", 9).alias("mae"),
    )


@query("J19_scorer_parity", f"""WITH {LROWS},
m AS (SELECT sample_item_id, peak_id, neutral_formula, adduct, ion_score, left(src, 1) || (CAST(substr(src, 2) AS INT) % 2) AS grp FROM lrows WHERE role = 'M0'),
loc AS (SELECT sample_item_id, peak_id, neutral_formula, adduct, ion_score - eff_margin / 3 AS s FROM lrows WHERE role = 'M0'
        UNION ALL SELECT sample_item_id, peak_id, neutral_formula || 'S', adduct, 0.93 - eff_margin * 0.2 FROM lrows WHERE role = 'M0' AND tier = 'Candidate'),
top AS (SELECT sample_item_id, peak_id, arg_min(neutral_formula, (-s, neutral_formula)) AS f FROM loc GROUP BY 1, 2),
p AS (SELECT m.grp, m.neutral_formula, m.ion_score AS b, l.s AS s, t.f FROM m LEFT JOIN loc l USING (sample_item_id, peak_id, neutral_formula, adduct)
      LEFT JOIN top t USING (sample_item_id, peak_id))
SELECT coalesce(grp, 'all') AS reagent, count(*) AS n_owners, count(s) AS n_pairs, round(avg(abs(s - b)), 8) AS mae, round(corr(b, s), 8) AS r,
       round(avg(CASE WHEN abs(s - b) <= 0.0301 THEN 1.0 ELSE 0.0 END) FILTER (s IS NOT NULL), 8) AS within,
       round(count(f) / count(*), 8) AS covered, round(count(*) FILTER (f = neutral_formula) / count(*), 8) AS agree
FROM p GROUP BY GROUPING SETS ((grp), ())""")
def j19(spark, sf):
    m0 = ad.ledger_rows(spark, sf).where("role = 'M0'")
    owners = m0.withColumn("reagent", F.concat(F.lit("f"), (F.substring("src", 2, 3).cast("int") % 2).cast("string")))
    local = m0.select(
        "sample_item_id", "peak_id", "neutral_formula", "adduct", (F.col("ion_score") - F.col("eff_margin") / 3).alias("local_score")
    ).unionByName(
        m0.where("tier = 'Candidate'").select(
            "sample_item_id", "peak_id", F.concat("neutral_formula", F.lit("S")).alias("neutral_formula"), "adduct",
            (F.lit(0.93) - F.col("eff_margin") * 0.2).alias("local_score"),
        )
    )
    out = merge.scorer_parity(owners, local, within=0.0301)
    return out.select("reagent", "n_owners", "n_pairs", *[F.round(c, 8).alias(c) for c in ("mae", "r", "within", "covered", "agree")])


# ------------------------------------------------------------------ ledger basics
@query("W6_C36_new_ledger", """WITH raw AS (SELECT strftime(l_shipdate, '%Y') AS sample_item_id, l_orderkey || '-' || l_linenumber AS peak_id,
   100 + l_partkey * 0.25 AS mz, l_extendedprice AS height FROM lineitem)
SELECT sample_item_id, peak_id, mz, height, 'unexplained' AS role FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_item_id, peak_id ORDER BY height DESC, mz DESC) AS rn FROM raw) WHERE rn = 1""")
def w6(spark, sf):
    raw = ad.table(spark, sf, "lineitem").select(
        F.date_format("l_shipdate", "yyyy").alias("sample_item_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("peak_id"),
        (F.lit(100.0) + F.col("l_partkey") * 0.25).alias("mz"),
        F.col("l_extendedprice").alias("height"),
        F.lit(None).cast("double").alias("area"),
    )
    return led.new_ledger(raw).select("sample_item_id", "peak_id", "mz", "height", "role")


@query("F1_roles_above_cutoff", f"""WITH {LROWS}
SELECT sample_item_id, peak_id, role, height FROM lrows WHERE role IN ('unexplained', 'M0') AND height >= 20000""")
def f1(spark, sf):
    return led.in_role(ad.ledger_rows(spark, sf), "unexplained", "M0", min_height=20000.0).select(
        "sample_item_id", "peak_id", "role", "height"
    )


@query("C35_violations", f"""WITH {LROWS},
dup AS (SELECT sample_item_id, peak_id FROM lrows GROUP BY 1, 2 HAVING count(*) > 1),
orphan AS (SELECT l.sample_item_id, l.peak_id FROM lrows l WHERE role = 'iso_child' AND NOT EXISTS (
   SELECT 1 FROM lrows p WHERE p.role = 'M0' AND p.sample_item_id = l.sample_item_id AND p.peak_id = l.parent_peak_id))
SELECT 'duplicate peak' AS rule, * FROM dup UNION ALL SELECT 'child without M0 parent', * FROM orphan""")
def c35(spark, sf):
    return led.violations(ad.ledger_rows(spark, sf))


@query("C36_clear_with_children", f"""WITH {LROWS},
gone AS (SELECT sample_item_id, peak_id FROM lrows WHERE role = 'M0' AND confidence = 'Low')
SELECT l.sample_item_id, l.peak_id,
  CASE WHEN g.peak_id IS NOT NULL OR c.peak_id IS NOT NULL THEN 'unexplained' ELSE l.role END AS role,
  CASE WHEN g.peak_id IS NULL AND c.peak_id IS NULL THEN l.neutral_formula END AS neutral_formula,
  CASE WHEN g.peak_id IS NULL AND c.peak_id IS NULL THEN l.parent_peak_id END AS parent_peak_id
FROM lrows l LEFT JOIN gone g ON g.sample_item_id = l.sample_item_id AND g.peak_id = l.peak_id
LEFT JOIN gone c ON c.sample_item_id = l.sample_item_id AND c.peak_id = l.parent_peak_id""")
def c36(spark, sf):
    rows = ad.ledger_rows(spark, sf).withColumn("locked", F.lit(False))
    gone = rows.where("role = 'M0' AND confidence = 'Low'").select("sample_item_id", "peak_id")
    return led.clear(rows, gone).select("sample_item_id", "peak_id", "role", "neutral_formula", "parent_peak_id")


@query("F14_protected_neutrals", f"""WITH {LROWS}
SELECT DISTINCT neutral_formula FROM lrows WHERE method LIKE 'known:1%' OR method LIKE 'certified:%'""")
def f14(spark, sf):
    from ionloom.operators import rules

    return rules.protected_neutrals(ad.ledger_rows(spark, sf), ("known:1", "certified:"))


@query("F10_detect_adducts", """SELECT sample_item_id, adduct FROM (
  SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS sample_item_id,
    CASE l_returnflag WHEN 'A' THEN '[M+Br]-' WHEN 'N' THEN '[M-H]-' END AS adduct FROM lineitem) WHERE adduct IS NOT NULL""")
def f10(spark, sf):
    from ionloom.operators import rules

    peaks = ad.table(spark, sf, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM").alias("sample_item_id"),
        F.when(F.col("l_returnflag") == "A", "+Br-").when(F.col("l_returnflag") == "N", "-H-").otherwise("?").alias("ionization_mechanism"),
    )
    return rules.detect_adducts(peaks)


# ------------------------------------------------------------------ sources and sinks
@query("S4_flatten_match_tree", """SELECT 'P' || l_partkey AS compound_formula, 'I' || l_partkey || l_linestatus AS ion_formula,
  CASE WHEN l_linenumber <= 3 THEN 'M0' ELSE '13C' END AS iso_label, l_linenumber <= 3 AS is_base,
  round(100 + l_partkey * 0.01, 6) AS theo_mz, l_discount AS iso_score,
  CASE WHEN l_returnflag <> 'R' THEN l_returnflag || l_suppkey END AS sample_peak_id,
  CASE WHEN l_returnflag <> 'R' THEN round((l_tax - 0.04) * 1e-3 / (100 + l_partkey * 0.01) * 1e6, 4) END AS ppm_error
FROM lineitem""")
def s4(spark, sf):
    line = F.struct(
        F.when(F.col("l_linenumber") <= 3, F.lit("C5H8O2-")).otherwise(F.lit("[13C]C4H8O2-")).alias("target_isotope_formula"),
        (F.lit(100.0) + F.col("l_partkey") * 0.01).alias("mz"),
        F.lit(1.0).alias("relative_abundance"),
        F.col("l_discount").alias("match_score"),
        F.lit("x").alias("match_category"),
        F.when(F.col("l_returnflag") != "R", F.concat("l_returnflag", F.col("l_suppkey").cast("string"))).alias("sample_peak_id"),
        (F.lit(100.0) + F.col("l_partkey") * 0.01 + (F.col("l_tax") - 0.04) * 1e-3).alias("sample_peak_mz"),
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).otherwise(0.0).alias("sample_peak_intensity"),
        F.lit(None).cast("double").alias("match_abundance_error"),
    )
    ions = (
        ad.table(spark, sf, "lineitem")
        .groupBy("l_orderkey", "l_partkey", "l_linestatus")
        .agg(F.collect_list(line).alias("children"))
        .select(
            "l_orderkey", "l_partkey",
            F.struct(
                F.concat(F.lit("I"), F.col("l_partkey").cast("string"), "l_linestatus").alias("target_ion_formula"),
                F.lit(0.5).alias("match_score"), F.lit("x").alias("match_category"),
                F.col("l_linestatus").alias("ionization_mechanism_id"), "children",
            ).alias("ion"),
        )
    )
    tree = ions.groupBy("l_orderkey", "l_partkey").agg(F.collect_list("ion").alias("children")).select(
        F.to_json(F.array(F.struct(
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("target_compound_formula"),
            F.lit(0.5).alias("match_score"), F.lit("x").alias("match_category"), "children",
        ))).alias("tree")
    )
    flat = trees.flatten_match_tree(tree, "tree")
    return flat.select(
        "compound_formula", "ion_formula", "iso_label", "is_base", F.round("theo_mz", 6).alias("theo_mz"), "iso_score",
        "sample_peak_id", F.round("ppm_error", 4).alias("ppm_error"),
    )


@query("S5_reanchor_labelled", """WITH r AS (SELECT l_orderkey AS ion, l_linenumber AS ln, l_partkey,
   CASE WHEN l_linenumber = 1 THEN 'M0' WHEN l_linenumber <= 4 THEN '15N' ELSE '13C' END AS lab,
   CASE WHEN l_linenumber = 1 THEN 200.0::DOUBLE ELSE 200.997::DOUBLE + l_tax / 20 END AS mz, l_suppkey,
   CAST(round(l_extendedprice * 100) AS BIGINT) AS pr FROM lineitem),
b AS (SELECT ion, min(mz) AS bmz FROM r WHERE ln = 1 GROUP BY 1),
c AS (SELECT r.ion, arg_min((ln, l_partkey, l_suppkey, pr), (abs(mz - (bmz + 0.997035)), mz, ln, l_partkey, l_suppkey, pr)) AS pick,
             min(abs(mz - (bmz + 0.997035))) AS d FROM r JOIN b ON b.ion = r.ion WHERE lab = '15N' GROUP BY 1),
m AS (SELECT r.*, c.pick IS NOT NULL AND c.d <= 0.01 AS moved, c.pick = (ln, l_partkey, l_suppkey, pr) AS picked FROM r LEFT JOIN c ON c.ion = r.ion)
SELECT ion, round(mz, 6) AS theo_mz, CASE WHEN moved AND picked THEN 'M0' ELSE lab END AS iso_label,
       CASE WHEN moved AND picked THEN true WHEN moved THEN false ELSE lab = 'M0' END AS is_base FROM m""")
def s5(spark, sf):
    ln = F.col("l_linenumber")
    rows = ad.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("ion"),
        F.struct(ln.alias("a"), F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("c"),
                 F.round(F.col("l_extendedprice") * 100).cast("long").alias("d")).alias("line"),
        F.when(ln == 1, "M0").when(ln <= 4, "15N").otherwise("13C").alias("iso_label"),
        (ln == 1).alias("is_base"),
        F.when(ln == 1, 200.0).otherwise(F.lit(200.997) + F.col("l_tax") / 20).alias("theo_mz"),
    )
    out = trees.reanchor_labelled(rows, ["ion"], line="line", delta=0.997035, label="15N")
    return out.select("ion", F.round("theo_mz", 6).alias("theo_mz"), "iso_label", "is_base")


@query("S6_reference_lists", """SELECT 'R' || r_regionkey AS list_id, r_name AS label, n_name AS formula,
   n_nationkey % 4 = 0 AS radical, 'mode' || (n_nationkey % 2) AS modes
FROM region JOIN nation ON n_regionkey = r_regionkey""")
def s6(spark, sf):
    nations = ad.table(spark, sf, "nation").groupBy("n_regionkey").agg(
        F.collect_list(
            F.struct(
                F.col("n_name").alias("formula"), (F.col("n_nationkey") % 4 == 0).alias("radical"),
                F.array(F.concat(F.lit("mode"), (F.col("n_nationkey") % 2).cast("string"))).alias("modes"),
            )
        ).alias("species")
    )
    docs = ad.table(spark, sf, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.to_json(F.struct(
            F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("label"), "species",
        )).alias("doc")
    )
    return trees.explode_lists(docs.select(F.from_json("doc", trees.LIST_SCHEMA).alias("d")).select("d.*")).select(
        "list_id", "label", "formula", "radical", F.array_join("modes", ",").alias("modes")
    )


@query("S10_regroup_samples", f"""WITH {PEAKS},
s AS (SELECT DISTINCT sample_batch_name AS b, sample_item_id AS s FROM peaks),
moved AS (SELECT CASE WHEN b = 'b1' AND s < '1995' THEN 'archive' ELSE b END AS sample_batch_name, s AS sample_item_id FROM s),
copied AS (SELECT 'copy' AS sample_batch_name, s AS sample_item_id FROM s WHERE b = 'b2' AND s >= '1998')
SELECT * FROM moved UNION ALL SELECT * FROM copied""")
def s10(spark, sf):
    s = ad.peaks(spark, sf).select("sample_batch_name", "sample_item_id").distinct()
    move = s.where("sample_batch_name = 'b1' AND sample_item_id < '1995'").withColumn("target", F.lit("archive"))
    copy = s.where("sample_batch_name = 'b2' AND sample_item_id >= '1998'").withColumn("target", F.lit("copy"))
    return tables.regroup(s, move=move, copy=copy)


@query("S9_table_digest")
def s9(spark, sf):
    return tables.table_digest(ad.peaks(spark, sf).select("sample_item_id", "peak_id", "mz", "height"))
