"""Queries of the re-readings and of the demotions that go with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionloom.functions import formula as fx
from ionloom.operators import audit, rereading
from ionloom.plans import adapters as ad
from ionloom.plans.adapters import LROWS
from ionloom.plans.chem_queries import CORE, lcal
from ionloom.plans.registry import query
from ionloom.session import cut_lineage

PEAK = ["sample_item_id", "peak_id"]

# Owners dealt by their height: hydrocarbons under five ion forms, bromine backgrounds, compounds as they are.
FORMS = ("[M+CO3]-", "[M-H]-", "[M+NH4]+", "[M+(CH4N2O)H]+", "[M+H]+", "[M+^NO3]-", "[M+HBr+Br]-", "[M+Br2]-", "[M-H]-", "[M+CO3]-", "[M-H]-", "[M-H]-")


def _text(c="c", h="h", n="n", o="o", s="s", si="si"):
    counted = ((c, "C"), (h, "H"), (n, "N"), (o, "O"), (s, "S"), (si, "Si"))
    return " || ".join(f"CASE WHEN {v} = 1 THEN '{e}' WHEN {v} > 1 THEN '{e}' || ({v}) ELSE '' END" for v, e in counted)


DEALT = f"""k0 AS (SELECT *, CAST(round(height * 100) AS BIGINT) % 12 AS k FROM lrows WHERE role = 'M0'),
k1 AS (SELECT sample_item_id, peak_id, k, tier, ppm_error, ns AS anchorless, no AS n_o, nc % 5 = 0 AS locked, nc AS c, CASE WHEN k <= 4 THEN nh - nn - 2 * nsi ELSE nh END AS h,
  CASE WHEN k <= 4 THEN 0 ELSE nn END AS n, CASE WHEN k <= 4 THEN 0 ELSE no END AS o, CASE WHEN k <= 4 THEN 0 ELSE ns END AS s, CASE WHEN k <= 4 THEN 0 ELSE nsi END AS si,
  list_extract([{", ".join(f"'{f}'" for f in FORMS)}], k + 1) AS adduct FROM k0),
kept AS (SELECT *, CASE WHEN k = 7 THEN 'CBr' WHEN k = 6 AND n_o % 2 = 1 THEN 'C2O2' WHEN k = 6 THEN 'C' ELSE {_text()} END AS f FROM k1)"""


def dealt(spark, sf):
    l = fx.with_counts(ad.ledger_rows(spark, sf).where("role = 'M0'"), "neutral_formula", "el")
    el, k = F.col("el"), F.round(F.col("height") * 100).cast("long") % 12
    hydrocarbon = F.struct(
        *[(el["C"] if f == "C" else el["H"] - el["N"] - el["Si"] * 2 if f == "H" else F.lit(0)).alias(f) for f in fx.FIELDS.values()]
    )
    neutral = (
        F.when(k == 7, "CBr").when((k == 6) & (el["O"] % 2 == 1), "C2O2").when(k == 6, "C")
        .when(k <= 4, fx.text(hydrocarbon)).otherwise(F.col("neutral_formula"))
    )
    rows = l.select(
        *PEAK, "role", "tier", "confidence", "ppm_error", k.alias("k"), neutral.alias("neutral_formula"),
        F.element_at(F.array(*map(F.lit, FORMS)), (k + 1).cast("int")).alias("adduct"), (el["C"] % 5 == 0).alias("locked"),
        F.when(el["S"] > 0, "series; 0 supporting anchors").alias("commentary"), (el["O"] % 2).cast("long").alias("n_iso"),
        F.when(k >= 8, "residual").otherwise("grid").alias("method"),
    )
    rows = fx.with_counts(cut_lineage(rows), "neutral_formula", "own").withColumn("delta", fx.adduct_delta(F.col("adduct")))
    own, delta = F.col("own"), F.col("delta")
    ion = F.struct(*[(own[f] + delta[f]).alias(f) for f in fx.FIELDS.values()])
    rows = cut_lineage(rows.select(*[c for c in rows.columns if c not in ("own", "delta")], ion.alias("ion")))
    sign = F.when(F.col("adduct").endswith("+"), "+").otherwise("-")
    return rows.withColumn("ion_formula", F.concat(fx.text(F.col("ion")), sign)).drop("ion")


@query("C27_rereadings", f"""WITH {LROWS}, {DEALT},
grp AS (SELECT DISTINCT sample_item_id, f FROM kept WHERE k IN (1, 8, 10, 11)), prot AS (SELECT DISTINCT sample_item_id, f FROM kept WHERE k = 4), nit AS (SELECT DISTINCT sample_item_id, f FROM kept WHERE k IN (1, 5, 8, 10, 11)),
m AS (SELECT 1 AS step, 'radical anion' AS rule, *, {_text("(c + 1)", o="3")} AS g, '[M]-.' AS form FROM kept WHERE k IN (0, 9) AND n + o + s + si = 0
  UNION ALL SELECT 2, 'reagent nitrogen', *, {_text(h="(h + 3)", n="1")}, '[M+H]+' FROM kept WHERE k = 2 AND 2 * c >= h
  UNION ALL SELECT 2, 'reagent nitrogen', *, {_text("(c + 1)", "(h + 4)", "2", "1")}, '[M+H]+' FROM kept WHERE k = 3
  UNION ALL SELECT 3, 'nitrate cluster', *, {_text(h="(h - 1)", n="(n - 1)", o="(o - 3)")}, '[M+NO3]-' FROM kept WHERE k IN (8, 10, 11) AND n >= 1 AND o >= 3),
w AS (SELECT m.*, CASE WHEN step = 1 THEN grp.f IS NOT NULL WHEN step = 2 THEN prot.f IS NOT NULL ELSE nit.f IS NOT NULL END AS told FROM m
  LEFT JOIN grp ON grp.sample_item_id = m.sample_item_id AND grp.f = m.g LEFT JOIN prot ON prot.sample_item_id = m.sample_item_id AND prot.f = m.f
  LEFT JOIN nit ON nit.sample_item_id = m.sample_item_id AND nit.f = m.g)
SELECT step, sample_item_id, peak_id, rule, f AS before_formula, adduct AS before_adduct, tier AS before_tier, g AS after_formula, form AS after_adduct,
  CASE WHEN step < 3 AND tier = 'Assigned' THEN 'Candidate' ELSE tier END AS after_tier, told AS corroborated FROM w WHERE step = 1 OR (step = 2 AND NOT told) OR (step = 3 AND told)""")
def c27(spark, sf):
    return rereading.reread(dealt(spark, sf), rereading.rules_of(labelled=True))[1]


@query("C27_halocarbons", f"""WITH {LROWS}, {DEALT}
SELECT sample_item_id, peak_id, CASE WHEN k = 7 THEN 'bromoform' WHEN n_o % 2 = 1 THEN 'dibromoacetic acid' ELSE 'dibromomethane' END AS label,
  CASE WHEN k = 6 AND n_o % 2 = 1 THEN 'M0' ELSE 'reagent' END AS role FROM kept WHERE k IN (6, 7) AND NOT locked""")
def c27_halocarbons(spark, sf):
    return rereading.halocarbons(dealt(spark, sf))[1]


@query("C26_ionisation_residual", f"""WITH {LROWS}, {CORE}, {DEALT},
major AS (SELECT DISTINCT sample_item_id, f FROM kept WHERE adduct <> '[M+CO3]-'),
r AS (SELECT kept.*, k IN (0, 1) OR (k IN (5, 8, 9, 10, 11) AND kept.n + o + s + si = 0) AS bare, k >= 8 AND tier = 'Assigned' AS res, abs(ppm_error * 3 - cal_mu) / cal_sigma AS z,
  n_o % 2 = 0 AS single, adduct = '[M+CO3]-' AND major.f IS NULL AS alone
  FROM kept LEFT JOIN lcal USING (sample_item_id) LEFT JOIN major ON major.sample_item_id = kept.sample_item_id AND major.f = kept.f),
t AS (SELECT *, CASE WHEN bare THEN 'cannot ionise' WHEN res AND z > 2 THEN 'off calibration' WHEN res AND single AND n >= 3 THEN 'nitrogens without isotopes'
  WHEN res AND anchorless = 1 THEN 'no anchors' WHEN res AND single AND alone THEN 'minor channel alone' ELSE
  CASE WHEN k = 6 AND n_o % 2 = 0 THEN 'cannot ionise' END END AS reason FROM r)
SELECT sample_item_id, peak_id, tier AS before_tier, 'Candidate' AS after_tier, reason FROM t WHERE reason IS NOT NULL""")
def c26(spark, sf):
    rows = dealt(spark, sf).withColumn("ppm_error", F.col("ppm_error") * 3)
    return rereading.demotions(rows, lcal(spark, sf))


@query("C32_bromide_clusters", f"""WITH {LROWS},
own AS (SELECT sample_item_id, peak_id, mz + 3 * (1.0078250319::DOUBLE + 78.9183371::DOUBLE) AS m, height FROM lrows WHERE role = 'M0' AND adduct = '[M+Br]-'),
pk AS (SELECT sample_item_id, peak_id, role, mz, height FROM lrows
  UNION ALL SELECT sample_item_id, peak_id || '-a', 'unexplained', m, height FROM own UNION ALL SELECT sample_item_id, peak_id || '-b', 'unexplained', m + 1.99795::DOUBLE, height * 0.97 FROM own),
un AS (SELECT * FROM pk WHERE role = 'unexplained' AND height > 0 AND mz - round_even(mz, 0) < -0.16),
h AS (SELECT u.sample_item_id, u.peak_id, up, u.height, p.peak_id AS other, p.height AS size,
    row_number() OVER (PARTITION BY u.sample_item_id, u.peak_id, up ORDER BY abs(p.mz - (u.mz + d)), p.mz, p.height, p.peak_id) AS rn
  FROM un u CROSS JOIN (VALUES (true, 1.99795::DOUBLE), (false, -1.99795::DOUBLE)) t(up, d) JOIN pk p ON p.sample_item_id = u.sample_item_id
    AND p.mz BETWEEN u.mz + d - 0.007 AND u.mz + d + 0.007 WHERE abs(u.mz + d - p.mz) <= 0.006),
w AS (SELECT sample_item_id, peak_id, max(other) FILTER (up AND size / height > 0.4 AND size / height < 3) AS above,
    max(other) FILTER (NOT up AND height / size > 0.4 AND height / size < 3) AS below FROM h WHERE rn = 1 GROUP BY 1, 2)
SELECT sample_item_id, peak_id, above, below FROM w WHERE above IS NOT NULL OR below IS NOT NULL""")
def c32_clusters(spark, sf):
    l = ad.ledger_rows(spark, sf).select(*PEAK, "role", "adduct", "mz", "height")
    m = F.col("mz") + F.lit(3 * (fx.MASS["H"] + fx.MASS["Br"]))
    own = l.where((F.col("role") == "M0") & (F.col("adduct") == "[M+Br]-"))
    lines = (("-a", 0.0, 1.0), ("-b", 1.99795, 0.97))
    line = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(d).alias("d"), F.lit(r).alias("r")) for t, d, r in lines]))
    extra = own.withColumn("q", line).select(
        "sample_item_id", F.concat("peak_id", "q.t").alias("peak_id"), F.lit("unexplained").alias("role"), "adduct",
        (m + F.col("q.d")).alias("mz"), (F.col("height") * F.col("q.r")).alias("height"),
    )
    return audit.bromide_clusters(cut_lineage(l.unionByName(extra))).select(*PEAK, "above", "below")
