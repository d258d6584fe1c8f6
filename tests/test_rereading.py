"""Re-readings keep the ion, ask for the testimony of their rule, and say what they changed."""

import re
from collections import Counter

from pyspark.sql import functions as F

from ionloom.functions import formula as fx
from ionloom.operators import audit, rereading

SCHEMA = (
    "sample_item_id string, peak_id string, role string, neutral_formula string, adduct string, tier string, method string, "
    "commentary string, n_iso long, ppm_error double, ion_formula string, locked boolean, extra int"
)


def ledger_of(spark, rows):
    full = [
        ("s", str(i), r.get("role", "M0"), r.get("f"), r.get("a"), r.get("tier", "Assigned"), r.get("method", "grid"), r.get("note"),
         r.get("n_iso", 0), r.get("ppm", 0.0), r.get("ion"), r.get("locked"), i)
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA)


def atoms(formula):
    out = Counter()
    for symbol, k in re.findall(r"(\^?[A-Z][a-z]?)(\d*)", formula):
        out[symbol] += int(k or 1)
    return out


def test_every_move_keeps_the_ion():
    for rule in [*rereading.rules_of("Br", True), *rereading.rules_of("Cl"), *rereading.rules_of("I")]:
        assert rule.forms
        for old, (gain, new) in rule.forms.items():
            a, b = Counter(fx.ADDUCTS[old][0]), Counter(fx.ADDUCTS[new][0])
            b.update(gain)
            # A label on the nitrogen of a cluster is not known to its neutral.
            for c in (a, b):
                c["N"] += c.pop("^N", 0)
            assert {e: n for e, n in a.items() if n} == {e: n for e, n in b.items() if n}
            assert fx.ADDUCTS[old][1] == fx.ADDUCTS[new][1]


def test_rules_and_their_testimony(spark):
    rows = [
        {"f": "C6H6", "a": "[M+CO3]-"},  # 0: radical anion of C7H6O3, told by 1
        {"f": "C7H6O3", "a": "[M-H]-"},
        {"f": "C8H8", "a": "[M+CO3]-"},  # 2: nobody tells of C9H8O3
        {"f": "C6H6O", "a": "[M+CO3]-"},  # 3: has a functional group
        {"f": "C6H6", "a": "[M+NO3]-"},  # 4: C6H6NO3 is no closed shell
        {"f": "C5H6", "a": "[M+(CH4N2O)H]+"},  # 5: C6H10N2O
        {"f": "C5H6", "a": "[M+NH4]+", "tier": "Candidate"},  # 6: C5H9N
        {"f": "C10H16", "a": "[M+NH4]+"},  # 7: a terpene seen protonated in 8
        {"f": "C10H16", "a": "[M+H]+"},
        {"f": "C10H15NO6", "a": "[M-H]-"},  # 9: nitrate cluster of C10H14O3 in 10
        {"f": "C10H14O3", "a": "[M+^NO3]-"},
        {"f": "C9H13NO6", "a": "[M-H]-"},  # 11: no parent
        {"f": "C6H6", "a": "[M+CO3]-", "role": "unexplained"},  # 12: owns nothing
        {"f": None, "a": "[M+CO3]-"},
        {"f": "C6H6", "a": None},
        {"f": "", "a": "[M+NH4]+"},
    ]
    after, audit = rereading.reread(ledger_of(spark, rows), rereading.rules_of(labelled=True))
    got = {int(r["peak_id"]): r for r in after.collect()}
    assert len(got) == len(rows) and all(r["extra"] == i for i, r in got.items())
    moved = {0: ("C7H6O3", "[M]-.", "C7H6O3-"), 2: ("C9H8O3", "[M]-.", "C9H8O3-"), 5: ("C6H10N2O", "[M+H]+", "C6H11N2O+"),
             6: ("C5H9N", "[M+H]+", "C5H10N+"), 9: ("C10H14O3", "[M+NO3]-", "C10H14NO6-")}
    for i, r in got.items():
        if i in moved:
            assert (r["neutral_formula"], r["adduct"], r["ion_formula"]) == moved[i]
        else:
            assert (r["neutral_formula"], r["adduct"]) == (rows[i]["f"], rows[i]["a"])
    assert [got[i]["below_assignability"] for i in (0, 2, 5, 6, 9, 1)] == [False, True, True, True, False, False]
    assert [got[i]["tier"] for i in (0, 2, 5, 6, 9, 1)] == ["Candidate"] * 4 + ["Assigned"] * 2
    steps = {int(r["peak_id"]): (r["step"], r["rule"], r["corroborated"], r["before_formula"]) for r in audit.collect()}
    assert steps == {
        0: (1, "radical anion", True, "C6H6"), 2: (1, "radical anion", False, "C8H8"), 5: (2, "reagent nitrogen", False, "C5H6"),
        6: (2, "reagent nitrogen", False, "C5H6"), 9: (3, "nitrate cluster", True, "C10H15NO6"),
    }
    # Nothing is left to re-read.
    assert rereading.reread(after, rereading.rules_of(labelled=True))[1].count() == 0


def test_reagent_halogen_comes_first(spark):
    rows = [{"f": "C6H7Br", "a": "[M-H]-"}, {"f": "C6H7Br", "a": "[M+Br]-"}, {"f": "C6H7Br", "a": "[M+H]+"}, {"f": "C6H7BrO", "a": "[M+CO3]-"}]
    after, audit = rereading.reread(ledger_of(spark, rows), rereading.rules_of("Br"))
    got = {int(r["peak_id"]): (r["neutral_formula"], r["adduct"]) for r in after.collect()}
    assert got == {0: ("C6H6", "[M+Br]-"), 1: ("C6H6", "[M+HBr+Br]-"), 2: ("C6H7Br", "[M+H]+"), 3: ("C6H6O", "[M+HBr+CO3]-")}
    for r in audit.collect():
        before, now = atoms(r["before_formula"]), atoms(r["after_formula"])
        before.update(fx.ADDUCTS[r["before_adduct"]][0])
        now.update(fx.ADDUCTS[r["after_adduct"]][0])
        assert +before == +now


def test_repeats_and_empty(spark):
    twice = ledger_of(spark, [{"f": "C6H6", "a": "[M+CO3]-"}, {"f": "C7H6O3", "a": "[M+Cl]-"}])
    after, audit = rereading.reread(twice.unionByName(twice), [rereading.RADICAL_ANION])
    assert after.count() == 4 and audit.count() == 2
    after, audit = rereading.reread(twice.limit(0), rereading.rules_of("Br", True))
    assert after.count() == 0 and audit.count() == 0
    after, audit = rereading.reread(twice, [])
    assert after.count() == 2 and audit.count() == 0


def test_halocarbons_by_their_ion(spark):
    rows = [
        {"f": "C", "a": "[M+HBr+Br]-", "ion": "CHBr2-"}, {"f": "C", "a": "[M+HBr+Br]-", "ion": "Br2CH-"}, {"f": "CBr", "a": "[M+Br2]-", "ion": "CBr3-"},
        {"f": "C2O2", "a": "[M+HBr+Br]-", "ion": "C2HBr2O2-"}, {"f": "C", "a": "[M+HBr+Br]-", "ion": "CHBr2-", "locked": True},
        {"f": "CH2", "a": "[M+Br]-", "ion": "CH2Br-"}, {"f": "CCl", "a": "[M+Br]-", "ion": "CHBr2Cl-"}, {"ion": None},
    ]
    after, changed = rereading.halocarbons(ledger_of(spark, rows))
    got = {int(r["peak_id"]): (r["role"], r["neutral_formula"]) for r in after.collect()}
    assert [got[i][0] for i in range(8)] == ["reagent"] * 3 + ["M0"] * 5
    assert got[3][1] == "C2H2Br2O2" and got[5][1] == "CH2"
    assert {int(r["peak_id"]) for r in changed.collect()} == {0, 1, 2, 3}


def test_demotions_of_impossible_and_speculative_readings(spark):
    rows = [
        {"f": "C7H10", "a": "[M-H]-"}, {"f": "C7H10", "a": "[M+O2]-"}, {"f": "C7H10", "a": "[M+H]+"},
        {"f": "C7H10O", "a": "[M-H]-", "method": "residual", "ppm": 3.0}, {"f": "C7H10O", "a": "[M-H]-", "ppm": 3.0},
        {"f": "C7H9N3", "a": "[M-H]-", "method": "residual"}, {"f": "C7H9N3", "a": "[M-H]-", "method": "residual", "n_iso": 1},
        {"f": "C8H10O", "a": "[M-H]-", "method": "residual-deep", "note": "x; 0 supporting anchors"},
        {"f": "C9H10O", "a": "[M+CO3]-", "method": "residual"}, {"f": "C8H10O", "a": "[M+CO3]-", "method": "residual"},
        {"f": None, "a": None, "method": "residual"}, {"f": "C6H8", "a": "[M+Cl]-", "tier": None},
    ]
    ledger = ledger_of(spark, rows)
    cal = spark.createDataFrame([("s", 0.0, 1.0)], "sample_item_id string, cal_mu double, cal_sigma double")
    audit = rereading.demotions(ledger, cal)
    want = {0: "cannot ionise", 3: "off calibration", 5: "nitrogens without isotopes", 7: "no anchors", 8: "minor channel alone", 11: "cannot ionise"}
    assert {int(r["peak_id"]): r["reason"] for r in audit.collect()} == want
    after = {int(r["peak_id"]): r for r in rereading.apply_demotions(ledger, audit).collect()}
    assert {i for i, r in after.items() if r["below_assignability"]} == set(want)
    assert [after[i]["tier"] for i in (0, 3, 4, 11)] == ["Candidate", "Candidate", "Assigned", None]
    none = rereading.demotions(ledger, cal.where(F.lit(False)))
    assert {int(r["peak_id"]) for r in none.collect()} == set(want) - {3}


def test_bromide_clusters_need_defect_and_twin(spark):
    peaks = [
        ("s", "a", "unexplained", 400.70, 100.0), ("s", "b", "unexplained", 402.69795, 97.0),  # a pair
        ("s", "c", "unexplained", 500.70, 100.0), ("s", "d", "M0", 502.70, 10.0),  # a twin too small
        ("s", "e", "unexplained", 600.10, 100.0), ("s", "f", "unexplained", 602.09795, 97.0),  # positive defect
        ("s", "g", "M0", 700.70, 100.0), ("s", "h", "unexplained", 702.69795, 97.0),  # an owner below
        ("s", "i", "unexplained", 800.70, 100.0), ("t", "j", "unexplained", 802.69795, 97.0),  # another sample
        ("s", "k", "unexplained", 900.70, 100.0), ("s", "l", "artifact", 902.69795, None),
        ("s", "m", "unexplained", None, 100.0),
    ]
    frame = spark.createDataFrame(peaks, "sample_item_id string, peak_id string, role string, mz double, height double")
    covalent = spark.createDataFrame(
        [("s", "a", "C2Br3-", 0.9), ("s", "a", "CBr3O-", 0.9), ("s", "b", "CBr3-", 0.69)],
        "sample_item_id string, peak_id string, ion_formula string, ion_score double",
    )
    found = audit.bromide_clusters(frame, covalent)
    assert {r["peak_id"]: (r["above"], r["below"], r["ion_formula"]) for r in found.collect()} == {
        "a": ("b", None, "C2Br3-"), "b": (None, "a", None), "h": (None, "g", None)
    }
    after = audit.label_clusters(frame.withColumn("ion_formula", F.lit(None).cast("string")), found)
    assert {r["peak_id"]: r["ion_formula"] for r in after.where("role = 'reagent'").collect()} == {"a": "C2Br3-", "b": None, "h": None}
    assert after.count() == len(peaks) and audit.bromide_clusters(frame.limit(0)).count() == 0
