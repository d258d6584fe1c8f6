"""Commit of a pass: whole ledger rows are dealt once, displaced owners lose their satellites."""

import re

import pytest
from pyspark.sql import functions as F

from ionloom.operators.claims import RULES, commit

LEDGER = (
    "sample_item_id string, peak_id string, mz double, height double, role string, locked boolean, neutral_formula string, adduct string, "
    "ion_formula string, ion_score double, ppm_error double, confidence string, method string, pass_no long, tier string, "
    "parent_peak_id string, iso_label string, iso_match_score double"
)
WINNERS = (
    "sample_item_id string, peak_id string, neutral_formula string, adduct string, ion_formula string, ion_score double, "
    "compound_score double, raw_score double, eff_score double, eff_margin double, ppm_error double, n_iso int, tied boolean"
)
CHILDREN = "sample_item_id string, peak_id string, parent_peak_id string, iso_label string, iso_match_score double, parent_score double"


def _row(peak, role="unexplained", score=None, confidence=None, locked=False, parent=None):
    owner = role == "M0"
    return ("s", peak, 100.0, 5.0, role, locked, "C4H8O2" if owner else None, "[M-H]-" if owner else None, "C4H7O2-" if owner else None,
            score, 0.1 if owner else None, confidence, "grid" if owner else None, 1 if owner else None, None, parent,
            "13C" if parent else None, 0.5 if parent else None)


def _tables(spark):
    ledger = spark.createDataFrame([
        _row("new"), _row("old", "M0", 0.6, "Good"), _row("kid", "iso_child", parent="old"), _row("held", "iso_child", parent="old", locked=True),
        _row("sure", "M0", 0.6, "High"), _row("stale", "M0", 0.9, "Good", parent="old"), _row("free"), _row("last"),
    ], LEDGER)
    winners = spark.createDataFrame([("s", "new", "C6H10O5", "[M-H]-", "C6H9O5-", 0.95, 0.95, 0.95, 0.95, None, 0.1, 2, False)], WINNERS)
    children = spark.createDataFrame([
        ("s", "old", "new", "81Br", 0.9, 0.95), ("s", "sure", "new", "13C", 0.9, 0.95), ("s", "free", "new", "34S", 0.8, 0.95),
        ("s", "free", "new", "13C", 0.7, 0.95), ("s", "last", "old", "13C", 0.9, 0.6), ("s", "held", "new", "13C", 0.9, 0.95),
    ], CHILDREN)
    return ledger, winners, children


def test_displaced_owners_lose_their_satellites(spark):
    got = {r["peak_id"]: r for r in commit(*_tables(spark), RULES["backbone"]).collect()}
    assert len(got) == 8
    state = {k: (r["role"], r["parent_peak_id"]) for k, r in got.items()}
    assert state["new"] == ("M0", None) and state["sure"] == ("M0", None)
    assert state["old"] == ("iso_child", "new") and got["old"]["neutral_formula"] is None
    assert state["kid"] == ("unexplained", None) and state["stale"] == ("unexplained", None)
    assert state["held"] == ("iso_child", "old")
    assert state["free"] == ("iso_child", "new") and got["free"]["iso_label"] == "13C+34S" and got["free"]["iso_match_score"] == 0.8
    assert state["last"] == ("unexplained", None)  # its parent is no owner any more


@pytest.fixture
def shuffled_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_whole_rows_are_dealt_once(spark, shuffled_joins):
    ledger, winners, children = _tables(spark)
    out = commit(ledger.withColumn("note", F.col("mz") + 1), winners, children, RULES["backbone"])
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = out._jdf.queryExecution().explainString(mode)
    dealt = [block for block in re.split(r"\n\n+", plan) if re.search(r"^\(\d+\) Exchange", block.strip()) and "note#" in block]
    assert len(dealt) == 1
