import os
import re

import pytest
from pyspark.sql import functions as F

from ionloom import session
from ionloom.functions import formula as fx
from ionloom.operators import passes

LEDGER = "sample_item_id string, peak_id string, mz double, height double, role string, neutral_formula string, adduct string, confidence string, ion_score double"


def _ion(formula):
    counts = {e: int(n or 1) for e, n in re.findall(r"([A-Z][a-z]?)(\d*)", formula)}
    return fx.plain_mass(counts) + fx.adduct_shift("[M-H]-")


def _ledger(spark, formulas, copies=1):
    rows = [("s", "a", _ion("C4H8O2"), 1e4, "M0", "C4H8O2", "[M-H]-", "High", 0.9)]
    rows += [("s", f"{f}-{i}", _ion(f), 1e3, "unexplained", None, None, None, None) for f in formulas for i in range(copies)]
    return spark.createDataFrame(rows, LEDGER)


def _claims_all(ledger, hits, rule, cal=None, only=None):
    """Every free peak at a position of ``only`` is owned by the first formula that meets it."""
    own = only.groupBy("sample_item_id", "mz").agg(F.min("formula").alias("f"), F.min("adduct").alias("ad"))
    free = (F.col("role") == "unexplained") & F.col("f").isNotNull()
    out = ledger.join(own, ["sample_item_id", "mz"], "left").withColumns({
        "role": F.when(free, "M0").otherwise(F.col("role")), "neutral_formula": F.when(free, F.col("f")).otherwise(F.col("neutral_formula")),
        "adduct": F.when(free, F.col("ad")).otherwise(F.col("adduct")), "confidence": F.when(free, "Good (series)").otherwise(F.col("confidence")),
    })
    return session.cut_lineage(out.select(*ledger.columns))


def test_a_series_is_walked_to_its_end(spark, monkeypatch):
    monkeypatch.setattr(passes, "run_pass", _claims_all)
    chain = [f"C{4 + k}H{8 + 2 * k}O2" for k in range(1, 7)]
    out = passes.series_walk(_ledger(spark, chain), ["[M-H]-"])
    assert sorted(r["neutral_formula"] for r in out.where("role = 'M0'").collect()) == sorted(["C4H8O2", *chain])


def test_copies_of_a_position_meet_a_proposal_once(spark):
    ledger = _ledger(spark, ["C5H10O2"], copies=50)
    ways = passes.formulas_of(passes.stepped(passes.anchors(ledger), ["CH2"], [1]))
    hits = passes.on_free_positions(ways, ledger, ["[M-H]-"]).collect()
    assert [(r["formula"], r["adduct"]) for r in hits] == [("C5H10O2", "[M-H]-")]


def test_a_ladder_keeps_one_way_per_formula(spark, monkeypatch):
    """CO2 is C and O2 apart by many routes; the one of fewest steps goes on."""
    seen = []

    def caught(proposals, *_):
        seen.extend(proposals.collect())
        raise StopIteration

    monkeypatch.setattr(passes, "on_free_positions", caught)
    with pytest.raises((StopIteration, RuntimeError)):
        passes.ladder_fill(_ledger(spark, []), ["[M-H]-"])
    by_formula = {r["formula"]: r["way"]["far"] for r in seen}
    assert len(by_formula) == len(seen) and by_formula["C5H8O4"] == 1 and by_formula["C6H12O2"] == 2


def test_steps_are_those_of_whole_units(spark):
    """No count falls below zero, and each move adds its unit times its steps."""
    got = {(r["unit"], r["n_steps"]): r["formula"] for r in passes.stepped(passes.anchors(_ledger(spark, [])), ["CH2", "O"], [-3, -1, 2]).collect()}
    assert got == {("CH2", -3): "CH2O2", ("CH2", -1): "C3H6O2", ("CH2", 2): "C6H12O2", ("O", -1): "C4H8O", ("O", 2): "C4H8O4"}


def test_adduct_atoms_are_those_of_the_table(spark):
    rows = spark.createDataFrame([(a,) for a in [*fx.ADDUCTS, "?"]], "a string").select("a", fx.adduct_delta(F.col("a")).alias("d")).collect()
    got = {r["a"]: r["d"] and r["d"].asDict() for r in rows}
    assert got == {**{a: {f: d.get(e, 0) for e, f in fx.FIELDS.items()} for a, (d, _) in fx.ADDUCTS.items()}, "?": None}


def test_tables_of_a_block_go_with_it(spark):
    def files(df):
        return [f.removeprefix("file:") for f in df.inputFiles()]

    with session.scratch(spark) as outer:
        with session.scratch(spark) as keep:
            gone = session.cut_lineage(spark.range(5))
            inner, kept = files(gone), keep(gone.selectExpr("id + 1 AS id"))
        assert not any(map(os.path.exists, inner)) and kept.count() == 5
        first, second = session.cut_lineage(kept), session.cut_lineage(kept)
        released = files(first)
        session.release(first)
        assert not any(map(os.path.exists, released)) and second.count() == 5
        left = files(kept)
        result = outer(second)
    assert not any(map(os.path.exists, left)) and sorted(r["id"] for r in result.collect()) == [1, 2, 3, 4, 5]


def test_writing_a_table_leaves_the_settings_alone(spark):
    before = spark.conf.get(session._CLEAN, None)
    table = session.cut_lineage(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    assert table.count() == 7 and spark.conf.get(session._CLEAN, None) == before
