"""Costs of the shapes that queries read: what is compiled, what is shuffled, what is parsed."""

import pytest
from pyspark.sql import functions as F

from ionloom.functions import formula as fx
from ionloom.operators import report
from ionloom.plans import adapters as ad
from ionloom.plans import chem_queries

SF = "/root/testdata/sf0.001"


def longest_method(spark, df) -> int:
    """Bytes of the longest method compiled for ``df``; the JVM never optimises one of more than 8000."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = df.selectExpr("*")._jdf.queryExecution().debug().codegenToSeq()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    return max(parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size()))


@pytest.mark.parametrize("shape", [ad.ledger_rows, ad.spectra, chem_queries.scored])
def test_rows_are_made_by_code_the_jvm_optimises(spark, shape):
    assert longest_method(spark, shape(spark, SF)) <= 8000


def test_only_satellites_have_parents(spark):
    rows = ad.ledger_rows(spark, SF).select("sample_item_id", "peak_id", "role", "parent_peak_id").collect()
    assert len(rows) == ad.table(spark, SF, "lineitem").count()
    best = {}
    for r in rows:
        key = (r.sample_item_id, r.peak_id.split("-")[0])
        if r.role == "M0":
            best[key] = min(best.get(key, r.peak_id), r.peak_id)
    for r in rows:
        key = (r.sample_item_id, r.peak_id.split("-")[0])
        assert r.parent_peak_id == (best.get(key) if r.role == "iso_child" else None)


def test_owners_alone_need_no_join(spark):
    plan = ad.ledger_rows(spark, SF).where("role = 'M0'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_a_formula_is_parsed_once(spark):
    rows = spark.range(1000).select(F.concat(F.lit("C5H"), (F.col("id") % 3 + 9).cast("string"), F.lit("N")).alias("neutral_formula"))
    for made in (report.shadowed_amines(rows), fx.with_counts(rows, "neutral_formula")):
        assert "regexp" not in made._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {(r["neutral_formula"], r["el"]["C"], r["el"]["H"], r["el"]["N"], r["el"]["Cl"]) for r in fx.with_counts(rows, "neutral_formula").collect()} == {
        (f"C5H{h}N", 5, h, 1, 0) for h in (9, 10, 11)
    }
