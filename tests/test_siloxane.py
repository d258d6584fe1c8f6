"""The siloxane ladder: silicon lines and their heights decide."""

import pytest
from pyspark.sql import functions as F

from ionloom.functions import formula as fx
from ionloom.operators import chem, passes

TYPED = {
    "neutral_formula": "string", "adduct": "string", "ion_formula": "string", "ion_score": "double", "ppm_error": "double",
    "confidence": "string", "method": "string", "pass_no": "long", "tier": "string", "parent_peak_id": "string",
    "iso_label": "string", "iso_match_score": "double",
}
LADDER = [f"C{2 * n}H{6 * n}O{n}Si{n}" for n in range(4, 8)]


def _ledger(spark, m1_factor):
    """One sample with the ladder's ions and their lines; M+1 lines are scaled."""
    names = spark.createDataFrame([("s", f) for f in LADDER], "sample_item_id string, formula string")
    cands = names.withColumn("el", fx.counts(F.col("formula"))).withColumn("adduct", F.lit("[M-H]-"))
    ions = chem.with_ions(cands)
    lines = chem.isotope_templates(ions.select("ion_formula", F.col("ion_el").alias("el")), 0.01)
    rows = ions.join(lines, "ion_formula").select(
        "sample_item_id",
        F.concat_ws("-", "formula", F.col("line_no").cast("string")).alias("peak_id"),
        (F.col("ion_mz") + F.col("step")).alias("mz"),
        (F.col("rel") * 1e6 * F.when(F.col("step").between(0.9, 1.1), m1_factor).otherwise(1.0)).alias("height"),
    )
    rows = rows.withColumn("role", F.lit("unexplained")).withColumn("locked", F.lit(False))
    for c, t in TYPED.items():
        rows = rows.withColumn(c, F.lit(None).cast(t))
    return rows


def _found(spark, m1_factor):
    grid = chem.candidate_grid(spark, {"C": (8, 14), "H": (20, 44), "O": (3, 8), "Si": (3, 8)})
    ledger = passes.siloxane_pass(_ledger(spark, m1_factor).checkpoint(), grid.checkpoint(), ["[M-H]-"])
    return {r["neutral_formula"] for r in ledger.where("role = 'M0'").collect()}


@pytest.fixture(autouse=True)
def _folder(spark):
    from ionloom.session import shared_folder

    shared_folder(spark)


def test_a_ladder_is_read(spark):
    assert _found(spark, 1.0) >= set(LADDER)


def test_too_faint_silicon_lines_are_not(spark):
    assert not _found(spark, 0.3) & set(LADDER)
