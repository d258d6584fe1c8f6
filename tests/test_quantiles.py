import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ionloom.functions.quantiles import exact_quantiles


def test_equals_numpy(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame(
        {
            "k": rng.choice(["hot", "a", "b"], p=[0.9, 0.07, 0.03], size=5000),
            "v": np.round(rng.lognormal(3, 2, size=5000), 1),
        }
    )
    pdf.loc[:9, "v"] = None
    got = exact_quantiles(
        spark.createDataFrame(pdf), ["k"], "v", {"p10": 0.1, "med": 0.5, "p95": 0.95}
    ).toPandas().set_index("k")
    for k, g in pdf.dropna().groupby("k"):
        want = np.percentile(g["v"], [10, 50, 95])
        np.testing.assert_allclose(got.loc[k, ["p10", "med", "p95"]].astype(float), want, rtol=1e-12)


def test_without_keys(spark):
    df = spark.createDataFrame([(2.0,), (3.0,), (4.0,)], "v double")
    assert exact_quantiles(df, [], "v", {"p95": 0.95}).first()["p95"] == pytest.approx(3.9)


def test_values_that_differ_when_computed_again(spark):
    """Sums in another order differ in their last bits, so the values must be taken once."""
    again = F.udf(lambda _: random.random(), "double")
    rows = spark.range(84 * 40).select((F.col("id") % 40).alias("k"), (F.col("id") * 7919 % 84).cast("double").alias("v"))
    noisy = rows.groupBy("k", "v").agg(F.first("v").alias("y")).withColumn("y", F.col("y") * (1 + 1e-9 * again("y")))
    got = exact_quantiles(noisy, ["k"], "y", {"med": 0.5}).toPandas().set_index("k")["med"]
    assert len(got) == 40 and got.notna().all()
    for k, g in rows.toPandas().groupby("k"):
        assert got[k] == pytest.approx(np.median(g["v"]), rel=1e-8)
