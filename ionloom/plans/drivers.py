"""Whole-run compositions of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.operators import matrix


def trace(peaks: DataFrame, ledger: DataFrame, query: str | float, tol_ppm: float = 5.0) -> DataFrame:
    """One compound's trace by formula (its best-scoring ion) or by position, with its label."""
    one = F.lit(1)
    label = F.concat(
        F.concat_ws(" ", "neutral_formula", "adduct"), F.lit(" ("), F.coalesce("tier", F.lit("?")), F.lit(")")
    )
    if isinstance(query, str):
        best = ledger.where(F.col("neutral_formula") == query).agg(
            F.min(F.struct((-F.col("ion_score")).alias("s"), F.col("mz"), label.alias("assignment"))).alias("b")
        )
        ion = F.broadcast(
            best.select(F.col("b.mz").alias("ion_mz"), F.col("b.assignment").alias("assignment")).withColumn("one", one)
        )
        near = (
            peaks.withColumn("one", one)
            .join(ion, "one")
            .where(F.abs(F.col("mz") - F.col("ion_mz")) / F.col("ion_mz") * 1e6 <= tol_ppm)
        )
        return near.groupBy("datetime_utc").agg(
            F.sum("height").alias("height"),
            F.count_distinct("peak_id").alias("n_peak_ids"),
            F.max("assignment").alias("assignment"),
        )
    at = float(query)
    near = ledger.where(F.abs(F.col("mz") - at) / at * 1e6 <= tol_ppm).agg(
        F.min(F.struct(F.abs(F.col("mz") - at).alias("d"), F.col("mz"), label.alias("assignment"))).alias("b")
    )
    named = F.broadcast(
        near.select(F.coalesce("b.assignment", F.lit("unassigned")).alias("assignment")).withColumn("one", one)
    )
    return matrix.window_trace(peaks, at, tol_ppm).withColumn("one", one).join(named, "one").drop("one")
