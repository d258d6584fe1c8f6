"""Nested sources: match trees and reference lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = (
    "struct<target_isotope_formula:string,mz:double,relative_abundance:double,match_score:double,"
    "match_category:string,sample_peak_id:string,sample_peak_mz:double,sample_peak_intensity:double,"
    "match_abundance_error:double>"
)
ION = (
    "struct<target_ion_formula:string,match_score:double,match_category:string,"
    f"ionization_mechanism_id:string,children:array<{LINE}>>"
)
TREE_SCHEMA = (
    "array<struct<target_compound_formula:string,match_score:double,match_category:string,"
    f"children:array<{ION}>>>"
)
LIST_SCHEMA = (
    "id string, label string, system string, polarity string, always_active boolean, "
    "applies_to_contexts array<string>, species array<struct<formula:string,name:string,origin:string,"
    "modes:array<string>,conditions:array<string>,radical:boolean>>"
)


def flatten_match_tree(df: DataFrame, column: str) -> DataFrame:
    """Compound -> ion -> line trees (JSON text) as one row per line.

    A mass error exists only where a real peak was matched. Other columns of
    ``df`` are carried along.
    """
    keep = [c for c in df.columns if c != column]
    comp = df.select(*keep, F.explode(F.from_json(column, TREE_SCHEMA)).alias("c"))
    ion = comp.select(*keep, "c", F.explode("c.children").alias("i"))
    line = ion.select(*keep, "c", "i", F.explode("i.children").alias("l"))
    heavy = F.regexp_extract_all(F.coalesce("l.target_isotope_formula", F.lit("")), F.lit(r"\[(\d+[A-Z][a-z]?)\]\d*"), 1)
    times = F.regexp_extract_all(F.coalesce("l.target_isotope_formula", F.lit("")), F.lit(r"\[\d+[A-Z][a-z]?\](\d*)"), 1)
    named = F.zip_with(heavy, times, lambda s, k: F.when(k.isin("", "1"), s).otherwise(F.concat(s, k)))
    is_base = F.size(heavy) == 0
    matched = (
        (F.coalesce("l.sample_peak_id", F.lit("")) != "")
        & (F.coalesce("l.sample_peak_intensity", F.lit(0.0)) > 0)
        & (F.coalesce("l.sample_peak_mz", F.lit(0.0)) > 0)
        & (F.coalesce("l.mz", F.lit(0.0)) != 0)
    )
    return line.select(
        *keep,
        F.col("c.target_compound_formula").alias("compound_formula"),
        F.col("c.match_score").alias("compound_score"),
        F.col("c.match_category").alias("compound_category"),
        F.col("i.target_ion_formula").alias("ion_formula"),
        F.col("i.match_score").alias("ion_score"),
        F.col("i.match_category").alias("ion_category"),
        F.col("i.ionization_mechanism_id").alias("mechanism_id"),
        F.col("l.target_isotope_formula").alias("isotope_formula"),
        F.when(is_base, "M0").otherwise(F.array_join(named, "+")).alias("iso_label"),
        is_base.alias("is_base"),
        F.col("l.mz").alias("theo_mz"),
        F.col("l.relative_abundance").alias("rel_abundance"),
        F.col("l.match_score").alias("iso_score"),
        F.col("l.match_category").alias("iso_category"),
        F.nullif("l.sample_peak_id", F.lit("")).alias("sample_peak_id"),
        F.col("l.sample_peak_mz").alias("sample_peak_mz"),
        F.col("l.sample_peak_intensity").alias("sample_peak_intensity"),
        F.when(matched, (F.col("l.sample_peak_mz") - F.col("l.mz")) / F.col("l.mz") * 1e6).alias("ppm_error"),
        F.col("l.match_abundance_error").alias("abundance_error"),
    )


def reanchor_labelled(
    rows: DataFrame, keys: Sequence[str], line: str, delta: float = 0.997035, label: str = "15N",
    tol: float = 0.01,
) -> DataFrame:
    """Move the base flag of an ion to the line ``delta`` above its all-light base.

    Applies where such a line exists within ``tol``; ``line`` identifies a line
    within its ion and settles ties.
    """
    keys = list(keys)
    base = rows.where("is_base").groupBy(*keys).agg(F.min("theo_mz").alias("_base"))
    gap = F.abs(F.col("theo_mz") - (F.col("_base") + delta))
    pick = (
        rows.where((F.col("iso_label") == label) & F.col("theo_mz").isNotNull())
        .join(base, keys)
        .groupBy(*keys)
        .agg(F.min(F.struct(gap.alias("d"), F.col("theo_mz").alias("m"), F.col(line).alias("line"))).alias("_pick"))
        .where(F.col("_pick.d") <= tol)
    )
    joined = rows.join(pick, keys, "left")
    moved = F.col("_pick").isNotNull()
    chosen = moved & (F.col(line) == F.col("_pick.line"))
    return joined.select(
        *[c for c in rows.columns if c not in ("iso_label", "is_base")],
        F.when(chosen, "M0").otherwise(F.col("iso_label")).alias("iso_label"),
        F.when(chosen, True).when(moved, False).otherwise(F.col("is_base")).alias("is_base"),
    )


def load_lists(spark: SparkSession, path: str) -> DataFrame:
    """Every reference list (one JSON object per file) under a folder, one row per species."""
    return explode_lists(spark.read.schema(LIST_SCHEMA).option("multiLine", True).json(path))


def explode_lists(lists: DataFrame) -> DataFrame:
    species = lists.select(
        F.col("id").alias("list_id"), F.coalesce("label", "id").alias("label"), "polarity",
        F.coalesce("always_active", F.lit(False)).alias("always_active"), F.explode("species").alias("s"),
    )
    return species.where(F.coalesce("s.formula", F.lit("")) != "").select(
        "list_id", "label", "polarity", "always_active",
        F.col("s.formula").alias("formula"),
        F.coalesce("s.radical", F.lit(False)).alias("radical"),
        F.col("s.name").alias("name"), F.col("s.origin").alias("origin"),
        F.col("s.modes").alias("modes"), F.col("s.conditions").alias("conditions"),
    )
