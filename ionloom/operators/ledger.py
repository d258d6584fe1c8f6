"""The ledger: one row per physical peak, its roles, its state changes and its checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ("M0", "iso_child", "reagent", "artifact", "unexplained")
PEAK = ["sample_item_id", "peak_id"]


def new_ledger(peaks: DataFrame) -> DataFrame:
    """One row per (sample, peak): the copy of greatest height (else area), all unexplained.

    A map-side-combined maximum, so that a much-copied peak never gathers in one task.
    """
    rank = F.struct(
        F.coalesce("height", "area", F.lit(float("-inf"))).alias("size"), F.col("mz").alias("m")
    )
    others = [c for c in peaks.columns if c not in PEAK]
    return (
        peaks.groupBy(*PEAK)
        .agg(F.max_by(F.struct(*others), rank).alias("row"))
        .select(*PEAK, "row.*")
        .withColumn("role", F.lit("unexplained"))
        .withColumn("locked", F.lit(False))
    )


def in_role(ledger: DataFrame, *roles: str, min_height: float | None = None) -> DataFrame:
    """Rows of some roles; a missing height counts as zero against a cutoff."""
    out = ledger.where(F.col("role").isin(*roles))
    if min_height is not None:
        out = out.where(F.coalesce("height", F.lit(0.0)) >= min_height)
    return out


def violations(ledger: DataFrame) -> DataFrame:
    """Broken invariants, one row each: ``(rule, sample_item_id, peak_id)``."""
    role = F.col("role")
    dup = (
        ledger.groupBy(*PEAK).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        .select(F.lit("duplicate peak").alias("rule"), *PEAK)
    )
    odd = ledger.where(~role.isin(*ROLES) | role.isNull()).select(F.lit("unknown role").alias("rule"), *PEAK)
    bare = ledger.where(
        (role == "M0") & (F.col("neutral_formula").isNull() | F.col("method").isNull() | F.col("confidence").isNull())
    ).select(F.lit("M0 without provenance").alias("rule"), *PEAK)
    owners = ledger.where(role == "M0").select(
        F.col("sample_item_id").alias("s"), F.col("peak_id").alias("p")
    )
    orphans = (
        ledger.where(role == "iso_child")
        .join(owners, (F.col("sample_item_id") == F.col("s")) & (F.col("parent_peak_id") == F.col("p")), "left_anti")
        .select(F.lit("child without M0 parent").alias("rule"), *PEAK)
    )
    return dup.unionByName(odd).unionByName(bare).unionByName(orphans)


# Columns a row loses when it stops being an owner or a child.
_STATE = (
    "neutral_formula", "adduct", "ion_formula", "ion_score", "ppm_error", "confidence", "method",
    "pass_no", "tier", "parent_peak_id", "iso_label", "iso_match_score",
)


def clear(ledger: DataFrame, targets: DataFrame) -> DataFrame:
    """Set the rows keyed in ``targets`` back to unexplained, and the children they owned too.

    ``targets``: ``(sample_item_id, peak_id)``. Locked rows keep their state.
    """
    hit = targets.select(*PEAK).distinct().withColumn("_hit", F.lit(True))
    parent = hit.select(
        "sample_item_id", F.col("peak_id").alias("parent_peak_id"), F.col("_hit").alias("_orphan")
    )
    marked = ledger.join(hit, PEAK, "left")
    # Rows without a parent carry scattered keys so that they do not meet in one task.
    key = F.coalesce("parent_peak_id", F.concat(F.lit("~"), F.pmod(F.xxhash64("peak_id"), F.lit(4096)).cast("string")))
    marked = (
        marked.withColumn("_pk", key)
        .join(parent.withColumnRenamed("parent_peak_id", "_pk"), ["sample_item_id", "_pk"], "left")
        .drop("_pk")
    )
    gone = (F.coalesce("_hit", F.lit(False)) | F.coalesce("_orphan", F.lit(False))) & ~F.coalesce(
        "locked", F.lit(False)
    )
    return _reset(marked, gone, ledger.columns)


def reset(ledger: DataFrame, gone: DataFrame) -> DataFrame:
    """Set exactly the rows keyed in ``gone``, one per row, back to unexplained."""
    marked = ledger.join(gone.select(*PEAK, F.lit(True).alias("_gone")), PEAK, "left")
    return _reset(marked, F.coalesce("_gone", F.lit(False)), ledger.columns)


def _reset(df: DataFrame, gone: Column, columns: list[str]) -> DataFrame:
    out = []
    for name in columns:
        if name == "role":
            out.append(F.when(gone, "unexplained").otherwise(F.col("role")).alias("role"))
        elif name in _STATE:
            out.append(F.when(~gone, F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def attach(ledger: DataFrame, children: DataFrame) -> DataFrame:
    """Make unexplained, unlocked rows satellites of a parent.

    ``children``: ``(sample_item_id, peak_id, parent_peak_id, iso_label, iso_match_score)``.
    Two labels for one row are merged, the better-scored parent wins.
    """
    per_row = children.groupBy(*PEAK).agg(
        F.max(F.struct("iso_match_score", "parent_peak_id")).alias("_b"),
        F.array_join(F.array_sort(F.collect_set("iso_label")), "+").alias("_label"),
    )
    free = (F.col("role") == "unexplained") & ~F.coalesce("locked", F.lit(False)) & F.col("_b").isNotNull()
    joined = ledger.join(per_row, PEAK, "left")
    new = {
        "role": F.lit("iso_child"),
        "parent_peak_id": F.col("_b.parent_peak_id"),
        "iso_label": F.col("_label"),
        "iso_match_score": F.col("_b.iso_match_score"),
    }
    return joined.select(
        *[F.when(free, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in ledger.columns]
    )


def fold_claims(ledger: DataFrame, claims: DataFrame, lock: bool = False) -> DataFrame:
    """Write winning claims (one per peak) into the ledger; other rows stay as they are."""
    payload = [c for c in claims.columns if c not in PEAK and c in ledger.columns]
    side = claims.select(*PEAK, *[F.col(c).alias(f"_n_{c}") for c in payload]).withColumn("_won", F.lit(True))
    won = F.coalesce("_won", F.lit(False)) & ~F.coalesce("locked", F.lit(False))
    out = []
    for c in ledger.columns:
        if c in payload:
            out.append(F.when(won, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        elif c == "locked" and lock:
            out.append((F.coalesce("locked", F.lit(False)) | won).alias("locked"))
        else:
            out.append(F.col(c))
    return ledger.join(side, PEAK, "left").select(*out)


def best_claim(claims: DataFrame, *order: Column) -> DataFrame:
    """One claim per peak: the first under ``order``, then by formula and adduct."""
    others = [c for c in claims.columns if c not in PEAK]
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)],
                    *[F.col(c).alias(c) for c in others if c in ("neutral_formula", "adduct")])
    return claims.groupBy(*PEAK).agg(F.min_by(F.struct(*others), rank).alias("row")).select(*PEAK, "row.*")


def effective_stats(ledger: DataFrame) -> DataFrame:
    """Counts and attributed signal per role, with their shares.

    Synthetic sub-peaks count for signal only; signal is height times the
    assigned fraction.
    """
    real = ~F.coalesce("synthetic", F.lit(False))
    eff = F.coalesce("height", F.lit(0.0)) * F.coalesce("assigned_fraction", F.lit(1.0))
    per = ledger.groupBy("role").agg(F.count_if(real).alias("n_peaks"), F.sum(eff).alias("signal"))
    total = per.agg(F.sum("n_peaks").alias("n_all"), F.sum("signal").alias("s_all")).withColumn("one", F.lit(1))
    return per.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").select(
        "role", "n_peaks", "signal",
        F.try_divide(F.col("n_peaks"), F.col("n_all")).alias("count_share"),
        F.try_divide(F.col("signal"), F.col("s_all")).alias("signal_share"),
    )
