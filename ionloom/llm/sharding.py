"""Sharding by balanced label propagation.

Documents with equal texts are linked. Labels (shards) are kept per cell, i.e. per group of
linked documents and shard, with the number of its documents: documents of one cell are
interchangeable, so a group of any size is at most as many rows as there are shards. Each
round, cells move towards the shard where most of their group is, as far as the shard's
quota allows. Documents without links then fill the shards up to exactly equal counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.llm.common import running_total, written

SHARDS = 40


def _quotas(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def _pick(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), index.cast("int") + 1)


def propagate(cells: DataFrame, quotas: list[int]) -> DataFrame:
    """``grp, shard, n`` after the moves; no shard holds more linked rows than its quota.

    A cell proposes to join the fullest larger cell of its group whose shard has room. A move
    never splits the larger cell, so the sum of squared cell sizes only grows and the rounds
    end by themselves. A group that fills most of a shard leaves an eighth of it to others.
    """
    slack = max(quotas) // 8
    while True:
        loads = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [q - loads.get(s, 0) for s, q in enumerate(quotas)]
        # Larger first; equal cells are ordered by a hash, so that no shard is favoured.
        weight = F.struct(F.col("n"), F.xxhash64("grp", "shard").alias("h"))
        group = Window.partitionBy("grp")
        left = F.when(F.sum("n").over(group) > 4 * slack, slack).otherwise(0)
        open_to = F.when(_pick(room, F.col("shard")) > F.col("left"), F.struct(weight.alias("w"), F.col("shard").alias("to")))
        wish = cells.withColumn("left", left).withColumn("w", weight).withColumn("best", F.max(open_to).over(group))
        moves = wish.where((F.col("best.w") > F.col("w")) & (F.col("shard") != F.col("best.to"))).select(
            "grp", "shard", "n", F.col("best.to").alias("to"), "left"
        )
        ranked = running_total(moves, ["to"], F.col("n"), ["grp", "shard"], "ahead")
        fits = F.greatest(F.lit(0), F.least(F.col("n"), _pick(room, F.col("to")) - F.col("left") - F.col("ahead")))
        accepted = written(ranked.withColumn("m", fits).where("m > 0").select("grp", "shard", "to", "m"), "shard-moves")
        if accepted.isEmpty():
            return cells
        parts = cells.unionByName(accepted.select("grp", F.col("to").alias("shard"), F.col("m").alias("n"))).unionByName(
            accepted.select("grp", "shard", (-F.col("m")).alias("n"))
        )
        cells = written(parts.groupBy("grp", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "shard-cells")


def over_quota(cells: DataFrame, quotas: list[int]) -> DataFrame:
    """Cells cut down to the quota of their shard; what is cut is returned with a null shard."""
    ranked = running_total(cells, ["shard"], F.col("n"), ["grp"], "ahead")
    fits = F.greatest(F.lit(0), F.least(F.col("n"), _pick(quotas, F.col("shard")) - F.col("ahead")))
    parts = F.array(
        F.struct(F.col("shard"), fits.alias("n")), F.struct(F.lit(None).cast("int").alias("shard"), (F.col("n") - fits).alias("n"))
    )
    return ranked.select("grp", F.inline(parts)).where("n > 0")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the text's UTF-8 bytes plus 16. The law is ``rows``: counts differ by one at
    most. Null texts count as empty and are linked to empty ones; rows that repeat an id are
    separate documents; an empty table gives no rows; extra columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    raw = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("grp"),
        F.monotonically_increasing_id().alias("uid"),
    )
    # Written once: the row numbers hold from here on.
    rows = written(raw, "shard-rows")
    quotas = _quotas(rows.count(), shards)
    # Tables that meet hot groups in a join are written first, so that the join can be split.
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    sizes = written(sizes, "shard-sizes")
    linked = written(
        rows.join(sizes, "grp").select("grp", "uid", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int").alias("shard")),
        "shard-linked",
    )
    start = written(linked.groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n")), "shard-start")
    start = written(over_quota(start, quotas).groupBy("grp", "shard").agg(F.sum("n").alias("n")), "shard-start")
    held = propagate(start.where("shard is not null"), quotas)
    cells = held.unionByName(start.where("shard is null"))

    # Documents of a group are dealt to its cells in a fixed order; the cut rest joins the unlinked.
    upto = F.sum("n").over(
        Window.partitionBy("grp").orderBy(F.col("shard").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    )
    ends = cells.withColumn("end", upto).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends"))
    ends = written(ends, "shard-ends")
    ranks = running_total(linked.select("grp", "uid"), ["grp"], F.lit(1), ["uid"], "rank")
    dealt = ranks.join(ends, "grp").select(
        "uid", F.filter("ends", lambda e: e["end"] > F.col("rank"))[0]["shard"].alias("label")
    )
    labelled = written(
        rows.select("uid", "doc_id", "size", "text_crc32").join(dealt, "uid", "left"), "shard-labels"
    )
    loads = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    fill = F.array(*[F.lit(sum(quotas[: s + 1]) - sum(loads.get(i, 0) for i in range(s + 1))).cast("long") for s in range(shards)])
    free = running_total(labelled.where("label is null").withColumn("one", F.lit(0)), ["one"], F.lit(1), ["uid"], "rank")
    # The shard of a free document is the number of shards that are full before its rank.
    filled = free.withColumn("label", F.size(F.filter(fill, lambda end: end <= F.col("rank"))).cast("int"))
    every = labelled.where("label is not null").unionByName(filled.select(labelled.columns))
    out = running_total(every, ["label"], F.lit(1), ["uid"], "slot")
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("label").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
