"""Mixing sources to target weights as a time-varying curriculum.

Each source has a weight schedule over training time. Its integral, scaled to the source's
target, is the source's cumulative token demand; inverting that demand gives the training
position of each document, and documents are sorted by position over ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionloom.llm.common import WORD, in_files, running_total, with_locator, written

# Base weights, dealt to the sources in order and repeated.
WEIGHTS = (1.0, 2.0, 3.0)
# No source gives more than this many times its own size.
MOST = 3
# Weight schedules (time, relative weight), one per base weight, linear between knots.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)

Schedule = Sequence[tuple[float, float]]


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, kind, target`` from rows of ``source, size``.

    A source's share follows its weight and stops at ``most`` times its size. Sorted by the
    ratio of limit to weight, the sources that stop come first: the level at which the rest
    is shared is found in one pass. The table has one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = per_source.withColumn("kind", ((F.row_number().over(order) - 1) % len(weights)).cast("int"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("kind") + 1)
    limit = (F.col("source_size") * most).cast("double")
    rows = weighted.withColumn("weight", weight).withColumn("limit", limit)
    rising = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    after = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    levels = rows.withColumn("level", F.when(level * F.col("weight") <= F.col("limit"), level))
    level = F.first("level", ignorenulls=True).over(every)
    return levels.withColumn("target", F.least("limit", F.col("weight") * level)).select(
        "source", "source_size", "kind", "target"
    )


def position(u: Column, schedule: Schedule) -> Column:
    """The time at which the fraction ``u`` of a source's demand has been met.

    The demand is the integral of a piecewise linear weight; within a segment its inverse is
    the root of a quadratic.
    """
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False)]
    total, met, out = sum(areas), 0.0, None
    for (start, end), area in zip(zip(schedule, schedule[1:], strict=False), areas, strict=True):
        slope = (end[1] - start[1]) / (end[0] - start[0])
        rest = F.greatest(u * total - met, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(start[1] ** 2) + 2 * slope * rest, F.lit(0.0)))
        at = F.when(rest <= 0, F.lit(start[0])).otherwise(start[0] + 2 * rest / (start[1] + root))
        met += area
        out = F.when(u * total < met, at) if out is None else out.when(u * total < met, at)
    return out.otherwise(F.lit(schedule[-1][0]))


def curriculum(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    most: int = MOST,
    schedules: Sequence[Schedule] = SCHEDULES,
) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken, copies, position``.

    ``size`` counts words; a source's documents follow each other in a fixed hash order, and
    the mix reads that order from its start until the source's target is met, over and over:
    ``taken`` words of the document, of which the last reading may take a part. ``copies`` is
    ``taken`` in whole documents (the one document per source that is cut is rounded).
    ``position`` in [0, 1] is when the document is first due, null if it is not taken.

    Null text has size 0 and is never taken; a null source is a source of its own; rows that
    repeat an id are separate documents; a table without words has targets of 0; extra
    columns are ignored. The row's locator (``_ion_file``, ``_ion_row``) comes along.
    """
    docs = in_files(docs)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = written(
        docs.select(
            "doc_id",
            "source",
            size.alias("size"),
            F.col("_metadata.file_path").alias("_ion_file"),
            F.col("_metadata.row_index").alias("_ion_row"),
        ),
        "mix-sizes",
    )
    shares = written(targets(rows, weights, most), "mix-targets")
    # A null source would not meet itself in a join; the rows of a source are told by a key.
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")).alias("key")
    offsets = running_total(
        rows.select("doc_id", "size", "_ion_file", "_ion_row", key),
        ["key"],
        F.col("size"),
        ["doc_id", "size", "_ion_file", "_ion_row"],
        "start",
        hashed=["doc_id", "size"],
    )
    placed = offsets.join(shares.select(key, "source_size", "kind", "target"), "key")
    quota = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(F.lit(0))
    part = F.least(F.col("size"), F.greatest(F.lit(0), quota - whole * F.col("source_size") - F.col("start")))
    placed = placed.withColumn("quota", quota).withColumn("taken", whole * F.col("size") + part)
    placed = placed.withColumn("taken", F.least(F.col("taken"), most * F.col("size")).cast("long"))
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    placed = placed.withColumn("copies", copies)
    return placed.withColumn("position", F.when(F.col("taken") > 0, _due(schedules, F.col("start"))))


def _due(schedules: Sequence[Schedule], offset: Column) -> Column:
    u = offset / F.col("quota")
    out = F.when(F.col("kind") == 0, position(u, schedules[0]))
    for kind, schedule in enumerate(schedules[1:], 1):
        out = out.when(F.col("kind") == kind, position(u, schedule))
    return out


def mixed(docs: DataFrame, schedules: Sequence[Schedule] = SCHEDULES) -> DataFrame:
    """The training order: the columns of ``docs``, a row per copy, sorted by position."""
    docs = in_files(docs)
    plan = curriculum(docs, schedules=schedules).where("copies > 0")
    due = plan.withColumn("_ion_pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select(
        "_ion_file", "_ion_row", _due(schedules, F.col("start") + F.col("_ion_pass") * F.col("source_size")).alias("_ion_due"), "_ion_pass"
    )
    rows = with_locator(docs).join(due, ["_ion_file", "_ion_row"])
    return rows.orderBy("_ion_due", "_ion_file", "_ion_row", "_ion_pass").select(docs.columns)
