"""Connected components of an edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionloom.llm.common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``(u, root)`` for every node of ``edges (u, v)`` that is not the smallest of its component.

    Large stars hang a node's larger neighbours on its smallest one, small stars the smaller
    ones; both only need the minimum per node, so a node of any degree is pre-aggregated.
    The rounds end when the edges, by then one star per component, no longer change.
    """
    edges = written(edges.where("u <> v").select("u", "v").distinct(), "stars")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(
            F.inline(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))
                )
            )
        )
        edges = written(small.where("u <> v").distinct(), "stars")
    return edges.select("u", F.col("v").alias("root"))
