"""Vector tables as integers: which rows take part, and their components in fixed point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed-point components stay below this; a vector beyond it counts as not finite.
LARGEST = float(1 << 62)


def fixed_point(df: DataFrame, scale: int, offset: int, *columns: str) -> DataFrame:
    """``columns`` of ``df`` and ``x``: floor(scale * component) + offset, as longs.

    Vectors that are null or empty or hold a null, a NaN, an infinity or a component beyond a
    long drop; so do those of another length than most vectors have (ties: the longer length).
    """

    def usable(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < LARGEST)

    v = F.col("embedding")
    sound = df.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, usable))
    common = sound.groupBy(F.size(v).alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = common["width"] if common else 0
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale) + F.lit(offset).cast("long"))
    return sound.where(F.size(v) == width).select(*columns, x.alias("x"))
