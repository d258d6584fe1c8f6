"""Guarded statistics as column expressions (no division by zero under ANSI)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pair_r(x: Column, y: Column) -> Column:
    """Pearson r over the rows where both are present; null for a constant side."""
    both = x.isNotNull() & y.isNotNull()
    sx, sy = F.stddev_pop(F.when(both, x)), F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), F.nullif(sx * sy, F.lit(0.0)))


def slope(x: Column, y: Column) -> Column:
    """Least-squares slope of y on x over complete pairs; null without spread in x."""
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.var_pop(F.when(both, x)), F.lit(0.0)))


def cv_pop(x: Column) -> Column:
    return F.try_divide(F.stddev_pop(x), F.nullif(F.avg(x), F.lit(0.0)))
