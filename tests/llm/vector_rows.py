"""Awkward vector tables: nulls, odd components, repeats, ties, other lengths, clashing columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "vec_id long, embedding array<float>, label int, x string, code string, width int, count int, component int"
NAN, INF = math.nan, math.inf


def rows(width: int = 8, n: int = 700, seed: int = 4) -> list[tuple]:
    rng = np.random.default_rng(seed)
    scale = np.linspace(2.0, 0.2, width)
    out = [(i, [float(c) for c in rng.normal(size=width) * scale], None if i % 7 == 0 else i % 3) for i in range(5, n)]
    same = out[3][1]
    out += [(9000 + i, same, 1) for i in range(300)]  # a third of all rows
    odd = [None, [], [1.0] * (width - 1), [None] + same[1:], [NAN] + same[1:], [INF] + same[1:], [1e38] + same[1:]]
    out += [(8000 + i, v, 2) for i, v in enumerate(odd)]
    return [*out, (None, same, 0), out[5], out[5], (7999, [-c for c in same], None)]


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(*r, "no", "no", 1, 2, 3) for r in rows], SCHEMA).repartition(5)


def usable(rows: list[tuple], width: int = 8) -> list[tuple]:
    ok = [r for r in rows if r[1] is not None and len(r[1]) == width and None not in r[1] and np.isfinite(r[1]).all()]
    return [(i, np.float32(v).astype(float), label) for i, v, label in ok if np.abs(np.float32(v)).max() < 1e15]
