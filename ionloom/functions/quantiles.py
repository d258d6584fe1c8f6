"""Exact order statistics that never gather an unbounded group in one task's memory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ionloom.session import stored

# Width, in rank share, of the bracket put round a wanted quantile of a larger group.
HALF_BRACKET = 0.002

# Selection over (keys, v, n) counts.
_STATEMENT = """
WITH marks AS (
  SELECT *, (total - 1) * share AS pos FROM (
    SELECT {keys}, sum(n) AS total, percentile_approx(v, array({brackets}), 2000) AS edges
    FROM {{counts}} GROUP BY {keys}
  ) LATERAL VIEW posexplode(array({shares})) AS i, share
),
sided AS (
  SELECT {ckeys}, m.i, m.pos, m.total, c.v, c.n,
         CASE WHEN c.v < m.edges[2 * m.i] THEN 0 WHEN c.v <= m.edges[2 * m.i + 1] THEN 1 ELSE 2 END AS side
  FROM {{counts}} c JOIN marks m ON {c_is_m}
),
sizes AS (
  SELECT {keys}, i, first(pos) AS pos, floor(first(pos)) AS lo,
         least(floor(first(pos)) + 1, first(total) - 1) AS hi,
         sum(IF(side = 0, n, 0)) AS end0, sum(IF(side <= 1, n, 0)) AS end1
  FROM sided GROUP BY {keys}, i
),
ordered AS (
  SELECT {ckeys}, c.i, s.pos, s.lo, s.hi, c.v,
         CASE c.side WHEN 0 THEN 0 WHEN 1 THEN s.end0 ELSE s.end1 END
           + sum(c.n) OVER (PARTITION BY {ckeys}, c.i, c.side ORDER BY c.v) AS upto
  FROM sided c JOIN sizes s ON {c_is_s} AND c.i = s.i
  WHERE c.side IN (
    CASE WHEN s.lo < s.end0 THEN 0 WHEN s.lo < s.end1 THEN 1 ELSE 2 END,
    CASE WHEN s.hi < s.end0 THEN 0 WHEN s.hi < s.end1 THEN 1 ELSE 2 END)
),
ends AS (
  SELECT {keys}, i, first(pos) - first(lo) AS f,
         min(IF(upto > lo, v, NULL)) AS vl, min(IF(upto > hi, v, NULL)) AS vh
  FROM ordered GROUP BY {keys}, i
)
SELECT {keys}, {outputs} FROM ends GROUP BY {keys}
"""


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str | Column, wanted: dict[str, float]
) -> DataFrame:
    """Linear-interpolated quantiles per group: ``(*keys, *wanted)``. NaN counts as missing.

    Values are counted, which spreads a hot group over its values; a sketch
    brackets the quantile, exact counts say which side of the bracket the wanted
    ranks fall on, and only the values of that side are ordered. The result is
    exact whatever the sketch says. The counts are written first: a value that is
    a sum differs in its last bits each time it is computed, and would else fall
    on one side of its bracket in one step and on the other in the next.
    """
    val = F.col(value) if isinstance(value, str) else value
    names, shares = list(wanted), [float(p) for p in wanted.values()]
    rows = df.select(
        *keys,
        *([] if keys else [F.lit(1).alias("_all")]),
        F.nanvl(val.cast("double"), F.lit(None).cast("double")).alias("v"),
    ).where(F.col("v").isNotNull())
    by = list(keys) or ["_all"]
    counts, _ = stored(rows.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n")), "quantile-counts")
    quoted = [f"`{k}`" for k in by]

    def same(a: str, b: str) -> str:
        return " AND ".join(f"{a}.{k} <=> {b}.{k}" for k in quoted)

    edges = [e for p in shares for e in (max(0.0, p - HALF_BRACKET), min(1.0, p + HALF_BRACKET))]
    statement = _STATEMENT.format(
        keys=", ".join(quoted),
        ckeys=", ".join(f"c.{k}" for k in quoted),
        shares=", ".join(f"{p!r}D" for p in shares),
        brackets=", ".join(f"{e!r}D" for e in edges),
        c_is_m=same("c", "m"),
        c_is_s=same("c", "s"),
        outputs=", ".join(
            f"max(IF(i = {i}, vl + (vh - vl) * f, NULL)) AS `{name}`" for i, name in enumerate(names)
        ),
    )
    return df.sparkSession.sql(statement, counts=counts).select(*keys, *names)


def exact_median(df: DataFrame, keys: Sequence[str], value: str | Column, out: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, {out: 0.5})
