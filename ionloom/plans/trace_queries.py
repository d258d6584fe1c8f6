"""Queries over time-series measures and families of channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionloom.operators import families as fam
from ionloom.operators import traces as tr
from ionloom.plans import adapters as ad
from ionloom.plans.registry import query
from ionloom.session import cut_lineage


def grid(spark, sf, bucket_s: int = 21600, channels: int = 30):
    """Channels over the whole time axis: ``(channel, t, hours, y)``."""
    rows = tr.with_axis(ad.trace_cells(spark, sf, bucket_s, channels), "tb", bucket_s / 3600.0)
    return cut_lineage(tr.complete_grid(rows))


def grid_sql(bucket_s: int = 21600, channels: int = 30) -> str:
    return f"""{ad.traces_sql(bucket_s, channels)},
axis AS (SELECT tb, CAST(row_number() OVER (ORDER BY tb) - 1 AS BIGINT) AS t,
                (tb - min(tb) OVER ()) * {bucket_s / 3600.0}::DOUBLE AS hours FROM (SELECT DISTINCT tb FROM traces)),
grid AS (SELECT c.channel, a.t, a.hours, x.y FROM (SELECT DISTINCT channel FROM traces) c CROSS JOIN axis a
         LEFT JOIN traces x ON x.channel = c.channel AND x.tb = a.tb)"""


GRID = grid_sql()


def smooth_sql(w: int, src: str = "grid", key: str = "channel", y: str = "y", out: str = "sm") -> str:
    left, right = w // 2, (w - 1) // 2
    return f"""{out}_f AS (SELECT *, coalesce({y}, median({y}) OVER (PARTITION BY {key})) AS f,
   count(*) OVER (PARTITION BY {key}) AS n FROM {src}),
{out} AS (SELECT *, CASE WHEN n >= {w} THEN sum(f) OVER (PARTITION BY {key} ORDER BY t ROWS BETWEEN {left} PRECEDING AND {right} FOLLOWING) / {w}.0
   ELSE f END AS s FROM {out}_f)"""


@query("W7_smoothed", f"WITH {GRID}, {smooth_sql(5)} SELECT channel, t, round(s, 6) AS s FROM sm")
def w7(spark, sf):
    return tr.smoothed(grid(spark, sf), 5).select("channel", "t", F.round("s", 6).alias("s"))


@query("W8_longest_run", f"""WITH {grid_sql(10800)},
r AS (SELECT channel, t - row_number() OVER (PARTITION BY channel ORDER BY t) AS g FROM grid WHERE y > 0),
b AS (SELECT channel, max(n) AS run FROM (SELECT channel, g, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1)
SELECT c.channel, coalesce(b.run, 0) AS run FROM (SELECT DISTINCT channel FROM grid) c LEFT JOIN b USING (channel)""")
def w8(spark, sf):
    return tr.longest_run(grid(spark, sf, 10800))


@query("W9_shape", f"""WITH {GRID}, z AS (SELECT channel, t, log10(y) AS g FROM grid WHERE y > 0),
m AS (SELECT channel, avg(g) FILTER (t < 6) AS st,
      avg(g) FILTER (t > (SELECT max(t) FROM grid) - 6) AS en FROM z GROUP BY 1)
SELECT channel, round(st, 8) AS "start", round(en, 8) AS "end",
       CASE WHEN en - st > 0.5 THEN 'rise' WHEN st - en > 0.5 THEN 'fall' ELSE 'peak' END AS shape FROM m""")
def w9(spark, sf):
    z = grid(spark, sf).withColumn("g", F.log10(tr.positive(F.col("y"))))
    e = tr.ends(z, "g")
    return e.select("channel", F.round("start", 8).alias("start"), F.round("end", 8).alias("end"), "shape")


@query("W10_starts_high", f"""WITH {GRID}, {smooth_sql(3)},
m AS (SELECT channel, avg(s) FILTER (t < greatest(1, n // 20)) AS h, max(CASE WHEN s > 0 THEN s END) AS top,
      count(*) FILTER (s > 0) AS p FROM sm GROUP BY 1)
SELECT channel, round(CASE WHEN p >= 8 THEN coalesce(h / top, 0) ELSE 0 END, 8) AS starts_high FROM m""")
def w10(spark, sf):
    return tr.starts_high(grid(spark, sf)).withColumn("starts_high", F.round("starts_high", 8))


@query("W11_settle_trim", f"""WITH {GRID}, k AS (SELECT CAST(floor((max(t) + 1) * 0.18) AS BIGINT) AS k FROM grid)
SELECT channel, t - k AS t, round(y, 6) AS y FROM grid, k WHERE t >= k""")
def w11(spark, sf):
    return tr.settle_trim(grid(spark, sf)).select("channel", "t", F.round("y", 6).alias("y"))


@query("W12_big_changers", f"""WITH {GRID}, {smooth_sql(2)},
m AS (SELECT channel, max(s) AS top, quantile_cont(CASE WHEN s > 0 THEN s END, 0.1) AS base, count(*) FILTER (s > 0) AS p,
      arg_min(hours, (-s, t)) AS ph, median(y) AS med FROM sm GROUP BY 1)
SELECT channel, round(top / base, 7) AS fold, ph AS peak_hour FROM m
WHERE p >= 8 AND top / base >= CASE WHEN med >= 1000 THEN 2.0 ELSE 3.0 END""")
def w12(spark, sf):
    return tr.big_changers(grid(spark, sf)).withColumn("fold", F.round("fold", 7))


@query("T1_trace_cv", f"""WITH {GRID}
SELECT channel, round(coalesce(stddev_pop(y) FILTER (y > 0) / avg(y) FILTER (y > 0), 0), 8) AS cv FROM grid GROUP BY 1""")
def t1(spark, sf):
    return tr.trace_cv(grid(spark, sf)).withColumn("cv", F.round("cv", 8))


@query("T2_smoothed_range", f"""WITH {GRID}, {smooth_sql(3)}
SELECT channel, round(coalesce(max(s) FILTER (s > 0) / median(s) FILTER (s > 0), 0), 7) AS "range" FROM sm GROUP BY 1""")
def t2(spark, sf):
    return tr.smoothed_range(grid(spark, sf)).withColumn("range", F.round("range", 7))


def eta_sql(src: str = "grid", key: str = "channel", y: str = "y", out: str = "eta") -> str:
    return f"""{out}_r AS (SELECT {key}, log10({y}) AS g, hours, CAST(floor((hours % 24.0) / 3.0) AS BIGINT) AS hb FROM {src} WHERE {y} > 0),
{out}_b AS (SELECT {key}, hb, count(*) AS n, avg(g) AS m FROM {out}_r GROUP BY 1, 2),
{out}_t AS (SELECT {key}, avg(g) AS grand, var_pop(g) * count(*) AS sst, count(*) AS n_all, max(hours) - min(hours) AS span FROM {out}_r GROUP BY 1),
{out} AS (SELECT t.{key}, CASE WHEN max(n_all) >= 24 AND max(span) >= 40 AND max(sst) > 0
          THEN sum(b.n * (b.m - t.grand) ** 2) / max(sst) ELSE 0 END AS eta2
          FROM {out}_t t JOIN {out}_b b USING ({key}) GROUP BY 1)"""


@query("T3_diurnal_eta2", f"WITH {GRID}, {eta_sql()} SELECT channel, round(eta2, 8) AS eta2 FROM eta")
def t3(spark, sf):
    return tr.diurnal_eta2(grid(spark, sf)).withColumn("eta2", F.round("eta2", 8))


@query("T5_varies", f"""WITH {GRID}, {smooth_sql(3)}, {eta_sql()},
r AS (SELECT channel, coalesce(max(s) FILTER (s > 0) / median(s) FILTER (s > 0), 0) AS rg FROM sm GROUP BY 1),
c AS (SELECT channel, coalesce(stddev_pop(y) FILTER (y > 0) / avg(y) FILTER (y > 0), 0) AS cv FROM grid GROUP BY 1)
SELECT channel, round(cv, 8) AS cv, round(rg, 7) AS "range", round(eta2, 8) AS eta2,
       cv >= 0.3 OR rg >= 1.7 OR (eta2 >= 0.3 AND rg >= 1.15) AS varies
FROM c JOIN r USING (channel) JOIN eta USING (channel)""")
def t5(spark, sf):
    v = tr.varies(grid(spark, sf))
    return v.select(
        "channel", F.round("cv", 8).alias("cv"), F.round("range", 7).alias("range"), F.round("eta2", 8).alias("eta2"), "varies"
    )


# Families of these queries: the channels by residue, so that SQL has the same labels.
FAMILIES = "fams AS (SELECT DISTINCT channel, channel % 5 AS cluster FROM grid)"
FMEAN = "fmean AS (SELECT cluster, t, hours, avg(y) FILTER (y > 0) AS y FROM grid JOIN fams USING (channel) GROUP BY 1, 2, 3)"


def labels(g):
    return g.select("channel", (F.col("channel") % 5).alias("cluster")).distinct()


@query("T4_family_eta2", f"WITH {GRID}, {FAMILIES}, {FMEAN}, {eta_sql('fmean', 'cluster')} SELECT cluster, round(eta2, 8) AS eta2 FROM eta")
def t4(spark, sf):
    g = grid(spark, sf)
    return tr.diurnal_eta2(tr.family_mean(g, labels(g)), "cluster").withColumn("eta2", F.round("eta2", 8))


@query("T6_log_traces", f"WITH {GRID} SELECT channel, t, round(log10(CASE WHEN y > 0 THEN y END), 9) AS g FROM grid")
def t6(spark, sf):
    return tr.log_traces(grid(spark, sf)).select("channel", "t", F.round("g", 9).alias("g"))


ANOMALY = """lg AS (SELECT channel, t, hours, log10(CASE WHEN y > 0 THEN y END) AS g FROM grid),
an AS (SELECT channel, t, hours, g - avg(g) OVER (PARTITION BY channel, CAST(floor(hours % 24.0) AS INT)) AS a FROM lg)"""
MODE = "cm AS (SELECT t, median(a) AS cm FROM an GROUP BY 1)"
RESID = """j AS (SELECT an.*, cm.cm FROM an LEFT JOIN cm USING (t)),
fit AS (SELECT channel, count(*) FILTER (a IS NOT NULL AND cm IS NOT NULL) AS n, covar_pop(cm, a) AS cxy,
   var_pop(cm) FILTER (a IS NOT NULL) AS vx, var_pop(a) FILTER (cm IS NOT NULL) AS vy,
   avg(cm) FILTER (a IS NOT NULL) AS mx, avg(a) FILTER (cm IS NOT NULL) AS my, avg(a) AS ma FROM j GROUP BY 1),
res AS (SELECT j.channel, j.t, CASE WHEN n >= 8 AND vx > 0 THEN a - (my + cxy / vx * (cm - mx)) ELSE a - ma END AS r FROM j JOIN fit USING (channel)),
r2 AS (SELECT channel, CASE WHEN n >= 8 AND vx > 0 AND vy > 0 THEN cxy * cxy / (vx * vy) ELSE 0 END AS r2 FROM fit)"""


@query("T7_diel_anomaly", f"WITH {GRID}, {ANOMALY} SELECT channel, t, round(a, 9) AS a FROM an")
def t7(spark, sf):
    return tr.diel_anomaly(tr.log_traces(grid(spark, sf))).select("channel", "t", F.round("a", 9).alias("a"))


@query("T8_common_mode", f"WITH {GRID}, {ANOMALY}, {MODE} SELECT t, round(cm, 9) AS cm FROM cm WHERE cm IS NOT NULL")
def t8(spark, sf):
    return tr.common_mode(tr.diel_anomaly(tr.log_traces(grid(spark, sf)))).withColumn("cm", F.round("cm", 9))


@query("T9_T10_residuals", f"WITH {GRID}, {ANOMALY}, {MODE}, {RESID} SELECT channel, t, round(r, 8) AS r FROM res")
def t9(spark, sf):
    resid, _, _ = tr.decompose(grid(spark, sf))
    return resid.select("channel", "t", F.round("r", 8).alias("r"))


@query("T9_common_mode_r2", f"WITH {GRID}, {ANOMALY}, {MODE}, {RESID} SELECT channel, round(r2, 8) AS r2 FROM r2")
def t9b(spark, sf):
    _, r2, _ = tr.decompose(grid(spark, sf))
    return r2.withColumn("r2", F.round("r2", 8))


PAIRS = """pr AS (SELECT p.channel AS a, q.channel AS b, corr(log10(p.y), log10(q.y)) AS r, count(*) AS n
  FROM grid p JOIN grid q ON p.t = q.t AND p.channel < q.channel WHERE p.y > 0 AND q.y > 0 GROUP BY 1, 2 HAVING count(*) >= 8)"""


@query("T11_pairwise_r", f"WITH {GRID}, {PAIRS} SELECT a, b, round(r, 8) AS r, n FROM pr")
def t11(spark, sf):
    p = tr.pairwise_r(tr.log_traces(grid(spark, sf)), "g")
    return p.withColumn("r", F.round("r", 8))


@query("T12_reference_r", f"""WITH {GRID}, lg AS (SELECT channel, t, log10(CASE WHEN y > 0 THEN y END) AS g FROM grid),
fam AS (SELECT t, avg(z) AS ref FROM (SELECT t, (g - avg(g) OVER (PARTITION BY channel)) / stddev_samp(g) OVER (PARTITION BY channel) AS z
        FROM lg WHERE channel < 4) GROUP BY 1)
SELECT channel, round(corr(g, ref), 8) AS r FROM lg JOIN fam USING (t) GROUP BY 1""")
def t12(spark, sf):
    g = tr.log_traces(grid(spark, sf))
    return tr.reference_r(g, "g", g.where("channel < 4").select("channel").distinct()).withColumn("r", F.round("r", 8))


@query("T17_cohesion", f"""WITH {GRID}, {FAMILIES}, {PAIRS}
SELECT f.cluster, round(avg(r), 8) AS mean_r, coalesce(avg(r) < 0.5, false) AS flagged FROM pr
JOIN fams f ON f.channel = a JOIN fams h ON h.channel = b AND h.cluster = f.cluster GROUP BY 1""")
def t17(spark, sf):
    g = grid(spark, sf)
    return fam.cohesion(labels(g), tr.pairwise_r(tr.log_traces(g), "g")).withColumn("mean_r", F.round("mean_r", 8))


@query("T16_family_rows", f"""WITH {GRID}, {FAMILIES}, {PAIRS},
lz AS (SELECT channel, t, hours, (log10(greatest(y, 1e-9)) - avg(log10(greatest(y, 1e-9))) OVER (PARTITION BY channel))
        / stddev_samp(log10(greatest(y, 1e-9))) OVER (PARTITION BY channel) AS z FROM grid WHERE y IS NOT NULL),
fm AS (SELECT g.cluster, a.t, a.hours, z.y FROM (SELECT DISTINCT cluster FROM fams) g CROSS JOIN axis a
       LEFT JOIN (SELECT cluster, t, avg(z) AS y FROM lz JOIN fams USING (channel) GROUP BY 1, 2) z ON z.cluster = g.cluster AND z.t = a.t),
{smooth_sql(5, "fm", "cluster")},
e AS (SELECT cluster, avg(s) FILTER (t < 6) AS st, avg(s) FILTER (t > (SELECT max(t) FROM grid) - 6) AS en, arg_min(hours, (-s, t)) AS ph FROM sm GROUP BY 1),
co AS (SELECT f.cluster, avg(r) AS mean_r FROM pr JOIN fams f ON f.channel = a JOIN fams h ON h.channel = b AND h.cluster = f.cluster GROUP BY 1)
SELECT cluster, count(*) AS n, round(any_value(mean_r), 8) AS mean_r,
  any_value(CASE WHEN en - st > 0.5 THEN 'rise' WHEN st - en > 0.5 THEN 'fall' ELSE 'peak' END) AS shape, any_value(ph) AS peak_hour
FROM fams JOIN co USING (cluster) JOIN e USING (cluster) GROUP BY 1""")
def t16(spark, sf):
    g = grid(spark, sf)
    out = fam.family_rows(g, labels(g), tr.pairwise_r(tr.log_traces(g), "g"))
    return out.withColumn("mean_r", F.round("mean_r", 8))


@query("T16_members", f"""WITH {GRID}, {FAMILIES}, m AS (SELECT channel, median(y) AS med FROM grid GROUP BY 1)
SELECT channel, cluster, round(med, 6) AS median, row_number() OVER (PARTITION BY cluster ORDER BY med DESC, channel) AS place FROM fams JOIN m USING (channel)""")
def t16m(spark, sf):
    g = grid(spark, sf)
    return fam.members_by_brightness(g, labels(g)).select("channel", "cluster", F.round("median", 6).alias("median"), "place")


@query("T18_split_flat", f"""WITH {GRID}, {FAMILIES}, {FMEAN}, {smooth_sql(3, "fmean", "cluster", out="s1")},
trim AS (SELECT cluster, t, y FROM fmean WHERE t >= (SELECT CAST(floor((max(t) + 1) * 0.18) AS BIGINT) FROM grid)),
{smooth_sql(3, "trim", "cluster", out="s2")}, {eta_sql("fmean", "cluster")},
a AS (SELECT cluster, max(s) FILTER (s > 0) / median(s) FILTER (s > 0) AS "full",
       avg(s) FILTER (t < greatest(1, n // 20)) / max(s) AS sh FROM s1 GROUP BY 1),
b AS (SELECT cluster, max(s) FILTER (s > 0) / median(s) FILTER (s > 0) AS settled FROM s2 GROUP BY 1)
SELECT cluster, round("full", 7) AS "full", round(settled, 7) AS settled, round(sh, 7) AS starts_high, round(eta2, 8) AS eta2,
  CASE WHEN "full" < 1.4 THEN eta2 >= 0.3 AND "full" >= 1.15
       ELSE NOT (settled < 1.4 AND sh >= CASE WHEN eta2 < 0.3 THEN 0.5 ELSE 0.8 END) END AS dynamic
FROM a JOIN b USING (cluster) JOIN eta USING (cluster)""")
def t18(spark, sf):
    g = grid(spark, sf)
    out = fam.split_flat(g, labels(g))
    return out.select("cluster", *[F.round(c, 7).alias(c) for c in ("full", "settled", "starts_high")],
                      F.round("eta2", 8).alias("eta2"), "dynamic")


@query("T19_panel_median", f"""WITH {GRID}, {FAMILIES}, r AS (SELECT * FROM grid JOIN fams USING (channel)),
f AS (SELECT cluster, min(y) FILTER (y > 0) AS fl FROM r GROUP BY 1)
SELECT cluster, t, round(median(coalesce(y, fl, 1.0)), 6) AS panel FROM r JOIN f USING (cluster) GROUP BY 1, 2""")
def t19(spark, sf):
    g = grid(spark, sf)
    return tr.panel_median(g, labels(g)).withColumn("panel", F.round("panel", 6))


@query("T20_family_gain", f"""WITH {GRID}, {FAMILIES}, lg AS (SELECT channel, cluster, t, log10(CASE WHEN y > 0 THEN y END) AS g FROM grid JOIN fams USING (channel)),
f AS (SELECT cluster, t, avg(g) AS fam FROM lg GROUP BY 1, 2)
SELECT cluster, channel, round(regr_slope(g, fam), 8) AS gain FROM lg JOIN f USING (cluster, t) GROUP BY 1, 2 HAVING count(g) >= 8""")
def t20(spark, sf):
    g = grid(spark, sf)
    return tr.family_gain(g, labels(g)).withColumn("gain", F.round("gain", 8))


@query("A18_dynamics", f"""WITH {GRID}
SELECT channel, round(median(y), 6) AS median_cps, round(stddev_pop(y) / avg(y), 8) AS cv, stddev_pop(y) / avg(y) >= 0.3 AS changing FROM grid GROUP BY 1""")
def a18(spark, sf):
    d = tr.dynamics(grid(spark, sf))
    return d.select("channel", F.round("median_cps", 6).alias("median_cps"), F.round("cv", 8).alias("cv"), "changing")


@query("A17_channel_agreement", f"""WITH {GRID},
ch AS (SELECT DISTINCT channel, 'F' || (channel % 10) AS nf, 'a' || (channel // 10) AS ad FROM grid),
ok AS (SELECT c.*, g.med, row_number() OVER (PARTITION BY nf ORDER BY med DESC, channel) AS place FROM ch c JOIN
       (SELECT channel, median(y) AS med, count(y) AS n FROM grid GROUP BY 1) g USING (channel) WHERE n >= 8 AND med >= 15),
p AS (SELECT x.nf, x.place AS pa, z.place AS pb, corr(log10(gx.y), log10(gz.y)) AS r FROM ok x JOIN ok z ON x.nf = z.nf AND x.place < z.place
      JOIN grid gx ON gx.channel = x.channel JOIN grid gz ON gz.channel = z.channel AND gz.t = gx.t WHERE gx.y > 0 AND gz.y > 0
      GROUP BY 1, 2, 3 HAVING count(*) >= 8),
s AS (SELECT nf, min(r) AS worst, max(r) FILTER (pa = 1 AND pb = 2) AS top2 FROM p GROUP BY 1),
l AS (SELECT nf, count(*) AS n, string_agg(ad || '~' || CAST(round_even(med, 0) AS BIGINT), ', ' ORDER BY place) AS chs FROM ok GROUP BY 1)
SELECT nf AS neutral_formula, n AS n_channels, round_even(worst, 3) AS worst_r, round_even(top2, 3) AS top2_r, chs AS channels,
  CASE WHEN worst >= 0.7 THEN 'agree' WHEN worst >= 0.4 THEN 'marginal' ELSE 'disagree' END AS verdict FROM s JOIN l USING (nf) WHERE n >= 2""")
def a17(spark, sf):
    g = grid(spark, sf)
    ch = g.select("channel").distinct().select(
        "channel",
        F.concat(F.lit("F"), (F.col("channel") % 10).cast("string")).alias("neutral_formula"),
        F.concat(F.lit("a"), F.floor(F.col("channel") / 10).cast("string")).alias("adduct"),
    )
    return fam.channel_agreement(g, ch, floor=15.0)


@query("T25_hour_profiles", f"""WITH {grid_sql(10800, 10)},
lg AS (SELECT channel, CAST(floor((hours + 1.5) % 24.0) AS BIGINT) AS h, log10(y) AS g FROM grid WHERE y > 0),
k AS (SELECT channel FROM lg GROUP BY 1 HAVING count(*) >= 80),
m AS (SELECT channel, h, median(g) AS m FROM lg JOIN k USING (channel) GROUP BY 1, 2),
f AS (SELECT k.channel, hh.h, m.m FROM k CROSS JOIN (SELECT unnest(range(24)) AS h) hh LEFT JOIN m ON m.channel = k.channel AND m.h = hh.h),
n AS (SELECT f.*, (SELECT max(h) FROM m x WHERE x.channel = f.channel AND x.h <= f.h) AS h0,
                  (SELECT min(h) FROM m x WHERE x.channel = f.channel AND x.h >= f.h) AS h1 FROM f),
v AS (SELECT n.channel, n.h, CASE WHEN h0 IS NULL THEN b.m WHEN h1 IS NULL THEN a.m WHEN h0 = h1 THEN a.m
        ELSE a.m + (b.m - a.m) * (n.h - h0) / (h1 - h0) END AS lv
      FROM n LEFT JOIN m a ON a.channel = n.channel AND a.h = n.h0 LEFT JOIN m b ON b.channel = n.channel AND b.h = n.h1)
SELECT channel, h, round(10 ** lv / avg(10 ** lv) OVER (PARTITION BY channel), 7) AS p FROM v""")
def t25(spark, sf):
    return tr.hour_profiles(grid(spark, sf, 10800, 10), start_hour=1.5).withColumn("p", F.round("p", 7))


@query("T26_peak_hours", f"""WITH {grid_sql(3600, 5)},
lg AS (SELECT channel, CAST(floor(hours % 24.0) AS BIGINT) AS h, log10(y) AS g FROM grid WHERE y > 0),
m AS (SELECT channel, h, 10 ** median(g) AS lin FROM lg GROUP BY 1, 2),
p AS (SELECT channel, h, lin / avg(lin) OVER (PARTITION BY channel) AS p FROM m),
w AS (SELECT channel, h, p - min(p) OVER (PARTITION BY channel) AS w FROM p),
s AS (SELECT channel, atan2(sum(w * sin(h * 2 * pi() / 24)), sum(w * cos(h * 2 * pi() / 24))) AS a FROM w GROUP BY 1)
SELECT channel, round((CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END) * 24 / (2 * pi()), 6) AS peak_hour FROM s""")
def t26(spark, sf):
    prof = tr.hour_profiles(grid(spark, sf, 3600, 5))
    return tr.peak_hours(prof).withColumn("peak_hour", F.round("peak_hour", 6))


@query("T13_complete_linkage")
def t13(spark, sf):
    g = tr.log_traces(grid(spark, sf, 86400, 30))
    pairs = tr.pairwise_r(g, "g")
    return fam.complete_linkage(g.select("channel").distinct(), pairs, cut=0.9)


@query("T14_merge_similar")
def t14(spark, sf):
    g = tr.log_traces(grid(spark, sf, 86400, 30))
    lab = fam.complete_linkage(g.select("channel").distinct(), tr.pairwise_r(g, "g"), cut=0.9)
    return fam.merge_similar(g, "g", lab, merge_r=0.2)


@query("T15_threshold_scan")
def t15(spark, sf):
    g = tr.log_traces(grid(spark, sf, 86400, 30))
    return fam.threshold_scan(g.select("channel").distinct(), tr.pairwise_r(g, "g"))
