"""Queries over the axis bins, the sparse matrix and sample choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionloom.functions.quantiles import exact_quantiles
from ionloom.operators import axis, matrix, sampling
from ionloom.plans import adapters as ad
from ionloom.plans.adapters import BINNED, BINS, CELLS, LEDGER, PEAKS, gap_sql
from ionloom.plans.registry import query

TRACE_MZ = 150.1677
CLOCK = """clock AS (SELECT sample_item_id, min(datetime_utc) AS datetime_utc,
   (epoch(min(datetime_utc)) - epoch((SELECT min(datetime_utc) FROM peaks))) / 3600.0 AS hours
   FROM peaks GROUP BY 1)"""


def _cells(spark, sf):
    binned = matrix.binned_peaks(ad.peaks(spark, sf))
    return matrix.matrix_cells(binned), matrix.bin_table(binned)


@query("S1_load_batch", f"""WITH {PEAKS}
SELECT sample_item_id, peak_id, round(mz, 8) AS mz, height FROM peaks WHERE sample_batch_name = 'b1'""")
def s1(spark, sf):
    p = ad.peaks(spark, sf).where(F.col("sample_batch_name") == "b1")
    return p.select("sample_item_id", "peak_id", F.round("mz", 8).alias("mz"), "height")


@query("S2_pooled_batches", f"""WITH {PEAKS}
SELECT sample_batch_name, sample_item_id, peak_id, height FROM peaks
WHERE regexp_matches(sample_batch_name, '^B[02]$', 'i')""")
def s2(spark, sf):
    from ionloom.sources.tables import batches_matching

    p = batches_matching(ad.peaks(spark, sf), "^B[02]$")
    return p.select("sample_batch_name", "sample_item_id", "peak_id", "height")


@query("S3_batch_samples", f"""WITH {PEAKS}
SELECT sample_batch_name, sample_item_id, min(sample_item_name) AS sample_item_name,
       min(datetime_utc) AS datetime_utc, count(*) AS n_peaks, round(sum(height), 2) AS tic
FROM peaks GROUP BY 1, 2""")
def s3(spark, sf):
    t = sampling.sample_table(ad.peaks(spark, sf), ["sample_batch_name"])
    return t.withColumn("tic", F.round("tic", 2))


@query("B1_B2_axis_bins", f"""WITH {BINS}
SELECT bin, round(bin_mz, 8) AS bin_mz, round(lo_mz, 8) AS lo_mz, round(hi_mz, 8) AS hi_mz, n_peaks FROM bins""")
def b1(spark, sf):
    t = matrix.bin_table(matrix.binned_peaks(ad.peaks(spark, sf)))
    return t.select("bin", *[F.round(c, 8).alias(c) for c in ("bin_mz", "lo_mz", "hi_mz")], "n_peaks")


@query("B1_matrix_cells", f"WITH {CELLS} SELECT sample_item_id, bin, round(height, 2) AS height FROM cells")
def b1c(spark, sf):
    return _cells(spark, sf)[0].withColumn("height", F.round("height", 2))


@query("B3_cross_file_clusters", f"""WITH {PEAKS},
{gap_sql("peaks", "binned", "mz", ppm=6)}
SELECT bin AS cluster, count(*) AS n, round(min(mz), 8) AS lo, round(max(mz), 8) AS hi FROM binned GROUP BY 1""")
def b3(spark, sf):
    return (
        axis.assign_bins(ad.peaks(spark, sf), "mz", 6.0, out="cluster")
        .groupBy("cluster")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.min("mz"), 8).alias("lo"), F.round(F.max("mz"), 8).alias("hi"))
    )


@query("B4_artefact_tracks", f"""WITH {PEAKS}, {gap_sql("peaks", "tracks", "mz", da=0.003, bin_name="track")}
SELECT track, round(median(mz), 8) AS mz, count(*) AS n FROM tracks GROUP BY 1""")
def b4(spark, sf):
    t = axis.assign_bins(ad.peaks(spark, sf), "mz", tol_abs=3e-3, out="track")
    n = t.groupBy("track").agg(F.count(F.lit(1)).alias("n"))
    return exact_quantiles(t, ["track"], "mz", {"mz": 0.5}).join(n, "track").withColumn("mz", F.round("mz", 8))


@query("B5_ion_tracks", f"""WITH {PEAKS}, {LEDGER},
near AS (SELECT l.mz AS ion_mz, p.mz - l.mz AS off, p.height FROM ledger l JOIN peaks p
         ON p.mz BETWEEN l.mz - 0.0025 AND l.mz + 0.0025),
{gap_sql("near", "tracks", "off", da=0.0003, keys="ion_mz", bin_name="track")}
SELECT round(ion_mz, 8) AS ion_mz, track, count(*) AS n, round(max(height), 2) AS top
FROM tracks GROUP BY 1, 2""")
def b5(spark, sf):
    from ionloom.operators import audit

    t = audit.raw_tracks(ad.peaks(spark, sf), ad.ledger_ions(spark, sf), window=2.5e-3, track_gap=3e-4)
    return t.groupBy(F.round("ion_mz", 8).alias("ion_mz"), "track").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("height"), 2).alias("top")
    )


@query("B6_native_cadence", """WITH s AS (SELECT DISTINCT date_trunc('second', ts) AS t FROM events),
d AS (SELECT epoch(t) - lag(epoch(t)) OVER (ORDER BY t) AS step FROM s)
SELECT greatest(1, CAST(ceil(median(step) / 60.0) AS BIGINT)) AS bin_minutes FROM d""")
def b6(spark, sf):
    e = ad.table(spark, sf, "events").select(
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("datetime_utc")
    )
    return matrix.native_cadence(e.withColumn("sample_item_id", F.col("datetime_utc").cast("string")))


@query("B7_time_bucket_medians", """WITH c AS (SELECT CAST(floor(epoch(ts) / 7200.0) AS BIGINT) AS tb,
       CAST(user_id % 20 AS BIGINT) AS bin, value FROM events)
SELECT tb, bin, round(median(value), 6) AS height FROM c GROUP BY 1, 2""")
def b7(spark, sf):
    e = ad.table(spark, sf, "events").select(
        F.col("event_id").alias("sample_item_id"),
        (F.col("user_id") % 20).cast("long").alias("bin"),
        F.col("value").alias("height"),
        F.col("ts").cast("timestamp").alias("datetime_utc"),
    )
    out = matrix.time_bucket_medians(
        e.select("sample_item_id", "bin", "height"), e.select("sample_item_id", "datetime_utc"), 2.0
    )
    return out.withColumn("height", F.round("height", 6))


@query("B8_regular_grid", f"""WITH {ad.traces_sql(3600, 10)},
t AS (SELECT channel, (tb - (SELECT min(tb) FROM traces)) * 1.0 AS hours, y FROM traces),
m AS (SELECT channel, CAST(floor(hours / 5.0) AS BIGINT) + 1 AS slot, median(y) AS y FROM t GROUP BY 1, 2),
g AS (SELECT channel, slot FROM (SELECT DISTINCT channel FROM t),
      (SELECT unnest(range(1, (SELECT max(slot) + 1 FROM m))) AS slot))
SELECT g.channel, g.slot, round(m.y, 6) AS y FROM g LEFT JOIN m USING (channel, slot)""")
def b8(spark, sf):
    t = ad.trace_cells(spark, sf, 3600, 10)
    t0 = F.broadcast(t.agg(F.min("tb").alias("t0")).withColumn("one", F.lit(1)))
    hours = t.withColumn("one", F.lit(1)).join(t0, "one").select(
        "channel", (F.col("tb") - F.col("t0")).cast("double").alias("hours"), "y"
    )
    return matrix.regular_grid(hours, 5.0).withColumn("y", F.round("y", 6))


NEIGHBOURS = """pairs AS (
  SELECT DISTINCT formula, bin FROM (
    SELECT i.formula, b.bin FROM ions i JOIN bins b ON abs(b.bin_mz - i.mz) / i.mz * 1e6 <= 8))"""
IONS = """ions AS (SELECT neutral_formula AS formula, mz FROM ledger)"""


@query("B9_formula_traces", f"""WITH {CELLS}, {CLOCK}, {LEDGER}, {IONS}, {NEIGHBOURS},
tot AS (SELECT sample_item_id, sum(height) AS tot FROM cells GROUP BY 1)
SELECT p.formula, c.sample_item_id, round(sum(c.height) / max(t.tot), 9) AS y, round(max(k.hours), 6) AS hours
FROM cells c JOIN pairs p USING (bin) JOIN tot t USING (sample_item_id) JOIN clock k USING (sample_item_id)
GROUP BY 1, 2""")
def b9(spark, sf):
    p = ad.peaks(spark, sf)
    cells, bins = _cells(spark, sf)
    ions = ad.ledger_ions(spark, sf).select(F.col("neutral_formula").alias("formula"), "mz")
    tic = cells.groupBy("sample_item_id").agg(F.sum("height").alias("reagent_total"))
    t = matrix.formula_traces(cells, bins, ions, matrix.sample_clock(p), tic)
    return t.select("formula", "sample_item_id", F.round("y", 9).alias("y"), F.round("hours", 6).alias("hours"))


NEAREST_BIN = """hit AS (
  SELECT * FROM (SELECT i.*, b.bin, b.bin_mz,
      row_number() OVER (PARTITION BY i.key ORDER BY abs(b.bin_mz - i.mz), b.bin_mz) AS rn
    FROM ikeys i JOIN bins b ON abs(b.bin_mz - i.mz) / i.mz * 1e6 <= 8) WHERE rn = 1)"""
IKEYS = "ikeys AS (SELECT neutral_formula || '|' || adduct || '|' || CAST(round(mz * 1000) AS BIGINT) AS key, mz FROM ledger)"


def ion_keys(spark, sf):
    return ad.ledger_ions(spark, sf).select(
        F.concat_ws("|", "neutral_formula", "adduct", F.round(F.col("mz") * 1000).cast("long").cast("string")).alias("key"),
        "mz",
    )


@query("B10_ion_traces", f"""WITH {CELLS}, {CLOCK}, {LEDGER}, {IKEYS}, {NEAREST_BIN}
SELECT h.key, c.sample_item_id, round(c.height, 2) AS y, round(k.hours, 6) AS hours
FROM hit h JOIN cells c USING (bin) JOIN clock k USING (sample_item_id)""")
def b10(spark, sf):
    cells, bins = _cells(spark, sf)
    t = matrix.ion_traces(cells, bins, ion_keys(spark, sf), matrix.sample_clock(ad.peaks(spark, sf)))
    return t.select("key", "sample_item_id", F.round("y", 2).alias("y"), F.round("hours", 6).alias("hours"))


@query("B11_trace_by_position", f"""WITH {PEAKS}, {LEDGER},
lab AS (SELECT neutral_formula || ' ' || adduct || ' (' || tier || ')' AS assignment FROM ledger
        WHERE abs(mz - {TRACE_MZ}) / {TRACE_MZ} * 1e6 <= 5 ORDER BY abs(mz - {TRACE_MZ}), mz LIMIT 1)
SELECT datetime_utc, round(sum(height), 2) AS height, count(DISTINCT peak_id) AS n_peak_ids,
       coalesce((SELECT assignment FROM lab), 'unassigned') AS assignment
FROM peaks WHERE abs(mz - {TRACE_MZ}) / {TRACE_MZ} * 1e6 <= 5 GROUP BY 1""")
def b11(spark, sf):
    from ionloom.plans.drivers import trace

    t = trace(ad.peaks(spark, sf), ad.ledger_ions(spark, sf), TRACE_MZ)
    return t.withColumn("height", F.round("height", 2))


@query("B11_trace_by_formula", f"""WITH {PEAKS}, {LEDGER},
pick AS (SELECT * FROM ledger WHERE neutral_formula = 'F17' ORDER BY ion_score DESC, mz LIMIT 1)
SELECT p.datetime_utc, round(sum(p.height), 2) AS height, count(DISTINCT p.peak_id) AS n_peak_ids,
       max(k.neutral_formula || ' ' || k.adduct || ' (' || k.tier || ')') AS assignment
FROM peaks p JOIN pick k ON abs(p.mz - k.mz) / k.mz * 1e6 <= 5 GROUP BY 1""")
def b11f(spark, sf):
    from ionloom.plans.drivers import trace

    t = trace(ad.peaks(spark, sf), ad.ledger_ions(spark, sf), "F17")
    return t.withColumn("height", F.round("height", 2))


@query("B12_sample_hours", f"WITH {PEAKS}, {CLOCK} SELECT sample_item_id, datetime_utc, round(hours, 6) AS hours FROM clock")
def b12(spark, sf):
    return matrix.sample_clock(ad.peaks(spark, sf)).withColumn("hours", F.round("hours", 6))


@query("J4_nearest_bin", f"""WITH {BINS}, {LEDGER}, {IKEYS}, {NEAREST_BIN}
SELECT i.key, h.bin, round(h.bin_mz, 6) AS bin_mz FROM ikeys i LEFT JOIN hit h ON h.key = i.key""")
def j4(spark, sf):
    _, bins = _cells(spark, sf)
    hit = axis.nearest(ion_keys(spark, sf), bins, "mz", "bin_mz", ["bin"], tol_ppm=8.0)
    return hit.select("key", F.col("hit.bin").alias("bin"), F.round("hit.bin_mz", 8).alias("bin_mz"))


@query("A1_sample_table", f"""WITH {PEAKS}
SELECT sample_item_id, count(*) AS n_peaks, round(sum(height), 2) AS tic, min(datetime_utc) AS datetime_utc,
       min(sample_item_name) AS sample_item_name FROM peaks GROUP BY 1""")
def a1(spark, sf):
    return sampling.sample_table(ad.peaks(spark, sf)).withColumn("tic", F.round("tic", 2))


@query("A23_total_over_time", f"""WITH {PEAKS}
SELECT sample_item_id, min(datetime_utc) AS datetime_utc, round(sum(height), 2) AS total FROM peaks GROUP BY 1 ORDER BY 2""")
def a23(spark, sf):
    t = sampling.sample_table(ad.peaks(spark, sf))
    return t.select("sample_item_id", "datetime_utc", F.round("tic", 2).alias("total")).orderBy("datetime_utc")


# The reagent library of these queries: all assigned ledger ions.
REAGENT = "reagent AS (SELECT mz FROM ledger WHERE tier = 'Assigned')"
REAGENT_TOTAL = """near AS (SELECT DISTINCT b.bin FROM reagent r JOIN bins b ON abs(b.bin_mz - r.mz) / r.mz * 1e6 <= 8),
tot AS (SELECT c.sample_item_id, sum(c.height) AS reagent_total FROM cells c JOIN near USING (bin) GROUP BY 1)"""


def reagent_ions(spark, sf):
    return ad.ledger_ions(spark, sf).where(F.col("tier") == "Assigned").select("mz")


def _totals(spark, sf, cells, bins):
    return matrix.total_near(cells, bins, reagent_ions(spark, sf))


@query("A2_reagent_total", f"""WITH {CELLS}, {LEDGER}, {REAGENT}, {REAGENT_TOTAL}
SELECT sample_item_id, round(reagent_total, 2) AS reagent_total FROM tot""")
def a2(spark, sf):
    cells, bins = _cells(spark, sf)
    return _totals(spark, sf, cells, bins).withColumn("reagent_total", F.round("reagent_total", 2))


@query("A3_normalised_cells", f"""WITH {CELLS}, {LEDGER}, {REAGENT}, {REAGENT_TOTAL}
SELECT c.sample_item_id, c.bin, round(c.height / nullif(t.reagent_total, 0), 9) AS norm
FROM cells c LEFT JOIN tot t USING (sample_item_id)""")
def a3(spark, sf):
    cells, bins = _cells(spark, sf)
    n = matrix.normalised(cells, _totals(spark, sf, cells, bins))
    return n.select("sample_item_id", "bin", F.round("norm", 9).alias("norm"))


@query("A4_bin_metrics", f"""WITH {CELLS}
SELECT bin, round(count(*) / (SELECT count(DISTINCT sample_item_id) FROM cells), 9) AS presence,
       round(median(height), 4) AS median, round(stddev_samp(height) / avg(height), 7) AS cv FROM cells GROUP BY 1""")
def a4(spark, sf):
    m = matrix.bin_metrics(_cells(spark, sf)[0])
    return m.select(
        "bin", F.round("presence", 9).alias("presence"), F.round("median", 4).alias("median"), F.round("cv", 7).alias("cv")
    )


@query("W1_representative_samples", """WITH s AS (
  SELECT strftime(o_orderdate, '%Y-%m-%d') AS sample_item_id, count(*) AS n_peaks, sum(o_totalprice) AS tic,
         min(o_orderdate) AS datetime_utc FROM orders GROUP BY 1),
e AS (SELECT epoch_us(min(datetime_utc))::DOUBLE AS t0, epoch_us(max(datetime_utc))::DOUBLE AS t1 FROM s),
targets AS (SELECT i, t0 + (t1 - t0) * (i / 4.0::DOUBLE) AS tgt FROM e, (SELECT unnest(range(5)) AS i)),
near AS (SELECT s.sample_item_id, row_number() OVER (PARTITION BY i ORDER BY abs(epoch_us(datetime_utc) - tgt), datetime_utc) AS rn
         FROM s, targets),
grid AS (SELECT sample_item_id FROM near WHERE rn = 1),
top AS (SELECT sample_item_id FROM s ORDER BY tic DESC, datetime_utc LIMIT 1)
SELECT sample_item_id, n_peaks, round(tic, 2) AS tic, datetime_utc,
       CASE WHEN sample_item_id IN (SELECT * FROM grid) AND sample_item_id IN (SELECT * FROM top) THEN 'time-grid+max-TIC'
            WHEN sample_item_id IN (SELECT * FROM top) THEN 'max-TIC' ELSE 'time-grid' END AS role
FROM s WHERE sample_item_id IN (SELECT * FROM grid) OR sample_item_id IN (SELECT * FROM top)""")
def w1(spark, sf):
    o = ad.table(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("sample_item_id"),
        F.col("o_orderdate").cast("timestamp").alias("datetime_utc"),
        F.col("o_totalprice").alias("height"),
        F.lit(None).cast("string").alias("sample_item_name"),
    )
    s = sampling.sample_table(o).drop("sample_item_name")
    return sampling.representative_samples(s).withColumn("tic", F.round("tic", 2))


def coverage_sql(group: str, k_max: int, k_min: int, target: float, floor: float) -> str:
    """SQL twin of the coverage choice, per ``group`` (a column of ``peaks``)."""
    bins = gap_sql("peaks", "binned", "mz", ppm=5, keys=group)
    return f"""WITH {PEAKS}, {bins},
cells AS (SELECT {group} AS g, sample_item_id, bin, sum(height) AS height FROM binned GROUP BY 1, 2, 3),
tab AS (SELECT {group} AS g, sample_item_id, count(*) AS n_peaks, sum(height) AS tic, min(datetime_utc) AS datetime_utc
        FROM peaks GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g, bin ORDER BY height DESC, sample_item_id) AS rn FROM cells),
wins AS (SELECT g, sample_item_id, count(*) AS bins_won FROM ranked WHERE rn = 1 AND height >= {floor} GROUP BY 1, 2),
ordw AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY bins_won DESC, sample_item_id) AS rn,
                sum(bins_won) OVER (PARTITION BY g ORDER BY bins_won DESC, sample_item_id ROWS UNBOUNDED PRECEDING) AS covered,
                sum(bins_won) OVER (PARTITION BY g) AS total FROM wins),
cut AS (SELECT g, min(rn) AS last FROM ordw WHERE covered / total >= {target} AND rn >= {k_min} GROUP BY 1),
chosen AS (SELECT o.g, o.sample_item_id, o.bins_won FROM ordw o LEFT JOIN cut USING (g)
           WHERE o.rn <= least({k_max}, coalesce(cut.last, {k_max}))),
cnt AS (SELECT g, count(*) AS n FROM chosen GROUP BY 1),
spare AS (SELECT t.g, t.sample_item_id, row_number() OVER (PARTITION BY t.g ORDER BY tic DESC, t.sample_item_id) AS rn
          FROM tab t ANTI JOIN chosen c ON c.g = t.g AND c.sample_item_id = t.sample_item_id),
pad AS (SELECT s.g, s.sample_item_id, 0 AS bins_won FROM spare s LEFT JOIN cnt USING (g)
        WHERE s.rn + coalesce(cnt.n, 0) <= {k_min}),
cover AS (SELECT * FROM chosen UNION ALL SELECT * FROM pad),
ends AS (SELECT g, arg_min(sample_item_id, (datetime_utc, sample_item_id)) AS a,
                arg_max(sample_item_id, (datetime_utc, sample_item_id)) AS z FROM tab GROUP BY 1)
SELECT t.g AS grp, t.sample_item_id, t.n_peaks, round(t.tic, 2) AS tic,
       CASE WHEN c.sample_item_id IS NOT NULL AND t.sample_item_id IN (e.a, e.z) THEN 'coverage+time-grid'
            WHEN c.sample_item_id IS NOT NULL THEN 'coverage-winner' ELSE 'time-grid' END AS role,
       CAST(coalesce(c.bins_won, 0) AS BIGINT) AS bins_won
FROM tab t JOIN ends e USING (g) LEFT JOIN cover c ON c.g = t.g AND c.sample_item_id = t.sample_item_id
WHERE c.sample_item_id IS NOT NULL OR t.sample_item_id IN (e.a, e.z)"""


@query("W2_coverage_samples", coverage_sql("1", 10, 6, 0.85, 1000.0))
def w2(spark, sf):
    s = sampling.coverage_samples(ad.peaks(spark, sf))
    return s.select(
        F.lit(1).cast("long").alias("grp"), "sample_item_id", "n_peaks", F.round("tic", 2).alias("tic"), "role", "bins_won"
    )


@query("W3_U4_pooled_union", coverage_sql("sample_batch_name", 6, 6, 0.90, 1000.0))
def w3(spark, sf):
    _, s = sampling.pooled_union(ad.peaks(spark, sf))
    return s.select(
        F.col("sample_batch_name").alias("grp"), "sample_item_id", "n_peaks", F.round("tic", 2).alias("tic"), "role", "bins_won"
    )


@query("U4_pooled_ids", "WITH x AS (" + coverage_sql("sample_batch_name", 6, 6, 0.90, 1000.0) + """)
SELECT sample_item_id, min(grp) AS first_group FROM x GROUP BY 1""")
def u4(spark, sf):
    ids, _ = sampling.pooled_union(ad.peaks(spark, sf))
    return ids.select("sample_item_id", F.col("first_seen.sample_batch_name").alias("first_group"))
