"""Queries over whole-batch families, their gates and written results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ionloom.operators import batch, matrix
from ionloom.operators import families as fam
from ionloom.operators import traces as tr
from ionloom.plans import adapters as ad
from ionloom.plans.adapters import CELLS, LEDGER, PEAKS
from ionloom.plans.registry import query
from ionloom.plans.trace_queries import FAMILIES, GRID, grid, grid_sql, labels, smooth_sql
from ionloom.session import cut_lineage, shared_folder
from ionloom.sources import tables

STEPS = "(0, 1.003355::DOUBLE), (1, 0.997035::DOUBLE), (2, 1.995796::DOUBLE), (3, 1.997050::DOUBLE), (4, 1.997953::DOUBLE), (5, 2.004246::DOUBLE)"
GATES = f"""asg AS (SELECT DISTINCT bin FROM bins JOIN ledger l ON abs(l.mz - bin_mz) / bin_mz * 1e6 <= 8),
bt AS (SELECT b.bin, b.bin_mz, median(c.height) AS med, count(c.height) AS n, b.bin IN (SELECT bin FROM asg) AS assigned,
   count(*) FILTER (c.height > 0) / (SELECT count(DISTINCT sample_item_id) FROM cells)::DOUBLE AS presence
   FROM bins b JOIN cells c USING (bin) GROUP BY b.bin, b.bin_mz),
br AS (SELECT *, NOT assigned AND med >= 50 AND n >= 8 AS bright FROM bt),
st AS (SELECT * FROM (VALUES {STEPS}) t(i, s)),
ip AS (SELECT b.bin, k.bin_mz AS x, row_number() OVER (PARTITION BY b.bin ORDER BY st.i, k.bin_mz) AS rn FROM br b CROSS JOIN st JOIN br k
   ON k.assigned AND abs(k.bin_mz - (b.bin_mz - st.s)) / b.bin_mz * 1e6 <= 8 AND k.med > b.med WHERE b.bright),
gates AS (SELECT br.*, ip.x AS iso_parent, bright AND presence >= 0.3 AND ip.x IS NULL AS enters FROM br LEFT JOIN ip ON ip.bin = br.bin AND rn = 1)"""


def _gates(spark, sf):
    binned = matrix.binned_peaks(ad.peaks(spark, sf))
    return batch.bin_gates(matrix.matrix_cells(binned), matrix.bin_table(binned), ad.ledger_ions(spark, sf).select("mz"))


@query("T21_bin_gates", f"""WITH {CELLS}, {LEDGER}, {GATES}
SELECT bin, round(med, 6) AS median, round(presence, 9) AS presence, assigned, bright, round(iso_parent, 6) AS iso_parent, enters FROM gates""")
def t21g(spark, sf):
    g = _gates(spark, sf)
    return g.select("bin", F.round("median", 6).alias("median"), F.round("presence", 9).alias("presence"), "assigned", "bright",
                    F.round("iso_parent", 6).alias("iso_parent"), "enters")


@query("A25_funnel", f"""WITH {CELLS}, {LEDGER}, {GATES}
SELECT count(*) AS n_ts_bins, count(*) FILTER (NOT assigned) AS n_unassigned_any, count(*) FILTER (bright) AS n_after_brightness_persistence,
  count(*) FILTER (enters) AS n_entered_union, count(*) FILTER (bright AND iso_parent IS NOT NULL) AS n_isotope_rejected,
  count(*) FILTER (bright AND iso_parent IS NULL AND presence < 0.3) AS n_below_presence FROM gates""")
def a25(spark, sf):
    return batch.funnel(_gates(spark, sf))


@query("T21_batch_families")
def t21(spark, sf):
    g = grid(spark, sf, 86400, 60)
    names = g.select("channel").distinct().withColumn(
        "label", F.when(F.col("channel") % 4 != 0, F.concat(F.lit("F"), F.col("channel").cast("string")))
    )
    return batch.batch_families(g, names)


def union(spark, sf):
    """Traces of assigned ions and of the bins that enter, as ``union_traces`` and as a grid."""
    peaks, ledger = ad.peaks(spark, sf), ad.ledger_ions(spark, sf)
    binned = matrix.binned_peaks(peaks)
    cells, bins = cut_lineage(matrix.matrix_cells(binned)), cut_lineage(matrix.bin_table(binned))
    clock = peaks.groupBy("sample_item_id").agg(F.min("datetime_utc").alias("datetime_utc"))
    gates = batch.bin_gates(cells, bins, ledger.select("mz"))
    traces = cut_lineage(batch.union_traces(batch.assigned_traces(cells, bins, ledger, clock), cells, gates, clock))
    return traces, cut_lineage(batch.union_grid(traces))


@query("T21_union_families")
def t21u(spark, sf):
    traces, g = union(spark, sf)
    names = traces.groupBy("channel").agg(F.min("label").alias("label"))
    return batch.batch_families(g, names)


@query("T28_changing_series", f"""WITH {GRID}, d AS (SELECT channel, median(y) AS med, stddev_pop(y) / avg(y) AS cv FROM grid GROUP BY 1),
top AS (SELECT channel, row_number() OVER (ORDER BY med DESC, channel) AS place FROM d WHERE cv >= 0.3 QUALIFY place <= 28)
SELECT place, channel, round_even(hours, 1) AS hours, CASE WHEN y > 0 THEN round_even(y, 0) END AS y FROM grid JOIN top USING (channel)""")
def t28(spark, sf):
    return batch.changing_series(grid(spark, sf))


@query("T16_remaining", f"""WITH {GRID}, rem AS (SELECT DISTINCT channel, 0 AS cluster FROM grid WHERE channel % 5 = 0),
lz AS (SELECT channel, t, hours, (log10(greatest(y, 1e-9)) - avg(log10(greatest(y, 1e-9))) OVER (PARTITION BY channel))
        / stddev_samp(log10(greatest(y, 1e-9))) OVER (PARTITION BY channel) AS z FROM grid WHERE y IS NOT NULL),
fm AS (SELECT 0 AS cluster, a.t, a.hours, z.y FROM axis a LEFT JOIN (SELECT t, avg(z) AS y FROM lz JOIN rem USING (channel) GROUP BY 1) z ON z.t = a.t),
{smooth_sql(5, "fm", "cluster")},
e AS (SELECT avg(s) FILTER (t < 6) AS st, avg(s) FILTER (t > (SELECT max(t) FROM grid) - 6) AS en, arg_min(hours, (-s, t)) AS ph FROM sm)
SELECT (SELECT count(*) FROM rem) AS n, CASE WHEN en - st > 0.5 THEN 'rise' WHEN st - en > 0.5 THEN 'fall' ELSE 'peak' END AS shape, ph AS peak_hour FROM e""")
def t16r(spark, sf):
    g = grid(spark, sf)
    return fam.remaining_row(g, labels(g).where("cluster <> 0"))


@query("T26_class_profiles", f"""WITH {grid_sql(3600, 6)},
lg AS (SELECT channel, CAST(floor(hours % 24.0) AS BIGINT) AS h, log10(y) AS g FROM grid WHERE y > 0),
m AS (SELECT channel, h, 10 ** median(g) AS lin FROM lg GROUP BY 1, 2),
p AS (SELECT channel, h, lin / avg(lin) OVER (PARTITION BY channel) AS p FROM m)
SELECT 'c' || (channel % 2) AS cls, h, round(median(p), 7) AS profile, count(*) AS n FROM p GROUP BY 1, 2""")
def t26c(spark, sf):
    prof = tr.hour_profiles(grid(spark, sf, 3600, 6))
    cls = prof.select("channel").distinct().withColumn("cls", F.concat(F.lit("c"), (F.col("channel") % 2).cast("string")))
    return tr.class_profiles(prof, cls).withColumn("profile", F.round("profile", 7))


@query("S8_written_and_read", f"""WITH {PEAKS} SELECT sample_batch_name, sample_item_id, peak_id, round(mz, 7) AS mz FROM peaks""")
def s8(spark, sf):
    path = f"{shared_folder(spark)}/annotated-{uuid.uuid4().hex}"
    tables.write_annotated(ad.peaks(spark, sf).select("sample_batch_name", "sample_item_id", "peak_id", "mz"), path)
    back = tables.require_rows(spark.read.parquet(path), "the written batch")
    return back.select("sample_batch_name", "sample_item_id", "peak_id", F.round("mz", 7).alias("mz"))


@query("S9_registry", f"""WITH {PEAKS} SELECT count(*) AS n_rows, 'first' AS run FROM peaks UNION ALL SELECT count(*), 'second' FROM peaks""")
def s9(spark, sf):
    path = f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}"
    found = tables.table_digest(ad.peaks(spark, sf).select("sample_item_id", "peak_id", "mz", "height"))
    for run in ("first", "second"):
        runs = tables.append_registry(spark, path, {"run": run}, found)
    return runs.select("n_rows", "run")
