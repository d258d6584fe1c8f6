"""Peak-table shapes over the provided star-schema tables, in Spark and in SQL.

Each adapter maps every row of its table; the SQL text beside it is the same
mapping for the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ts(col: str) -> Column:
    return F.col(col).cast("timestamp")


# ---------------------------------------------------------------- peaks (lineitem)
def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("b"), (F.col("l_suppkey") % 4).cast("string")).alias("sample_batch_name"),
        F.date_format("l_shipdate", "yyyy-MM").alias("sample_item_id"),
        F.concat(F.lit("n"), F.date_format("l_shipdate", "yyyyMM")).alias("sample_item_name"),
        F.date_trunc("month", _ts("l_shipdate")).alias("datetime_utc"),
        F.concat_ws(
            "-",
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            F.round(F.col("l_extendedprice") * 100).cast("long"),
        ).alias("peak_id"),
        (
            F.lit(100.0)
            + (F.col("l_partkey") % 500) * F.lit(0.2508387)
            + (F.col("l_tax") * 100.0 - 4.0) * F.lit(0.0002)
        ).alias("mz"),
        F.col("l_extendedprice").alias("height"),
    )


PEAKS = """peaks AS (
  SELECT 'b' || (l_suppkey % 4) AS sample_batch_name,
         strftime(l_shipdate, '%Y-%m') AS sample_item_id,
         'n' || strftime(l_shipdate, '%Y%m') AS sample_item_name,
         date_trunc('month', l_shipdate) AS datetime_utc,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(round(l_extendedprice * 100) AS BIGINT)) AS peak_id,
         100.0::DOUBLE + (l_partkey % 500) * 0.2508387::DOUBLE
           + (l_tax * 100.0::DOUBLE - 4.0::DOUBLE) * 0.0002::DOUBLE AS mz,
         l_extendedprice AS height
  FROM lineitem)"""


def gap_sql(src: str, out: str, x: str, ppm: float | None = None, da: float | None = None,
            keys: str = "", bin_name: str = "bin") -> str:
    """SQL for the sequential gap rule over the CTE ``src``."""
    part = f"PARTITION BY {keys} " if keys else ""
    lag = f"lag({x}) OVER ({part}ORDER BY {x})"
    gap = f"({x} - {lag}) / {lag} * 1e6 > {ppm}" if ppm is not None else f"{x} - {lag} > {da}"
    return f"""{out}_brk AS (
  SELECT *, CASE WHEN {gap} THEN 1 ELSE 0 END AS brk FROM {src} WHERE {x} IS NOT NULL),
{out} AS (SELECT * EXCLUDE (brk), CAST(sum(brk) OVER ({part}ORDER BY {x}) AS BIGINT) AS {bin_name} FROM {out}_brk)"""


BINNED = PEAKS + ",\n" + gap_sql("peaks", "binned", "mz", ppm=5)
BINS = BINNED + """,
bins AS (SELECT bin, sum(mz * height) / sum(height) AS bin_mz, min(mz) AS lo_mz, max(mz) AS hi_mz,
                count(*) AS n_peaks FROM binned GROUP BY bin)"""
CELLS = BINS + """,
cells AS (SELECT sample_item_id, bin, sum(height) AS height FROM binned GROUP BY 1, 2)"""

# ---------------------------------------------------------------- ledger (part)
# One ion per axis position, with the identity fields the operators carry along.


def ledger_ions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.col("p_partkey") % 500
    return (
        table(spark, sf_dir, "part")
        .groupBy(pos.alias("pos"))
        .agg(
            F.min("p_brand").alias("brand"),
            F.max("p_size").alias("psize"),
            F.max("p_retailprice").alias("price"),
        )
        .select(
            (F.lit(100.0) + F.col("pos") * F.lit(0.2508387) + (F.col("pos") % 7 - 3) * F.lit(0.0003)).alias("mz"),
            F.concat(F.lit("F"), (F.col("pos") % 250).cast("string")).alias("neutral_formula"),
            F.concat(F.lit("[M+"), F.col("brand"), F.lit("]")).alias("adduct"),
            F.when(F.col("psize") > 25, "Assigned").otherwise("Candidate").alias("tier"),
            (F.col("price") / 2000.0).alias("ion_score"),
        )
    )


LEDGER = """ledger AS (
  SELECT 100.0::DOUBLE + pos * 0.2508387::DOUBLE + (pos % 7 - 3) * 0.0003::DOUBLE AS mz,
         'F' || (pos % 250) AS neutral_formula, '[M+' || brand || ']' AS adduct,
         CASE WHEN psize > 25 THEN 'Assigned' ELSE 'Candidate' END AS tier,
         price / 2000.0::DOUBLE AS ion_score
  FROM (SELECT p_partkey % 500 AS pos, min(p_brand) AS brand, max(p_size) AS psize,
               max(p_retailprice) AS price FROM part GROUP BY 1))"""

# ---------------------------------------------------------------- traces (events)


def trace_cells(spark: SparkSession, sf_dir: str, bucket_s: int = 21600, channels: int = 30) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            (F.col("user_id") % channels).cast("long").alias("channel"),
            F.floor(F.unix_micros(_ts("ts")) / F.lit(1e6) / F.lit(float(bucket_s))).alias("tb"),
        )
        .agg(F.sum("value").alias("y"))
    )


def traces_sql(bucket_s: int = 21600, channels: int = 30, name: str = "traces") -> str:
    return f"""{name} AS (
  SELECT CAST(user_id % {channels} AS BIGINT) AS channel,
         CAST(floor(epoch(ts) / {bucket_s}) AS BIGINT) AS tb, sum(value) AS y
  FROM events GROUP BY 1, 2)"""


# ---------------------------------------------------------------- formulas (part)


def part_formula(partkey: Column, size: Column) -> Column:
    c = partkey % 20 + 1
    return F.concat(
        F.lit("C"), c.cast("string"),
        F.lit("H"), (c * 2 + 2 - (size % 4) * 2).cast("string"),
        F.when(partkey % 3 > 0, F.concat(F.lit("N"), (partkey % 3).cast("string"))).otherwise(""),
        F.when(size % 9 > 0, F.concat(F.lit("O"), (size % 9).cast("string"))).otherwise(""),
    )


PART_FORMULA = """'C' || (p_partkey % 20 + 1) || 'H' || (2 * (p_partkey % 20 + 1) + 2 - 2 * (p_size % 4))
         || CASE WHEN p_partkey % 3 > 0 THEN 'N' || (p_partkey % 3) ELSE '' END
         || CASE WHEN p_size % 9 > 0 THEN 'O' || (p_size % 9) ELSE '' END"""


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .select(part_formula(F.col("p_partkey"), F.col("p_size")).alias("neutral_formula"))
        .distinct()
    )


FORMULAS = f"formulas AS (SELECT DISTINCT {PART_FORMULA} AS neutral_formula FROM part)"


# ---------------------------------------------------------------- per-file owners (lineitem)


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    num = (F.col("l_partkey") % 500).cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.round(F.col("l_extendedprice") * 100).cast("long"),
        ).alias("peak_id"),
        (
            F.lit(100.0) + (F.col("l_partkey") % 500) * F.lit(0.2508387)
            + (F.col("l_tax") * 100.0 - 4.0) * F.lit(0.0002)
        ).alias("mz"),
        F.concat(F.lit("f"), (F.col("l_suppkey") % 8).cast("string")).alias("src"),
        F.concat(F.when(F.col("l_linenumber") == 7, "X").otherwise("F"), num).alias("neutral_formula"),
        F.concat(F.lit("[M+"), F.col("l_linestatus"), F.lit("]")).alias("adduct"),
        F.when(F.col("l_returnflag") == "A", "Assigned").otherwise("Candidate").alias("tier"),
        (F.lit(1.0) - F.col("l_discount")).alias("ion_score"),
        F.col("l_extendedprice").alias("height"),
    )


OWNERS = """owners AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CAST(round(l_extendedprice * 100) AS BIGINT)) AS peak_id,
         100.0::DOUBLE + (l_partkey % 500) * 0.2508387::DOUBLE
           + (l_tax * 100.0::DOUBLE - 4.0::DOUBLE) * 0.0002::DOUBLE AS mz,
         'f' || (l_suppkey % 8) AS src,
         (CASE WHEN l_linenumber = 7 THEN 'X' ELSE 'F' END) || (l_partkey % 500) AS neutral_formula,
         '[M+' || l_linestatus || ']' AS adduct,
         CASE WHEN l_returnflag = 'A' THEN 'Assigned' ELSE 'Candidate' END AS tier,
         1.0::DOUBLE - l_discount AS ion_score, l_extendedprice AS height
  FROM lineitem)"""


# ---------------------------------------------------------------- ledger rows (lineitem)
# One ledger row per line: the role follows the line number, the formula the part.


def _row_counts() -> dict[str, Column]:
    c = F.col("l_partkey") % 20 + 4
    nn = F.col("l_partkey") % 3
    u = F.col("l_quantity").cast("long") % 4
    return {
        "C": c,
        "H": c * 2 + 2 + nn - u * 2,
        "N": nn,
        "O": F.col("l_suppkey") % 9,
        "S": F.when(F.col("l_suppkey") % 11 == 0, 1).otherwise(0),
        "Si": F.when(F.col("l_partkey") % 13 == 0, 1).otherwise(0),
    }


def _part(symbol: str, count: Column) -> Column:
    return F.when(count == 1, F.lit(symbol)).when(
        count > 1, F.concat(F.lit(symbol), count.cast("string"))
    ).otherwise("")


def counted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their atom counts, then formula and mass, each as columns of a projection of its own.

    In one expression every use repeats all of it, and the compiled method gets too long for the JVM to optimise.
    """
    n = _row_counts()
    n["H"] = n["H"] + F.when(F.col("l_partkey") % 13 == 0, 2).otherwise(0)
    rows = table(spark, sf_dir, "lineitem").withColumns({f"_{e}": c for e, c in n.items()})
    n = {e: F.col(f"_{e}") for e in n}
    mass = (
        n["C"] * F.lit(12.0) + n["H"] * F.lit(1.0078250319) + n["N"] * F.lit(14.0030740052)
        + n["O"] * F.lit(15.9949146221) + n["S"] * F.lit(31.97207069) + n["Si"] * F.lit(27.9769265350)
    )
    formula = F.concat(*[_part(e, n[e]) for e in ("C", "H", "N", "O", "S", "Si")])
    return rows.withColumns({"_formula": formula, "_mass": mass})


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    formula, mass = F.col("_formula"), F.col("_mass")
    bromide = F.col("l_linestatus") == "F"
    adduct = F.when(bromide, "[M+Br]-").otherwise("[M-H]-")
    shift = F.when(bromide, F.lit(78.9183371 + 0.0005485799)).otherwise(F.lit(-1.0078250319 + 0.0005485799))
    ppm = (F.round(F.col("l_tax") * 100) - 4) * F.lit(0.4)
    line = F.col("l_linenumber")
    role = (
        F.when(line <= 3, "M0").when(line == 4, "iso_child").when(line == 5, "reagent")
        .when(line == 6, "unexplained").otherwise("artifact")
    )
    is_m0 = role == "M0"
    peak_id = F.concat_ws(
        "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(F.col("l_extendedprice") * 100).cast("long"),
    )
    sample = F.date_format("l_shipdate", "yyyy-MM")
    rows = counted_lines(spark, sf_dir).select(
        sample.alias("sample_item_id"),
        F.concat(F.lit("f"), (F.col("l_suppkey") % 8).cast("string")).alias("src"),
        peak_id.alias("peak_id"),
        F.col("l_orderkey").alias("ord"),
        ((mass + shift) * (F.lit(1.0) + ppm * F.lit(1e-6))).alias("mz"),
        F.col("l_extendedprice").alias("height"),
        role.alias("role"),
        F.when(is_m0, formula).alias("neutral_formula"),
        F.when(is_m0, adduct).alias("adduct"),
        F.when(is_m0, F.concat(formula, F.when(bromide, "Br").otherwise(""), F.lit("-")))
        .when(line == 5, F.concat(F.lit("Br"), (F.col("l_partkey") % 3 + 1).cast("string"), F.lit("-")))
        .alias("ion_formula"),
        F.when(is_m0, F.when(F.col("l_returnflag") == "R", "Candidate").otherwise("Assigned")).alias("tier"),
        F.when(is_m0, F.lit(1.0) - F.col("l_discount")).alias("ion_score"),
        F.when(is_m0, ppm).alias("ppm_error"),
        F.when(is_m0, F.col("l_discount")).alias("eff_margin"),
        F.when(
            is_m0,
            F.when(F.col("l_discount") < 0.03, "High").when(F.col("l_discount") < 0.06, "Good (series)").otherwise("Low"),
        ).alias("confidence"),
        F.when(is_m0, F.concat(F.lit("known:"), (F.col("l_suppkey") % 3).cast("string"))).alias("method"),
        F.when(is_m0, line.cast("long")).alias("pass_no"),
        F.when(line == 4, F.when(bromide, "81Br").otherwise("13C")).alias("iso_label"),
        F.when(line == 4, F.lit(1.0) - F.col("l_tax")).alias("iso_match_score"),
        F.when(line == 5, F.concat(F.lit("reagent ion: (79Br+"), (F.col("l_suppkey") % 2 + 80).cast("string"),
                                   F.lit("Br) (+0.3 ppm)")))
        .when(is_m0, "ok").alias("commentary"),
    )
    # Only satellites have parents, so only their lines and the owners' ids are shuffled.
    parents = rows.where(line <= 3).groupBy("sample_item_id", "ord").agg(F.min("peak_id").alias("parent_peak_id"))
    kids = rows.where(line == 4).withColumn("role", F.lit("iso_child")).join(parents, ["sample_item_id", "ord"], "left").drop("ord")
    rest = rows.where((line != 4) | line.isNull()).drop("ord").withColumn("parent_peak_id", F.lit(None).cast("string"))
    return rest.unionByName(kids)


LROWS = """lr0 AS (
  SELECT *, l_partkey % 20 + 4 AS nc, l_partkey % 3 AS nn, l_suppkey % 9 AS no,
         CASE WHEN l_suppkey % 11 = 0 THEN 1 ELSE 0 END AS ns, CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END AS nsi,
         (round(l_tax * 100) - 4) * 0.4::DOUBLE AS ppm, l_linestatus = 'F' AS bromide,
         CASE WHEN l_linenumber <= 3 THEN 'M0' WHEN l_linenumber = 4 THEN 'iso_child' WHEN l_linenumber = 5 THEN 'reagent'
              WHEN l_linenumber = 6 THEN 'unexplained' ELSE 'artifact' END AS role,
         strftime(l_shipdate, '%Y-%m') AS sample_item_id, 'f' || (l_suppkey % 8) AS src,
         concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS peak_id
  FROM lineitem),
lr1 AS (SELECT *, 2 * nc + 2 + nn - 2 * (CAST(l_quantity AS BIGINT) % 4) + 2 * nsi AS nh FROM lr0),
lr2 AS (SELECT *, 'C' || nc || CASE WHEN nh = 1 THEN 'H' WHEN nh > 1 THEN 'H' || nh ELSE '' END
          || CASE WHEN nn = 1 THEN 'N' WHEN nn > 1 THEN 'N' || nn ELSE '' END
          || CASE WHEN no = 1 THEN 'O' WHEN no > 1 THEN 'O' || no ELSE '' END
          || CASE WHEN ns = 1 THEN 'S' ELSE '' END || CASE WHEN nsi = 1 THEN 'Si' ELSE '' END AS f,
        nc * 12.0::DOUBLE + nh * 1.0078250319::DOUBLE + nn * 14.0030740052::DOUBLE + no * 15.9949146221::DOUBLE
          + ns * 31.97207069::DOUBLE + nsi * 27.9769265350::DOUBLE AS mass FROM lr1),
lrows AS (SELECT sample_item_id, src, peak_id, nc, nh, nn, no, ns, nsi, mass,
    (mass + CASE WHEN bromide THEN 78.9183371::DOUBLE + 0.0005485799::DOUBLE ELSE -1.0078250319::DOUBLE + 0.0005485799::DOUBLE END)
      * (1.0::DOUBLE + ppm * 1e-6::DOUBLE) AS mz,
    l_extendedprice AS height, role,
    CASE WHEN role = 'M0' THEN f END AS neutral_formula,
    CASE WHEN role = 'M0' THEN CASE WHEN bromide THEN '[M+Br]-' ELSE '[M-H]-' END END AS adduct,
    CASE WHEN role = 'M0' THEN f || CASE WHEN bromide THEN 'Br' ELSE '' END || '-'
         WHEN role = 'reagent' THEN 'Br' || (l_partkey % 3 + 1) || '-' END AS ion_formula,
    CASE WHEN role = 'M0' THEN CASE WHEN l_returnflag = 'R' THEN 'Candidate' ELSE 'Assigned' END END AS tier,
    CASE WHEN role = 'M0' THEN 1.0::DOUBLE - l_discount END AS ion_score,
    CASE WHEN role = 'M0' THEN ppm END AS ppm_error, CASE WHEN role = 'M0' THEN l_discount END AS eff_margin,
    CASE WHEN role = 'M0' THEN CASE WHEN l_discount < 0.03 THEN 'High' WHEN l_discount < 0.06 THEN 'Good (series)' ELSE 'Low' END END AS confidence,
    CASE WHEN role = 'M0' THEN 'known:' || (l_suppkey % 3) END AS method,
    CASE WHEN role = 'M0' THEN l_linenumber END AS pass_no,
    CASE WHEN role = 'iso_child' THEN CASE WHEN bromide THEN '81Br' ELSE '13C' END END AS iso_label,
    CASE WHEN role = 'iso_child' THEN 1.0::DOUBLE - l_tax END AS iso_match_score,
    CASE WHEN role = 'reagent' THEN '79Br+' || (l_suppkey % 2 + 80) || 'Br' END AS tag,
    CASE WHEN role = 'iso_child' THEN min(CASE WHEN role = 'M0' THEN peak_id END)
         OVER (PARTITION BY sample_item_id, l_orderkey) END AS parent_peak_id
  FROM lr2)"""


# ---------------------------------------------------------------- spectra (lineitem)
# Every ledger row as an ion with its natural 13C (and, on the bromide form, 81Br) satellite.


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    bromide = F.col("l_linestatus") == "F"
    lines = F.array_compact(
        F.array(
            F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("step"), F.lit(1.0).alias("rel")),
            F.struct(F.lit(1).alias("k"), F.lit(1.003355).alias("step"),
                     ((F.col("l_partkey") % 20 + 4) * F.lit(0.0108)).alias("rel")),
            F.when(bromide, F.struct(F.lit(2).alias("k"), F.lit(1.9979521).alias("step"), F.lit(0.9728).alias("rel"))),
        )
    )
    mass = F.col("_mass")
    shift = F.when(bromide, F.lit(78.9183371 + 0.0005485799)).otherwise(F.lit(-1.0078250319 + 0.0005485799))
    ppm = (F.round(F.col("l_tax") * 100) - 4) * F.lit(0.4)
    rows = counted_lines(spark, sf_dir).select(
        F.date_format("l_shipdate", "yyyy-MM").alias("sample_item_id"),
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")
        ).alias("row_id"),
        ((mass + shift) * (F.lit(1.0) + ppm * F.lit(1e-6))).alias("mz"),
        F.col("l_extendedprice").alias("height"),
        F.explode(lines).alias("q"),
    )
    return rows.select(
        "sample_item_id", F.concat_ws("-", "row_id", F.col("q.k").cast("string")).alias("peak_id"),
        (F.col("mz") + F.col("q.step")).alias("mz"), (F.col("height") * F.col("q.rel")).alias("height"),
    )


SPECTRA = LROWS + """,
spectra AS (
  SELECT l.sample_item_id, l.peak_id || '-' || q.k AS peak_id, l.mz + q.step AS mz, l.height * q.rel AS height
  FROM (SELECT r.sample_item_id, r.peak_id, r.bromide, r.nc,
     (mass + CASE WHEN bromide THEN 78.9183371::DOUBLE + 0.0005485799::DOUBLE ELSE -1.0078250319::DOUBLE + 0.0005485799::DOUBLE END)
      * (1.0::DOUBLE + ppm * 1e-6::DOUBLE) AS mz, l_extendedprice AS height FROM lr2 r) l,
  LATERAL (SELECT * FROM (VALUES (0, 0.0::DOUBLE, 1.0::DOUBLE), (1, 1.003355::DOUBLE, l.nc * 0.0108::DOUBLE), (2, 1.9979521::DOUBLE, 0.9728::DOUBLE)) v(k, step, rel)
           WHERE v.k < 2 OR l.bromide) q)"""
