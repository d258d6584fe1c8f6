import random

import numpy as np

from ionloom.operators import annotate, axis, chem, matrix, series


def sequential(values, tol_ppm):
    out, b, prev = [], 0, None
    for v in sorted(values):
        if prev is not None and (v - prev) / prev * 1e6 > tol_ppm:
            b += 1
        out.append((v, b))
        prev = v
    return out


def test_gap_bins_equal_sequential_rule_under_any_partitioning(spark):
    rng = np.random.default_rng(3)
    values = np.unique(np.round(rng.uniform(100, 101.5, 4000), 6)).tolist()
    values += [100.5 + i * 3e-4 for i in range(200)]
    want = sequential(set(values), 5.0)
    rows = [(v,) for v in set(values)]
    random.Random(1).shuffle(rows)
    for parts in (1, 17):
        df = spark.createDataFrame(rows, "mz double").repartition(parts)
        got = sorted((r["mz"], r["bin"]) for r in axis.assign_bins(df, "mz", 5.0).collect())
        assert got == want


def test_plans_hold_no_cartesian_or_nested_loop(spark):
    p = spark.createDataFrame([("s", "p", 100.0, 1.0)], "sample_item_id string, peak_id string, mz double, height double")
    ledger = spark.createDataFrame([(100.0, "C1", "a", "Assigned")], "mz double, neutral_formula string, adduct string, tier string")
    plan = annotate.annotate_peaks(p, ledger)._jdf.queryExecution().toString()
    plan += matrix.matrix_cells(matrix.binned_peaks(p))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_two_tracks_anchor_to_ledger_position(spark):
    # A dim track sits on the ledger position, a slightly brighter one 1.2 mDa away.
    rows = [(f"s{i}", f"a{i}", 300.0 + 0.0001, 100.0, ) for i in range(5)]
    rows += [(f"s{i}", f"b{i}", 300.0 - 0.0012, 150.0) for i in range(5)]
    df = spark.createDataFrame(rows, "sample_item_id string, peak_id string, mz double, height double")
    ledger = spark.createDataFrame([(300.0, "X", "a", "Assigned")], "mz double, neutral_formula string, adduct string, tier string")
    out = annotate.annotate_peaks(df, ledger).toPandas()
    won = out[out["neutral_formula"].notna()]
    assert len(won) == 5 and won["peak_id"].str.startswith("a").all()
    assert out["dup_candidate"].sum() == 5


def test_offset_partners_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    pts = [("s", f"p{i}", float(m), float(h)) for i, (m, h) in enumerate(zip(rng.uniform(200, 210, 400), rng.uniform(1, 9, 400)))]
    pts += [("s", f"q{i}", m + 1.003355, h / 10) for i, (_, _, m, h) in enumerate(pts[:100])]
    df = spark.createDataFrame(pts, "sample_item_id string, peak_id string, mz double, height double")
    got = {r["peak_id"]: r["partner"]["p"] for r in chem.offset_partners(df, df, {"13C": 1.003355}).collect()}
    want = {}
    for _, pid, mz, _ in pts:
        t = mz + 1.003355
        near = [(h, m, p) for _, p, m, h in pts if abs(m - t) <= t * 8e-6]
        if near:
            want[pid] = max(near)[2]
    assert got == want


def test_chain_and_greedy(spark):
    rows = [("s", f"p{i}", 100.0 + 14.01565 * i, 1.0) for i in range(6)] + [("s", "x", 105.3, 1.0)]
    df = spark.createDataFrame(rows, "sample_item_id string, peak_id string, mz double, height double")
    chain = series.unit_chains(df, 14.01565, min_len=3).collect()
    assert sorted(r["rank"] for r in chain) == list(range(6))
    items = spark.createDataFrame(
        [("a", "r1", 1), ("a", "r2", 1), ("b", "r2", 2), ("b", "r3", 2), ("c", "r3", 3), ("d", "r9", 4)], "id string, resource string, rank int"
    )
    assert sorted(r["id"] for r in chem.greedy(items).collect()) == ["a", "c", "d"]


def test_copies_of_a_position_collapse_before_they_are_gathered(spark):
    from pyspark.sql import functions as F

    crowd = spark.range(100_000).select(
        F.lit(200.0).alias("x"), F.col("id").cast("string").alias("name"), F.rand(3).alias("h")
    )
    probes = spark.createDataFrame([(1, 200.0005), (2, 300.0)], "id int, mz double")
    got = axis.nearest(probes, crowd, "mz", "x", ["name", "h"], tol_ppm=5.0, order=("h",))
    least = crowd.orderBy("h").first()
    rows = {r["id"]: r["hit"] for r in got.collect()}
    assert rows[2] is None and rows[1]["name"] == least["name"]
    entries = crowd.groupBy("x").agg(F.min(F.struct("h", "name")).alias("f")).select("x", "f.name", "f.h")
    cells = axis.neighbourhoods(entries, axis.relative_cell(F.col("x"), 5.0, 1.01), ["x", "name", "h"])
    assert cells.agg(F.max(F.size("near"))).first()[0] == 1


def test_absolute_windows_hold_at_low_positions(spark):
    import numpy as np

    from ionloom.operators import audit

    rng = np.random.default_rng(6)
    ions = [18.03, 25.3, 33.3, 38.0, 500.1]
    rows = [(f"s{i % 5}", f"p{i}", float(m + rng.uniform(-4e-3, 4e-3)), 1.0) for i, m in enumerate(ions * 60)]
    peaks = spark.createDataFrame(rows, "sample_item_id string, peak_id string, mz double, height double")
    got = audit.raw_tracks(peaks, spark.createDataFrame([(m,) for m in ions], "mz double"), window=2.5e-3)
    want = sum(abs(r[2] - m) <= 2.5e-3 for r in rows for m in ions)
    assert got.count() == want


def test_offset_partners_shuffle_a_probe_once_and_keep_ties(spark):
    rng = np.random.default_rng(8)
    step, schema = {"up": 1.5, "down": -2.25}, "sample_item_id string, peak_id string, mz double, height double"
    # Places on a coarse lattice, so that copies, equal heights and distances at the edge are common; unset and unknown heights too.
    rows = [(f"s{i % 2}", f"p{i}", float(250 + k * 0.0005), float(h)) for i, (k, h) in enumerate(zip(rng.integers(0, 14000, 1500), rng.integers(1, 9, 1500)))]
    rows += [("s0", "none", 251.0, None), ("s0", "nan", 252.5, float("nan")), (None, "lost", 252.0, 1.0), ("s0", "nowhere", None, 1.0), ("s1", "below", -3.0, 1.0)]
    df = spark.createDataFrame(rows, schema)
    out = chem.offset_partners(df, df, step)
    assert out.columns == ["sample_item_id", "peak_id", "mz", "height", "step", "partner"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    got = {(r["sample_item_id"], r["peak_id"], r["step"]): r["partner"]["p"] for r in out.collect()}

    def order(peak):
        _, pid, mz, h = peak
        return (-1.0 if h is None else float("inf") if h != h else h, mz, pid)

    want = {}
    for s, pid, mz, _ in rows:
        for name, d in step.items() if s and mz else ():
            near = [r for r in rows if r[0] == s and r[2] and abs(r[2] - (mz + d)) <= (mz + d) * 8e-6]
            if near:
                want[s, pid, name] = max(near, key=order)[1]
    assert got == want and len(want) > 200
