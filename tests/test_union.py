"""Assigned and unassigned channels clustered together: planted families, and the floor of the pair table."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ionloom.operators import batch
from ionloom.operators import traces as tr

START = datetime(2024, 1, 1)
HEADS = {0: (200.0, "a"), 1: (250.0, "a"), 2: (300.0, "a"), 3: (350.0, "b"), 4: (400.0, "b"), 5: (450.0, "b")}


def _wave(kind: str, t: int) -> float:
    return math.sin(t / 2.3) if kind == "a" else math.cos(t / 0.9)


@pytest.fixture(scope="module")
def parts(spark):
    cells = [(f"s{t:02d}", b, 1000.0 * 10 ** (0.4 * _wave(k, t) + 0.002 * ((t * 7 + b) % 5))) for b, (_, k) in HEADS.items() for t in range(30)]
    return (
        spark.createDataFrame(cells, "sample_item_id string, bin long, height double"),
        spark.createDataFrame([(b, mz) for b, (mz, _) in HEADS.items()], "bin long, bin_mz double"),
        # Two ions want bin 0 and the nearer one names it; one ion has no bin.
        spark.createDataFrame(
            [("A", "x", 200.0001), ("A", "y", 200.0008), ("B", "x", 350.0), ("C", "x", 999.0)], "neutral_formula string, adduct string, mz double"
        ),
        spark.createDataFrame([(f"s{t:02d}", START + timedelta(hours=t)) for t in range(30)], "sample_item_id string, datetime_utc timestamp"),
    )


def test_union_holds_each_bin_once_and_finds_planted_families(spark, parts):
    cells, bins, ledger, clock = parts
    assigned = batch.assigned_traces(cells, bins, ledger, clock)
    assert {(r[0], r[1]) for r in assigned.select("channel", "label").distinct().collect()} == {("200.0000", "A x"), ("350.0000", "B x")}
    gates = batch.bin_gates(cells, bins, ledger.select("mz"))
    traces = batch.union_traces(assigned, cells, gates, clock)
    named = {"200.0000", "350.0000", "?250.0000", "?300.0000", "?400.0000", "?450.0000"}
    assert traces.count() == 180 and {r[0] for r in traces.select("channel").distinct().collect()} == named
    grid = batch.union_grid(traces)
    assert grid.count() == 180 and grid.agg(F.max("t"), F.max("hours")).first()[:] == (29, pytest.approx(29.0))
    labels = traces.groupBy("channel").agg(F.min("label").alias("label"))
    got = {r["channel"]: r for r in batch.batch_families(grid, labels).collect()}
    assert set(got) == named
    for own in ({"200.0000", "?250.0000", "?300.0000"}, {"350.0000", "?400.0000", "?450.0000"}):
        assert len({got[c]["cluster"] for c in own}) == 1
    assert got["200.0000"]["cluster"] != got["350.0000"]["cluster"]
    assert got["?250.0000"]["cluster_label"] == "co-varies with A x" and got["?450.0000"]["cluster_label"] == "co-varies with B x"


def test_repeated_and_missing_times(spark):
    rows = [("a", None, START, 1.0), ("a", None, START, 3.0), ("b", None, START + timedelta(days=3), 2.0)]
    traces = spark.createDataFrame(rows, "channel string, label string, datetime_utc timestamp, y double")
    got = {(r["channel"], r["t"]): (r["hours"], r["y"]) for r in batch.union_grid(traces).collect()}
    assert got == {("a", 0): (0.0, 3.0), ("a", 1): (72.0, None), ("b", 0): (0.0, None), ("b", 1): (72.0, 2.0)}
    assert batch.union_grid(traces.limit(0)).count() == 0


def test_floor_of_pairs_only_filters(spark, parts):
    cells, *_ = parts
    rows = cells.select(F.col("bin").alias("channel"), F.substring("sample_item_id", 2, 2).cast("long").alias("t"), F.log10("height").alias("g"))
    every = {(r["a"], r["b"]): r["r"] for r in tr.pairwise_r(rows, "g").collect()}
    some = {(r["a"], r["b"]): r["r"] for r in tr.pairwise_r(rows, "g", least_r=0.5).collect()}
    assert len(every) == 15 and some.keys() == {k for k, v in every.items() if v >= 0.5} and len(some) == 6
