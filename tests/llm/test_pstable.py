import numpy as np
import pytest
from pyspark.sql import functions as F

from ionloom.llm import pstable

SCHEMA = "vec_id long, embedding array<float>, rank int, score string, cid long, v int, grp string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x", 1, 2, "g") for i, v in rows], SCHEMA)


def _brute(rows, every, nearest=5):
    ids = [i for i, _ in rows]
    unit = np.array([np.float32(v) for _, v in rows], np.float64)
    norms = np.sqrt((unit**2).sum(axis=1))
    out = {}
    for a, i in enumerate(ids):
        if i % every == 0:
            score = unit @ unit[a] / (norms * norms[a])
            order = sorted((b for b in range(len(ids)) if ids[b] != i), key=lambda b: (-round(score[b], 12), ids[b]))
            out[i] = [(ids[b], score[b]) for b in order[:nearest]]
    return out


def _found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(10, 32))
    rows = [(i, (centres[i % 10] + rng.normal(size=32) * 1.5).tolist()) for i in range(3000)]
    got, want = _found(pstable.search(_frame(spark, rows), F.col("vec_id") % 50 == 0)), _brute(rows, 50)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    scores = {q: dict(v) for q, v in want.items()}
    assert all(s == pytest.approx(scores[q][v], abs=1e-12) for q, near in got.items() for v, s in near if v in scores[q])


def test_equal_vectors_and_ties(spark):
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(120)] + [(200, [1.0, 2.0, 0.4]), (250, [-1.0, 3.0, -1.0])]
    got = _found(pstable.search(_frame(spark, rows), F.col("vec_id") % 50 == 0))
    assert [v for v, _ in got[0]] == [1, 2, 3, 4, 5]
    assert [v for v, _ in got[50]] == [0, 1, 2, 3, 4]
    assert [v for v, _ in got[200]] == [0, 1, 2, 3, 4]
    assert [v for v, _ in got[250]] == [200, 0, 1, 2, 3]


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (50, None), (100, [0.0, 0.0]), (150, [1.0, nan]), (200, [inf, 1.0]), (250, [1.0, None])]
    rows += [(300, []), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (350, [1.0, 2.0, 3.0])]
    got = _found(pstable.search(_frame(spark, rows), F.col("vec_id") % 50 == 0))
    assert {q: [v for v, _ in near] for q, near in got.items()} == {0: [1]}
    assert pstable.search(_frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_probe_order_is_by_distance_to_the_walls():
    place = np.array([3.1, -2.4, 0.7])
    cells = pstable.probes(place, 40)
    assert cells[0].tolist() == [3, -3, 0]

    def cost(cell):
        gap = np.where(cell > place, cell - place, np.where(cell + 1 < place, place - cell - 1, 0.0))
        return (gap**2).sum()

    costs = [cost(c) for c in cells]
    assert np.allclose(costs, sorted(costs))
    assert len({tuple(c) for c in cells.tolist()}) == 40


def test_a_crowded_group_is_split(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    whole = _found(pstable.search(_frame(spark, rows), F.col("vec_id") % 50 == 0))
    monkeypatch.setattr(pstable, "GROUP_ROWS", 20)
    assert _found(pstable.search(_frame(spark, rows), F.col("vec_id") % 50 == 0)) == whole


def test_recall_holds_with_many_projections(spark, monkeypatch):
    """17 projections, as some two million vectors have them."""
    monkeypatch.setattr(pstable, "OFFSET", -6)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(2000)]
    got, want = _found(pstable.search(_frame(spark, rows), F.col("vec_id") % 50 == 0)), _brute(rows, 50)
    hits = sum(len({v for v, _ in got.get(q, [])} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def test_hot_groups_are_ranked_exactly(spark):
    rng = np.random.default_rng(6)
    base, other = rng.normal(size=16).astype(np.float32), rng.normal(size=16)
    rows = [(1000 - i, (base * (i + 1)).tolist()) for i in range(40)]  # some multiples round to another direction
    rows += [(2000 + i, (np.float32([1, -3, 5, 7]) * (60 - i)).tolist() + [0.0] * 12) for i in range(50)]
    rows += [(3000 + i, (other + rng.normal(size=16) * 1e-4).tolist()) for i in range(600)]
    got, want = _found(pstable.search(_frame(spark, rows), F.col("vec_id") % 50 == 0)), _brute(rows, 50)
    for q in want:
        assert len(got[q]) == 5
        if q >= 3000:
            assert [v for v, _ in got[q]] == [v for v, _ in want[q]]
    assert [v for v, _ in got[2000]] == [2001, 2002, 2003, 2004, 2005]
