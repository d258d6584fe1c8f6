import numpy as np

from ionloom.operators import factor, families, traces


def brute_complete(names, dist, cut):
    groups = [[i] for i in range(len(names))]
    while True:
        best = None
        for x in range(len(groups)):
            for y in range(x + 1, len(groups)):
                d = max(dist[i][j] for i in groups[x] for j in groups[y])
                if d <= cut and (best is None or d < best[0]):
                    best = (d, x, y)
        if best is None:
            return sorted(sorted(names[i] for i in g) for g in groups)
        _, x, y = best
        groups[x] += groups.pop(y)


def test_complete_linkage_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(4, 40))
    data = np.vstack([base[i % 4] + rng.normal(scale=0.5, size=40) for i in range(18)])
    r = np.corrcoef(data)
    names = [f"c{i:02d}" for i in range(18)]
    pairs = [(names[i], names[j], float(r[i, j])) for i in range(18) for j in range(i + 1, 18)]
    got = families.complete_linkage(
        spark.createDataFrame([(n,) for n in names], "channel string"), spark.createDataFrame(pairs, "a string, b string, r double"), 0.4
    ).toPandas()
    out = sorted(sorted(g["channel"]) for _, g in got.groupby("cluster"))
    assert out == brute_complete(names, 1 - r, 0.4)


def test_pairwise_r_in_small_blocks(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(9, 30))
    rows = [(f"c{c}", t, float(data[c, t])) for c in range(9) for t in range(30) if (c + t) % 5]
    df = spark.createDataFrame(rows, "channel string, t long, g double")
    got = {(r["a"], r["b"]): r["r"] for r in traces.pairwise_r(df, "g", block_channels=2, block_points=7).collect()}
    assert len(got) == 36
    for (a, b), v in got.items():
        i, j = int(a[1:]), int(b[1:])
        ok = [t for t in range(30) if (i + t) % 5 and (j + t) % 5]
        assert abs(v - np.corrcoef(data[i, ok], data[j, ok])[0, 1]) < 1e-9


def test_factorisation_lowers_q_and_normalises(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0.1, 1, (12, 2)) @ rng.uniform(0.1, 1, (2, 8))
    rows = [(f"s{i}", j, float(x[i, j]), 0.1) for i in range(12) for j in range(8)]
    cells = spark.createDataFrame(rows, "sample_item_id string, bin long, x double, sigma double")
    g, h, history = factor.wnmf(cells, 2, n_iter=7, check_every=3)
    assert history == sorted(history, reverse=True)
    sums = h.groupBy("f").sum("v").toPandas()["sum(v)"]
    np.testing.assert_allclose(sums, 1.0, rtol=1e-6)
