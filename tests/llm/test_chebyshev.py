from collections import Counter

import numpy as np
import pytest

from ionloom.llm import chebyshev
from tests.llm.vector_rows import frame, rows, usable


def _brute(kept, components):
    """Whitened rows, shares and exact deviations by a dense eigendecomposition."""
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in v] for _, v, _ in kept])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    centred = fit - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = (x - total / n) @ vectors[:, :components] / np.sqrt(values[:components])
    deviation = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(r, total)) for r in x]
    return n, white, values[:components] / values.sum(), deviation


@pytest.mark.parametrize(("width", "components"), [(8, 3), (48, 16)])
def test_whitening_equals_a_dense_decomposition(spark, width, components, monkeypatch):
    monkeypatch.setattr(chebyshev, "GUARD", 2 if width == 8 else 16)  # blocks narrower than the space
    given = rows(width)
    kept = usable(given, width)
    n, white, explained, deviation = _brute(kept, components)
    got = chebyshev.whiten(frame(spark, given), components).collect()
    assert len(got) == len(kept) * components
    assert {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-9
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == Counter(
        (k[0], d) for k, d in zip(kept, deviation, strict=True)
    )
    for c in range(components):
        mine = {r["vec_id"]: r["whitened"] for r in got if r["component"] == c + 1}
        assert abs({r["explained"] for r in got if r["component"] == c + 1}.pop() / explained[c] - 1) < 1e-10
        pairs = np.array([(mine[k[0]], w) for k, w in zip(kept, white[:, c], strict=True)])
        assert min(abs(pairs[:, 0] - pairs[:, 1]).max(), abs(pairs[:, 0] + pairs[:, 1]).max()) < 1e-7


def test_filter_damps_only_the_unwanted():
    values = np.array([10.0, 8.0, 6.0, 5.0, 3.0, 1.0])
    q = np.eye(6)
    out = np.diag(chebyshev.filtered(lambda b: values[:, None] * b, q, values[:, None] * q, 1.0, 5.0, 10.0))
    assert abs(out[0] - 1) < 1e-12
    assert (np.abs(np.diff(np.abs(out[:3]))) > 0).all() and np.abs(out[3:]).max() <= np.abs(out[2]) / 1000


def test_no_variance_and_empty_tables(spark):
    assert chebyshev.whiten(frame(spark, [])).count() == 0
    assert chebyshev.whiten(frame(spark, [(1, None, 1), (2, [], 1)])).count() == 0
    assert chebyshev.whiten(frame(spark, [(i, [1.0, 2.0], 1) for i in range(5)])).count() == 0


def test_few_distinct_vectors_have_few_components(spark):
    given = [(i, [float(i % 3), 2.0 * (i % 3), 0.0, 1.0], 0) for i in range(30)]
    got = chebyshev.whiten(frame(spark, given)).collect()
    assert len(got) == 30
    assert {(r["component"], r["n"]) for r in got} == {(1, 3)}
    assert abs(got[0]["explained"] - 1) < 1e-12


def test_deviations_beyond_a_long_are_null():
    x = np.array([[1 << 40, 0], [3, 4]])
    assert chebyshev.deviations(x, 10, np.zeros(2, np.int64), np.array([1, 2], object)) == [None, 29**2 + 38**2]


def test_partial_sums_of_many_partitions(spark, monkeypatch):
    x = frame(spark, rows(6, 300)).where("vec_id < 300 and vec_id > 5").selectExpr("transform(embedding, c -> floor(64 * double(c))) AS x")
    fit = chebyshev.fit_list(x)
    whole = chebyshev.times_covariance(fit, np.eye(6))
    monkeypatch.setattr(chebyshev, "PARTIALS", 1)
    many = chebyshev.Fit(fit.blocks.repartition(3), fit.n, fit.sums)
    assert np.allclose(chebyshev.times_covariance(many, np.eye(6)), whole, rtol=1e-12)
