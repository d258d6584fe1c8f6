import itertools
import random

import numpy as np
import xxhash

from ionloom.llm import golay
from ionloom.llm.components import components
from tests.llm.rows import none, odd, words


def _fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(marks):
    """marks: list of (doc_id, fingerprint); the smallest id reachable over links."""
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(marks)), 2):
        if (marks[i][1] ^ marks[j][1]).bit_count() <= 2:
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(marks):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(marks))]


def test_codewords_are_shared_up_to_two_errors():
    tables = golay.decoding()
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 23, 400)
    for errors in itertools.chain([()], itertools.combinations(range(23), 1), itertools.combinations(range(23), 2)):
        other = base ^ sum(1 << e for e in errors)
        a, b = golay.codewords(base, tables), golay.codewords(other, tables)
        assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).all()


def test_fingerprints_and_components(spark):
    rows = odd(spark).collect()
    got = golay.near_duplicates(odd(spark)).collect()
    marks = [(r["doc_id"], _fingerprint(r["text"])) for r in rows]
    want = {(d, f): c for (d, f), c in zip(marks, _components(marks), strict=True)}
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want[(r["doc_id"], r["fp"] & (1 << 64) - 1)]


def _links(spark, marks):
    frame = spark.createDataFrame([(m - (1 << 64) if m >> 63 else m,) for m in marks], "fp long")
    roots = {r["u"]: r["root"] for r in components(golay.links(frame)).collect()}
    return [roots.get(m - (1 << 64) if m >> 63 else m, m - (1 << 64) if m >> 63 else m) for m in marks]


def test_dense_clusters_lose_no_link(spark):
    rng = random.Random(5)
    marks = set()
    for _ in range(6):
        walk = rng.getrandbits(64)
        for _ in range(150):  # crowded buckets, beyond the size that is paired
            marks.add(walk ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
            if rng.random() < 0.1:
                walk ^= 1 << rng.randrange(64)
    marks |= {rng.getrandbits(64) for _ in range(200)}
    marks = sorted(marks)
    want = _components([(i, m) for i, m in enumerate(marks)])
    got = _links(spark, marks)
    same = {}
    assert all(same.setdefault(a, b) == b for a, b in zip(want, got, strict=True))
    assert len(set(want)) == len(set(got))


def test_keep_one(spark):
    docs = odd(spark)
    kept = golay.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {r["component_id"] for r in golay.near_duplicates(docs).collect()}
    assert kept.count() == len(groups)


def test_empty_table(spark):
    assert golay.near_duplicates(none(spark)).count() == 0
    assert golay.keep_one(none(spark)).count() == 0
