"""Resembling documents against five-word Jaccard similarity, pair by pair."""

import itertools
import random

import numpy as np

from ionloom.llm import resembling
from tests.llm.rows import none, odd, words


def shingles(text):
    w = words(text)
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else {b""}


def similarity(a, b):
    return len(a & b) / len(a | b)


def _corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(120, 400))) for _ in range(150)]
    for base in list(texts[:60]):  # copies with a few words replaced, at similarities from 0.6 to 1
        for _ in range(3):
            w = base.split()
            for _ in range(rng.randint(1, max(1, len(w) // 22))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
    hot = texts[0].split()
    for _ in range(150):  # a large group
        w = list(hot)
        w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    return texts


def test_pairs_of_similar_texts_meet(spark):
    texts = _corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    group = {r["doc_id"]: r["component_id"] for r in resembling.grouped(docs).collect()}
    assert sorted(group) == list(range(len(texts)))
    sets = [shingles(t) for t in texts]
    pairs = [(similarity(sets[a], sets[b]), a, b) for a, b in itertools.combinations(range(len(texts)), 2)]
    similar = [(a, b) for s, a, b in pairs if s >= 0.8]
    assert len(similar) > 5000 and sum(group[a] == group[b] for a, b in similar) / len(similar) >= 0.95
    alone = [(a, b) for s, a, b in pairs if s >= 0.8 and max(a, b) < 330]  # outside the large group
    assert len(alone) > 50 and sum(group[a] == group[b] for a, b in alone) / len(alone) >= 0.9
    near = {i for s, a, b in pairs if s >= 0.5 for i in (a, b)}
    assert all(group[i] == i for i in range(len(texts)) if i not in near)
    assert all(group[i] <= i for i in group)


def test_signatures_tell_the_similarity():
    rng = random.Random(5)
    for share in (0.0, 0.02, 0.04):
        w = [f"x{rng.randrange(9999)}" for _ in range(4000)]
        other = [f"y{i}" if rng.random() < share else t for i, t in enumerate(w)]
        a, b = " ".join(w).encode(), " ".join(other).encode()
        bits = int(np.bitwise_count((resembling.signature(a) ^ resembling.signature(b)).view(np.uint64)).sum())
        s = similarity(shingles(a.decode()), shingles(b.decode()))
        assert abs(bits / 320 - np.arccos(2 * s / (1 + s)) / np.pi) < 0.06


def test_buckets_that_go_on_in_the_next_batch(spark, monkeypatch):
    same = [(i, "the same words again and again in a text of some length " * 3 + str(i % 2)) for i in range(300)]
    docs = spark.createDataFrame(same, "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        groups = {r["component_id"] for r in resembling.grouped(docs).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(groups) <= 2 and 0 in groups


def test_awkward_rows(spark):
    docs = odd(spark)
    kept = resembling.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    # 1, 2, 3 are one text but for case; 6, 7, 8 and a null row have no words; 9 and 10 are one text.
    assert got == [(False, i) for i in (1, 4, 5, 6, 9, 11, 12, 13, 14, 15)] + [(True, 0)]


def test_empty_table(spark):
    assert resembling.grouped(none(spark)).count() == 0
    assert resembling.keep_one(none(spark)).count() == 0


def _alike_in_one_segment_pair(seed=8, n=700):
    """Fingerprints that share the segments of the first table and hardly any other, some of them in close pairs and chains."""
    rng = np.random.default_rng(seed)
    bits = rng.integers(0, 2, (n, 320), dtype=np.uint8)
    bits[:, :46] = bits[0, :46]
    for a, b in [(i, n - 1 - i) for i in range(0, 200, 2)] + [(i, i + 2) for i in range(200, 260, 2)]:
        # 48 bits differ, 18 of them in the first lane and some in every segment of the other tables
        at = np.r_[46 + rng.permutation(18), 64 + np.arange(30) * 8 + rng.integers(0, 8, 30)]
        bits[b] = bits[a]
        bits[b, at] ^= 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def _components(lanes):
    group = list(range(len(lanes)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(lanes)):
        bits = np.bitwise_count((lanes[a] ^ lanes[a + 1 :]).view(np.uint64)).sum(axis=1)
        for b in np.flatnonzero(bits <= resembling.MOST_BITS) + a + 1:
            low, high = sorted((top(a), top(int(b))))
            group[high] = low
    return [top(i) for i in range(len(lanes))]


def test_no_pair_of_a_large_bucket_is_left_out(spark):
    lanes = _alike_in_one_segment_pair()
    rows = [(i, i, "f", i, *map(int, x)) for i, x in enumerate(lanes)]
    schema = "uid long, doc_id long, _ion_file string, _ion_row long, " + ", ".join(f"lane{i} long" for i in range(5))
    marks = spark.createDataFrame(rows, schema)
    want = _components(lanes)
    assert len(set(want)) < 600
    assert {r["uid"]: r["root"] for r in resembling.roots(marks).collect()} == dict(enumerate(want))


def test_cut_buckets_lose_no_link(spark):
    lanes = np.concatenate([_alike_in_one_segment_pair(9, 300), _alike_in_one_segment_pair(10, 300)])
    one = np.unpackbits(lanes[-1:].view(np.uint8), axis=1, bitorder="little")
    rng = np.random.default_rng(1)
    for _ in range(200):  # a large group
        bits = one.copy()
        bits[0, rng.integers(46, 320, 20)] ^= 1
        lanes = np.concatenate([lanes, np.packbits(bits, axis=1, bitorder="little").view(np.int64)])
    marks = spark.createDataFrame([(i, *map(int, x)) for i, x in enumerate(lanes)], "uid long, " + ", ".join(f"lane{i} long" for i in range(5)))
    want = dict(enumerate(_components(lanes)))
    for most_rows in (1 << 16, 90, 23):
        assert {r["uid"]: r["root"] for r in resembling.roots(marks, most_rows).collect()} == want
