import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from ionloom.llm import ngram_bloom as lm
from tests.llm.rows import none, odd, words


def _held_out(doc_id):
    return crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _base(rows):
    """Base scores by plain counting: per row (n_tokens, n_known, N, score)."""
    tokens = [[*words(r["text"]), lm.END] for r in rows]
    counts = Counter(w for r, ws in zip(rows, tokens, strict=True) if not _held_out(r["doc_id"]) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    scale = total + 0.1 * (distinct + 1)
    return [
        (len(ws), sum(counts[w] > 0 for w in ws), total, sum(math.log10((counts[w] + 0.1) / scale) for w in ws)) for ws in tokens
    ]


@pytest.mark.parametrize("frequent", [5, 1 << 17])
def test_base_scores_equal_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    rows = odd(spark).collect()
    want = {(r["doc_id"], b[0]): b for r, b in zip(rows, _base(rows), strict=True)}
    got = lm.score(odd(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base = want[(r["doc_id"], r["n_tokens"])]
        assert (r["n_known"], r["train_tokens"], r["held_out"]) == (known, total, _held_out(r["doc_id"]))
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] <= 0


def _counted(spark, hashes, counts):
    rows = [(int(h) >> 64 - lm.SEGMENT_BITS, int(h) - (1 << 64) if h >> np.uint64(63) else int(h), None, int(n)) for h, n in zip(hashes, counts, strict=True)]
    return spark.createDataFrame(rows, "s int, h long, word binary, n long").repartition("s")


def _filter(made):
    return lm.as_filter([tuple(r) for r in made.where("bits is not null").select("s", "bits").collect()])


def test_levels_come_back_from_the_first_occurrence_on(spark):
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 1 << 64, 20_000, np.uint64)
    hashes[:9000] >>= np.uint64(lm.SEGMENT_BITS)  # a segment with almost half of all
    counts = np.minimum((1 / rng.random(20_000)).astype(np.int64), 1 << 30)
    made = lm.build(_counted(spark, hashes, counts))
    found = _filter(made)
    levels, want = found.levels(hashes), np.floor(np.log2(counts)).astype(int) + 1
    assert (counts == 1).any() and (levels >= want).all() and (levels == want).mean() > 0.96
    assert (found.levels(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)) == 0).mean() > 0.96
    probes = spark.createDataFrame([(int(h.view(np.int64)),) for h in hashes[8000:12000]], "h long").distinct()
    joined = {r["h"]: r["level"] for r in lm.joined_levels(probes, made.where("bits is not null").select("s", "bits")).collect()}
    assert joined == {int(h.view(np.int64)): int(v) for h, v in zip(hashes[8000:12000], levels[8000:12000], strict=True)}


def test_the_filter_grows_with_what_it_holds(spark):
    rng = np.random.default_rng(4)
    sizes = []
    for n in (20_000, 200_000):
        hashes = np.sort(rng.integers(0, 1 << 56, n, np.uint64))  # 64 segments
        found = _filter(lm.build(_counted(spark, hashes, np.ones(n))))
        assert np.unpackbits(found.bits).mean() <= 0.41
        assert (found.levels(hashes) >= 1).all()
        sizes.append(len(found.bits))
    assert 9 <= sizes[1] / sizes[0] <= 11


def _scores(docs):
    return sorted((str(r["doc_id"]), r["n_tokens"], round(r["base_score"], 9), round(r["score"], 6)) for r in lm.score(docs).collect())


def test_a_filter_kept_as_a_table_scores_alike(spark, monkeypatch):
    docs = odd(spark).unionByName(
        spark.range(300).selectExpr("id + 100 AS doc_id", "concat('alpha beta ', id % 7, ' gamma ', id % 31) AS text"), allowMissingColumns=True
    )
    broadcast = _scores(docs)
    monkeypatch.setattr(lm, "BROADCAST_BYTES", -1)
    assert _scores(docs) == broadcast


def test_more_text_does_not_lower_the_counts_of_what_is_known(spark):
    """Pairs seen once keep their level however much else there is."""
    few = spark.range(50).selectExpr("concat('once', id, ' upon', id) AS text")
    more = few.unionByName(spark.range(5000).selectExpr("concat('other', id, ' words', id * 7, ' too', id % 11) AS text"))
    t = lm.tokenize([f"once{i} upon{i}".encode() for i in range(50)])
    for texts in (few, more):
        levels = lm.fit(texts)[0].filter.levels(t.pairs)
        assert (levels >= 1).all() and (levels[t.codes != t.distinct.index(lm.END)] == 1).mean() > 0.9


def test_probabilities_after_a_context_sum_to_at_most_one(spark):
    docs = spark.range(900).selectExpr("concat('a ', array('b', 'c', 'd', 'e')[id % 4], ' ', array('b', 'c')[id % 2]) AS text")
    model = lm.fit(docs)[0]
    for before in (b"a", b"b", b"c"):
        total = 0.0
        for word in (b"a", b"b", b"c", b"d", b"e", lm.END):
            t = lm.tokenize([before if word == lm.END else before + b" " + word])
            total += 10 ** model.logs(t)[1]
        assert total <= 1.0


def test_pairs_help_on_held_out_texts(spark):
    docs = spark.range(600).selectExpr("id AS doc_id", "concat('alpha beta gamma delta ', id % 7, ' omega beta alpha') AS text")
    held = lm.score(docs).where("held_out").collect()
    assert held and all(r["score"] > r["base_score"] for r in held)


def test_nothing_to_learn_from(spark):
    assert lm.score(none(spark)).count() == 0
    only = next(i for i in range(1000) if _held_out(i))
    r = lm.score(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)


def test_runs_read_in_pieces_score_alike(spark, monkeypatch):
    """A run may come back from its files in several batches; no table holds a row per pair of a text."""
    docs = spark.range(200, numPartitions=3).selectExpr("id AS doc_id", "concat('alpha beta ', id % 7, ' gamma ', id % 31) AS text")
    want, labels, kept = _scores(docs), [], lm.written
    monkeypatch.setattr(lm, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(lm, "written", lambda df, label: labels.append(label) or kept(df, label))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert _scores(docs) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not {"lm-pairs", "lm-distinct"} & set(labels)
