from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from ionloom.llm import quality
from tests.llm.rows import none, odd

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).join(labels, "doc_id").select("doc_id", "score", "predicted", "quality").collect()
    held = [r for r in rows if crc32(str(r["doc_id"]).encode()) % 4 == 2]
    right = sum(r["predicted"] == r["quality"] for r in held) / len(held)
    assert right >= 0.93
    assert all((r["score"] >= 0.7) == bool(r["predicted"]) for r in rows)


def test_held_out_rows_are_not_learned_from(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("x y").alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    ids = [r["id"] for r in quality.sample(docs, labels).collect()]
    assert sorted(ids) == [i for i in range(200) if crc32(str(i).encode()) % 4 != 2]
    assert quality.sample(docs, labels, most=7).count() == 7


def _bag_by_hand(text):
    """Feature counts by plain slicing, as hashable parts."""
    words = text.split()
    return len(words) + max(0, len(words) - 1) + sum(max(0, len(text) - n + 1) for n in quality.GRAMS)


def test_features_do_not_depend_on_neighbours():
    texts = [b"", b"one", b"one one two", b"  lead and trail ", "été ünder".encode(), b"\t\n", b"x" * 50, b"one"]
    together = quality.features(texts)
    for i, text in enumerate(texts):
        alone = quality.features([text])
        count = 0
        for (b1, s1, e1), (b2, s2, e2) in zip(zip(*together, strict=True), zip(*alone, strict=True), strict=True):
            assert b1[s1[i] : e1[i]].tolist() == b2[s2[0] : e2[0]].tolist()
            count += e2[0] - s2[0]
        assert count == _bag_by_hand(text)


def test_folded_scores_equal_the_network():
    texts, labels = [b"good words here", b"BAD!! BAD!!", b"more good words", b"JUNK!! BAD!!"] * 5, [1, 0, 1, 0] * 5
    model = quality.train(texts, labels, epochs=30)
    scores = model.scores(texts)
    assert ((scores > 0.5) == np.array(labels, bool)).all()
    for text, score in zip(texts[:4], scores, strict=False):
        buckets, weights = quality._bag(text)
        assert np.isclose(score, 1 / (1 + np.exp(-(model.table[buckets] @ weights + model.bias))), rtol=1e-5)


def test_awkward_rows(spark):
    labels = odd(spark).select("doc_id", F.lit(None).cast("int").alias("quality"))
    model = quality.fit(odd(spark), labels)
    got = quality.score(odd(spark), model)
    assert got.count() == odd(spark).count() and {r["score"] for r in got.collect()} == {0.5}
    assert quality.score(none(spark), model).count() == 0
