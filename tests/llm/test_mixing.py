from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ionloom.llm import mixing
from tests.llm.rows import TEXTS, none, odd, words


def _targets(sizes):
    """Shares by weight; what is above its limit stops there and the rest is shared anew."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1.0 + i % 3 for i, s in enumerate(names)}
    limit = {s: 3.0 * sizes[s] for s in names}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > limit[s]]
        if not over:
            out |= {s: level * weight[s] for s in free}
            break
        for s in over:
            out[s] = limit[s]
            left -= limit[s]
            free.discard(s)
    return out


def test_targets_and_taken(spark):
    sizes = defaultdict(int)
    for _, text, source in TEXTS:
        sizes[source] += len(words(text))
    want = _targets(sizes)
    rows = mixing.curriculum(odd(spark)).join(odd(spark).select("doc_id", "source").distinct(), "doc_id").collect()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
    every = mixing.curriculum(odd(spark)).groupBy("key").agg(F.sum("taken").alias("n"), F.first("target").alias("t"))
    for r in every.collect():
        assert abs(r["n"] - r["t"]) <= 1


def test_hot_source_and_rerun(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.expr("repeat('w ', cast(id % 17 as int))").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
    )
    first, again = (mixing.curriculum(docs.repartition(n)).select("doc_id", "taken", "position").collect() for n in (2, 7))
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, again), key=str)


def test_positions_meet_the_demand(spark):
    schedule = ((0.0, 0.0), (0.25, 2.0), (1.0, 0.5))
    us = [i / 200 for i in range(201)]
    got = spark.createDataFrame([(u,) for u in us], "u double").select(mixing.position(F.col("u"), schedule).alias("t"))
    times = [r["t"] for r in got.collect()]
    assert times[0] == 0 and times[-1] == pytest.approx(1) and times == sorted(times)

    def demand(t):
        if t <= 0.25:
            return 4 * t * t
        x = t - 0.25
        return 0.25 + 2 * x - x * x

    total = demand(1.0)
    for u, t in zip(us, times, strict=True):
        assert demand(t) / total == pytest.approx(u, abs=1e-9)


def test_mixed_rows_are_sorted_copies(spark):
    docs = odd(spark)
    plan = mixing.curriculum(docs).select("doc_id", "copies").collect()
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in plan:
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +want


def test_empty_table(spark):
    assert mixing.curriculum(none(spark)).count() == 0
    assert mixing.mixed(none(spark)).count() == 0
