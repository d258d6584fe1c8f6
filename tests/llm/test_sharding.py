from collections import Counter, defaultdict
from zlib import crc32

from pyspark.sql import functions as F

from ionloom.llm import sharding
from tests.llm.rows import none, odd


def _check(docs, shards):
    rows = sharding.shard(docs, shards).collect()
    source = docs.collect()
    assert len(rows) == len(source)
    counts = Counter(r["shard"] for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(source)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return rows


def test_balanced_and_described(spark):
    rows = _check(odd(spark), 4)
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, crc32((r["text"] or "").encode())) for r in odd(spark).collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts


def test_groups_stay_together_around_a_hot_one(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("g"), F.floor(F.col("id") / 12)))
        .otherwise(F.concat(F.lit("u"), "id")).alias("text"),
    )
    rows = _check(docs, 10)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    where = defaultdict(Counter)
    for r in rows:
        where[text[r["doc_id"]]][r["shard"]] += 1
    groups = [v for k, v in where.items() if k.startswith("g")]
    whole = sum(len(v) == 1 for v in groups)
    assert whole >= 0.95 * len(groups)
    # The hot group needs four of the ten shards and does not spread over all of them evenly.
    assert sorted(where["hot"].values(), reverse=True)[0] > 1.5 * sum(where["hot"].values()) / 10


def test_empty_table(spark):
    assert sharding.shard(none(spark), 4).count() == 0
