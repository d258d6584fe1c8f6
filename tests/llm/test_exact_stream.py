import re
from collections import defaultdict

from pyspark.sql import functions as F

from ionloom.llm import exact_stream
from tests.llm.rows import none, odd


def _lowered(text):
    return (text or "").encode().lower()


def _expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[_lowered(r["text"])].append(r["doc_id"])
    return {k: (max((i for i in v if i is not None), default=None), len(v)) for k, v in groups.items()}


def test_groups_equal_brute_force(spark):
    rows = odd(spark).collect()
    want = _expected(rows)
    got = exact_stream.deduplicate(odd(spark)).collect()
    assert len(got) == len(rows)
    assert sum(r["kept"] for r in got) == len(want)
    by_id = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got if r["doc_id"] is not None}
    assert by_id == {r["doc_id"]: want[_lowered(r["text"])] for r in rows if r["doc_id"] is not None}


def test_clashing_digests_are_told_apart_by_bytes(spark):
    rows = odd(spark).collect()
    want = _expected(rows)
    weak = exact_stream.deduplicate(odd(spark), digest=lambda t: (F.length(t) % 2).cast("string").cast("binary"))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in weak.collect() if r["doc_id"] is not None}
    assert got == {r["doc_id"]: want[_lowered(r["text"])] for r in rows if r["doc_id"] is not None}


def test_many_micro_batches_share_the_state(spark):
    docs = odd(spark)
    few = exact_stream.deduplicate(docs, files_per_batch=1).select("doc_id", "keep_id", "group_size").collect()
    one = exact_stream.deduplicate(docs).select("doc_id", "keep_id", "group_size").collect()
    assert sorted(map(str, few)) == sorted(map(str, one))


def test_by_default_the_state_is_met_again(spark):
    digests = spark.range(0, 400, 1, 8).select(
        F.unhex(F.sha2((F.col("id") % 50).cast("string"), 256)).alias("digest"), F.col("id").alias("doc_id"), F.lit("f").alias("file"), F.col("id").alias("row")
    )
    got = exact_stream.remember(digests)
    assert {(r["group_size"], r["holder"]["doc_id"] % 50) for r in got.collect()} == {(8, k) for k in range(50)}
    assert got.count() == 50
    parts = {re.search("batch=([0-9]+)", f)[1] for f in got.inputFiles()}
    assert len(parts) == exact_stream.BATCHES


def test_keep_one_returns_whole_rows(spark):
    docs = odd(spark)
    kept = exact_stream.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [_lowered(r["text"]) for r in kept.collect()]
    assert sorted(texts) == sorted(_expected(docs.collect()))


def test_empty_table(spark):
    assert exact_stream.deduplicate(none(spark)).count() == 0
    assert exact_stream.keep_one(none(spark)).count() == 0
