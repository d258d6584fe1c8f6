"""The pipeline, stage by stage, against brute force on the smallest tables and on awkward rows."""

import hashlib
from collections import defaultdict
from itertools import combinations

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ionloom.llm import quality
from tests.llm.rows import none, odd, words
from tests.llm.test_mixing import _targets
from tests.llm.test_resembling import shingles, similarity

DATA = "/root/testdata/sf0.001"
NAMES = [name for name, _ in corpus_pipeline.STAGES]


def _lowered(text):
    return (text or "").encode().lower()


def _run(spark, tmp_path, docs, data=DATA):
    """Rows before and after each stage."""
    docs.write.parquet(f"{tmp_path}/start")
    docs, out = spark.read.parquet(f"{tmp_path}/start"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, data)
        if name != NAMES[-1]:
            assert after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        out.append((name, docs.collect(), after.collect()))
        docs = after
    return out


def _check(steps, model):
    public = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    key = lambda r: (str(r["doc_id"]), r["text"] or "")
    for name, before, after in steps:
        if name == "quality":
            scores = model.scores([(r["text"] or "").encode() for r in before])
            want = [r for r, s in zip(before, scores, strict=True) if s >= quality.THRESHOLD]
            assert sorted(map(key, after)) == sorted(map(key, want))
        elif name == "exact_dedup":
            best = {}
            for r in before:
                k = _lowered(r["text"])
                if k not in best or (r["doc_id"] is not None and (best[k]["doc_id"] is None or r["doc_id"] > best[k]["doc_id"])):
                    best[k] = r
            assert sorted(map(key, after)) == sorted(map(key, best.values()))
        elif name == "near_dedup":
            sets = [shingles(r["text"]) for r in before]
            near = [(similarity(sets[a], sets[b]), a, b) for a, b in combinations(range(len(before)), 2)]
            kept = sorted(map(key, after))
            some = {i for s, a, b in near if s >= 0.5 for i in (a, b)}
            assert all(key(r) in kept for i, r in enumerate(before) if i not in some)
            copies = [(a, b) for s, a, b in near if s >= 0.9 and key(before[a]) != key(before[b])]
            assert not any(key(before[a]) in kept and key(before[b]) in kept for a, b in copies)
            assert set(kept) <= set(map(key, before))
        elif name == "mixing":
            sizes, taken = defaultdict(int), defaultdict(int)
            longest = defaultdict(int)
            for r in before:
                n = len(words(r["text"]))
                sizes[r["source"]] += n
                longest[r["source"]] = max(longest[r["source"]], n)
            for r in after:
                taken[r["source"]] += len(words(r["text"]))
            for source, target in _targets(sizes).items():
                assert abs(taken[source] - target) <= longest[source] / 2 + 1
        else:
            texts = defaultdict(list)
            for r in before:
                texts[r["doc_id"]].append(r["text"] or "")
            assert len(after) == len(before)
            for r in after:
                assert r["n_tokens"] == len(r["token_ids"])
                assert public.decode(r["token_ids"], skip_special_tokens=False) in texts[r["doc_id"]]
                assert r["decoded_sha256"] in {hashlib.sha256(t.encode()).hexdigest() for t in texts[r["doc_id"]]}
                if r["n_tokens"]:
                    text = public.decode(r["token_ids"], skip_special_tokens=False)
                    assert public.encode(text, add_special_tokens=False).ids == r["token_ids"]


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    steps = _run(spark, tmp_path, docs)
    _check(steps, model)
    assert len(steps[0][2]) < len(steps[0][1]) and len(steps[1][2]) < len(steps[1][1])
    run = corpus_pipeline.run(spark, DATA)
    assert sorted(map(str, run.collect())) == sorted(map(str, steps[-1][2]))


def _labelled(spark, tmp_path, docs):
    data = f"{tmp_path}/data"
    labels = docs.where("doc_id is not null").select("doc_id", F.lit(1).alias("quality")).distinct()
    labels.write.parquet(f"{data}/labels.parquet")
    return data


def test_awkward_rows(spark, tmp_path):
    docs = odd(spark)
    data = _labelled(spark, tmp_path, docs)
    model = quality.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    _check(_run(spark, tmp_path, docs, data), model)


def test_empty_table(spark, tmp_path):
    data = _labelled(spark, tmp_path, none(spark))
    assert [len(after) for _, _, after in _run(spark, tmp_path, none(spark), data)] == [0] * 5
