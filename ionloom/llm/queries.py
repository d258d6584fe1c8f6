"""The registered queries of the training-data operators, and SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ionloom.llm import (
    bpe,
    cascade,
    chebyshev,
    exact_stream,
    golay,
    mixing,
    ngram_bloom,
    personal,
    pstable,
    quality,
    secrets,
    sharding,
    slices,
)
from ionloom.llm.common import documents, id_remainder
from ionloom.session import prepare

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each document: base patterns, and formats inferred from them."""
    return secrets.scan(documents(prepare(spark), sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document."""
    docs = documents(prepare(spark), sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = id_remainder(F.col("doc_id"), quality.FOLDS) == quality.HELD_OUT
    return quality.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest found of every fiftieth vector."""
    vectors = prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    return pstable.search(vectors, F.col("vec_id") % 50 == 0)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document, sorted by training position."""
    plan = mixing.curriculum(documents(prepare(spark), sf_dir))
    return plan.select(
        "doc_id",
        "size",
        "source_size",
        F.round("target", 6).alias("target"),
        "taken",
        F.round("position", 9).alias("position"),
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS kind FROM s),
w AS (SELECT *, kind + 1.0::DOUBLE AS weight, 3.0::DOUBLE * source_size AS lim FROM k),
l AS (SELECT *,
    (sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, source ASC NULLS LAST
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY lim / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
first_level AS (SELECT arg_min(level, (lim / weight, source IS NULL, source)) AS level FROM l WHERE level * weight <= lim),
t AS (SELECT l.source, source_size, kind, least(lim, weight * f.level) AS target FROM l, first_level f),
o AS (SELECT d.doc_id, d.size, t.source_size, t.kind, t.target, floor(t.target + 0.5)::BIGINT AS quota,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat_ws('|', d.doc_id, d.size)), d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS whole FROM o),
r AS (SELECT *, least(whole * size + least(size, greatest(0, quota - whole * source_size - start)), 3 * size)::BIGINT AS taken
  FROM q),
u AS (SELECT *, CASE WHEN taken > 0 THEN start / quota::DOUBLE END AS u FROM r)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken,
  round(CASE
    WHEN u <= 0 THEN 0.0
    WHEN kind = 1 THEN u
    WHEN kind = 0 AND u < 0.625 THEN 2 * u / (1.5 + sqrt(2.25 - 2 * u))
    WHEN kind = 0 AND u <= 0.625 THEN 0.5
    WHEN kind = 0 THEN 0.5 + 2 * (u - 0.625) / (1 + sqrt(1 - 2 * (u - 0.625)))
    WHEN u < 0.375 THEN 2 * u / (0.5 + sqrt(0.25 + 2 * u))
    WHEN u <= 0.375 THEN 0.5
    ELSE 0.5 + 2 * (u - 0.375) / (1 + sqrt(1 + 2 * (u - 0.375))) END, 9) AS position
FROM u
"""


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of each document by exact word counts and by the n-gram filter."""
    return ngram_bloom.score(documents(prepare(spark), sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the text decoded from them."""
    return bpe.round_trip(documents(prepare(spark), sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document."""
    return personal.scan(documents(prepare(spark), sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one of equal text that stays."""
    found = exact_stream.deduplicate(documents(prepare(spark), sf_dir))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP8_SQL = f"""
WITH t AS (SELECT doc_id, {LOWERED} AS norm FROM documents),
g AS (SELECT sha256(norm) AS text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, g.text_sha256
FROM t JOIN g ON sha256(t.norm) = g.text_sha256
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shard, with equal counts and equal texts together."""
    return sharding.shard(documents(prepare(spark), sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of each document and the component of its near-duplicates."""
    found = golay.near_duplicates(documents(prepare(spark), sf_dir))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 16 leading whitened components."""
    return chebyshev.whiten(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every vector and its error."""
    return slices.compress(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def _op12_sql() -> str:
    """Four rounds of assignment and refinement, then the last assignment. Whole numbers are held
    as doubles, exact at this size; a key of distance and index settles ties."""
    width, entries = 64 // slices.PARTS, slices.ENTRIES
    ctes = [f"""
v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: floor({slices.SCALE} * c::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
q AS MATERIALIZED (SELECT vec_id, label, p, x[p * {width} + 1 : p * {width} + {width}] AS q FROM v, range({slices.PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, q AS c FROM q QUALIFY e < {entries})"""]
    for r in range(slices.ROUNDS + 1):
        ctes.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, label, q.p, q, min((list_inner_product(q, q) - 2 * list_inner_product(q, c)
    + list_inner_product(c, c)) * {entries} + e)::BIGINT AS k FROM q JOIN b{r} b ON q.p = b.p GROUP BY ALL)""")
        if r < slices.ROUNDS:
            ctes.append(f"""
m{r} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, k % {entries} AS e, i, floor(sum(q[i]) / count(*)) AS m
    FROM a{r}, range(1, {width + 1}) t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.e = b.e)""")
    last = slices.ROUNDS
    return f"""WITH {",".join(ctes)},
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda v: v::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{last}),
o AS (SELECT vec_id, label, string_agg(lpad(to_hex(k % {entries}), 2, '0'), '' ORDER BY p) AS code, sum(k // {entries})::BIGINT AS error
  FROM a{last} GROUP BY 1, 2)
SELECT vec_id, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o, h"""


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and verdict of every page's url."""
    return cascade.judge(prepare(spark).read.parquet(f"{sf_dir}/pages.parquet"), cascade.rule_table(spark))


OP13_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3 :] ELSE '' END AS rest FROM pages),
w AS (SELECT page_id, coalesce(regexp_extract(rest, '^[^?#]*'), '') AS whole FROM u),
s AS (SELECT page_id, translate(regexp_extract(whole, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  whole[length(regexp_extract(whole, '^[^/]*')) + 1 :] AS path FROM w),
r(rule_host, rule_path, verdict) AS (VALUES {", ".join(str(r) for r in cascade.RULES)}),
f AS (SELECT page_id, arg_max((rule_host || rule_path, verdict), length(rule_host || rule_path)) AS best FROM s JOIN r
  ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1)
SELECT s.page_id, host, path, best[1] AS rule, coalesce(best[2], '{cascade.UNLISTED}') AS verdict FROM s LEFT JOIN f ON f.page_id = s.page_id
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    return corpus_pipeline.run(prepare(spark), sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_quality": op2_quality,
    "op3_nearest": op3_nearest,
    "op4_mixing": op4_mixing,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_bpe": op6_bpe,
    "op7_personal_data": op7_personal_data,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_sharding": op9_sharding,
    "op10_simhash": op10_simhash,
    "op11_whitening": op11_whitening,
    "op12_vector_codes": op12_vector_codes,
    "op13_url_filters": op13_url_filters,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op4_mixing": OP4_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op12_vector_codes": _op12_sql(),
    "op13_url_filters": OP13_SQL,
}
