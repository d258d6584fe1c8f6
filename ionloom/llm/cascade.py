"""Url filters by a cascade of Bloom filters.

Level 0 encodes the listed keys. The keys of the corpus that pass it wrongly are encoded in level
1, the listed keys that pass level 1 wrongly in level 2, and so on until no key passes wrongly.
Every key that a page can ask for was in the universe the levels were built over, so membership
is exact and needs no join: a page tests its own few keys.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.llm.common import ascii_lower, written

# The rules as (host, path, verdict).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: Verdict of an url that no rule fits, i.e. none of whose keys is listed.
UNLISTED = "allow"
#: Bits of the smallest filter, and wrong passes that levels after the first let through.
LEAST_BITS, LATER = 512, 0.5


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its words as a column, and how its positions are drawn."""

    words: Column
    bits: int
    hashes: int
    salt: int

    def places(self, key: Column) -> list[Column]:
        """Bit positions of a key; two hashes give all."""
        m = F.lit(self.bits).cast("long")
        first = F.pmod(F.xxhash64(F.lit(2 * self.salt), key), m)
        step = F.pmod(F.xxhash64(F.lit(2 * self.salt + 1), key), m - 1) + 1
        return [F.pmod(first + step * F.lit(i).cast("long"), m) for i in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        def bit(place: Column) -> Column:
            word = F.element_at(self.words, (F.shiftright(place, 6) + 1).cast("int"))
            return word.bitwiseAND(_bit(place)) != 0

        return reduce(lambda a, b: a & b, [bit(p) for p in self.places(key)])


def _bit(place: Column) -> Column:
    """The bit of a place inside its word of 64."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64).cast("long")).cast("int"))


def level(inside: DataFrame, share: float, salt: int) -> Level:
    """The filter of the keys of ``inside`` that lets about ``share`` of other keys through.

    Its size follows the number of keys it encodes, never that of the corpus; its words are
    combined before and after one shuffle and kept as a one-row table in the shared folder.
    """
    n = inside.count()
    bits = max(LEAST_BITS, 64 * math.ceil(n * math.log2(1 / share) / math.log(2) / 64))
    plan = Level(F.lit(None), bits, max(1, round(math.log2(1 / share))), salt)
    place = inside.select(F.explode(F.array(*plan.places(F.col("key")))).alias("place"))
    word = place.select(F.shiftright("place", 6).alias("word"), _bit(F.col("place")).alias("bit"))
    every = inside.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit"))
    words = word.unionByName(every).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    table = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda s: s["bits"]).alias("words"))
    return Level(written(table, "bloom-level").scalar(), bits, plan.hashes, salt)


def cascade(listed: DataFrame, others: DataFrame, salt: int = 0) -> list[Level]:
    """Levels that tell the keys of ``listed`` from those of ``others`` (both distinct and disjoint).

    The first level lets so few others through that the second encodes about as many keys as the
    first; later ones halve. None if nothing is listed.
    """
    levels: list[Level] = []
    inside, outside = listed, others
    a, b = inside.count(), outside.count()
    if a == 0:
        return levels
    share = min(LATER, a * math.sqrt(0.5) / max(b, 1))
    while True:
        levels.append(level(inside, share, 1000 * salt + len(levels)))
        wrong = written(outside.where(levels[-1].passes(F.col("key"))), "bloom-wrong")
        if wrong.isEmpty():
            return levels
        inside, outside, share = wrong, inside, LATER


def member(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed; null keys are not."""
    answer = F.lit(len(levels) % 2 == 1)
    for number in range(len(levels) - 1, -1, -1):
        answer = F.when(levels[number].passes(key), answer).otherwise(F.lit(number % 2 == 1))
    return F.coalesce(key.isNotNull() & answer, F.lit(False))


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of an url; both empty without a ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    whole = F.regexp_extract(rest, r"^[^?#]*", 0)
    slash = F.locate("/", whole)
    host = F.when(slash > 0, F.substring(whole, F.lit(1), slash - 1)).otherwise(whole)
    path = F.when(slash > 0, F.substring(whole, slash, F.length(whole))).otherwise("")
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def asked(host: Column, path: Column, shapes: list[tuple[int, int]]) -> list[Column]:
    """The keys that a page asks for: the last labels of its host and the first characters of its
    path, for each (labels, characters) that some rule has; null where the url is shorter."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    return [
        F.when((labels >= n) & (F.length(path) >= c), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, c)))
        for n, c in shapes
    ]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    fields = ("host", "path", "verdict")
    structs = [F.struct(*[F.lit(v).cast("string").alias(f) for f, v in zip(fields, r, strict=True)]) for r in rules or [("", "", "")]]
    return spark.range(1).select(F.inline(F.array(*structs))).where(F.lit(bool(rules)))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict``.

    A rule (host, path, verdict) fits its host and subdomains if the url's path starts with the
    rule's; the longest wins (of equally long ones, which differ in where the path begins, the
    first by code point). A rule listed both ways blocks. Null urls and urls without ``://`` have
    empty parts and no rule; without a rule the verdict is UNLISTED. Repeated pages each get
    their row, an empty table none; other columns are ignored. Rules may be any number: only the
    distinct shapes of their keys and the filters' sizes are met by a driver.
    """
    lowered = rules.select(
        ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).where(F.col("host").isNotNull())
    width = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1
    shapes = sorted((r["n"], r["c"]) for r in lowered.select(width.alias("n"), F.length("path").alias("c")).distinct().collect())
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    if not shapes:
        return split.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(UNLISTED).alias("verdict"))
    keys = asked(F.col("host"), F.col("path"), shapes)

    # The universe: every key that some page asks for or some rule lists, with its rule's verdict.
    corpus = split.select(F.explode(F.array(*keys)).alias("key")).where("key is not null").select("key", F.lit(0).alias("kind"))
    kind = F.when(F.col("verdict") == "block", 2).otherwise(1)
    named = lowered.select(F.concat("host", "path").alias("key"), kind.alias("kind"))
    universe = written(corpus.unionByName(named).groupBy("key").agg(F.max("kind").alias("kind")), "url-keys")
    found = {
        verdict: cascade(universe.where(F.col("kind") == k).select("key"), universe.where(F.col("kind") != k).select("key"), k)
        for verdict, k in (("allow", 1), ("block", 2))
    }

    def hit(key: Column) -> Column:
        verdict = F.when(member(found["block"], key), "block").when(member(found["allow"], key), "allow")
        return F.when(verdict.isNotNull(), F.struct((-F.length(key)).alias("size"), key.alias("rule"), verdict.alias("verdict")))

    best = F.array_min(F.array_compact(F.array(*[hit(k) for k in keys])))
    return split.select("page_id", "host", "path", best.alias("best")).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(UNLISTED)).alias("verdict")
    )
