import random
import re
from collections import Counter

from pyspark.sql import functions as F

from ionloom.llm import cascade

SCHEMA = "page_id long, url string, html string, host string, path int, `key` string, rule string"
URLS = [
    None, "", "no scheme/net/", "http://", "://", "HTTP://WWW.Example.NET/en/1?x=/de/#a", "https://example.net/EN/2", "https://a.net",
    "https://a.net?x", "https://a.net#/y", "https://a.net/", "https://xnet/", "https://net/", "https://.net/x", "https://example.com/de/",
    "https://example.com/de", "https://a.b.example.com/de/x", "https://notexample.com/de/x", "http://x.org/fr/1", "http://org/fr/", "http://fr.org/de/",
    "ftp://user@a.NET:80/x", "x://a.net./y", "http://ÀB.İ.net/ß?q", "a://b://c.net/x", "http://a.net/" + "p" * 100_000, "http://" + "h." * 30_000 + "net/",
    "http://\n.net/\n",
]
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def _brute(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        whole = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
        host, slash, rest = whole.partition("/")
        host, path = host.translate(LOWER), slash + rest
    fits = [
        (-len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = min(fits) if fits else (0, None, cascade.UNLISTED)
    return host, path, best[1], best[2]


def _pages(spark, urls):
    return spark.createDataFrame([(i // 2, u, "h", "x", 1, "k", "r") for i, u in enumerate(urls)], SCHEMA).repartition(3)


def _check(spark, urls, rules):
    got = cascade.judge(_pages(spark, urls), cascade.rule_table(spark, rules)).collect()
    assert Counter(tuple(r) for r in got) == Counter((i // 2, *_brute(u, rules)) for i, u in enumerate(urls))


def test_verdicts_equal_brute_force(spark):
    _check(spark, URLS + URLS[5:9], cascade.RULES)


def test_many_rules_and_a_hot_host(spark):
    rng = random.Random(3)
    hosts = [f"{a}.{b}.{c}" for a in "abcdefgh" for b in "xyz" for c in ("net", "org", "com")]
    rules = {(rng.choice(hosts).split(".", rng.randint(0, 2))[-1], f"/{rng.randint(0, 40)}/") for _ in range(150)}
    rules = [(h, p, rng.choice(["block", "allow"])) for h, p in sorted(rules)]
    urls = [f"https://{rng.choice(hosts)}/{rng.randint(0, 45)}/{i % 50}" for i in range(3000)]
    urls += ["https://a.x.net/7/hot"] * 1500
    _check(spark, urls, rules)


def test_no_rules_and_no_pages(spark):
    _check(spark, URLS, [])
    assert cascade.judge(_pages(spark, []), cascade.rule_table(spark)).count() == 0


def test_membership_is_exact_and_filters_follow_the_list(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    listed, others = keys.where("key % 40 = 3"), keys.where("key % 40 <> 3")
    levels = cascade.cascade(listed, others)
    assert len(levels) > 1
    assert sum(level.bits for level in levels) < 20 * 500
    wrong = keys.where(cascade.member(levels, F.col("key")) != (F.col("key") % 40 == 3))
    assert wrong.count() == 0
