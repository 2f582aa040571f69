import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tracelake.llm import url_filters as U

SCHEMA = "page_id long, url string, html string, host int, verdict string"
URLS = [
    None, "", "no scheme.com/x", "http://", "://", "http://com/", "http://com", "https://example.com/en/1?x=/en/", "https://Example.COM/en/", "https://example.com/EN/", "http://www.example.com/en/a#b",
    "http://a.www.example.com/en/", "http://xexample.com/en/", "http://a.net/es/", "http://net/fr", "http://net/fr/x", "https://a.org/com/", "ftp://ÄB.org/é?q", "http://x.com:80/", "http://u@example.com/en/", "a://b://example.com/en/",
    "http://spam-farm.org/", "http://x.y.best-casino.org", "http://casino/", "http://my.casino/", "http://pills.net/es/", "http://pills.net/de/", "http://notspam.org/", "http://.spam..org/", "http://e.com\n/en/", "http://long.org/" + "a/" * 50_000,
    "http://" + "a." * 5_000 + "net/es/x", "http://spam-farm.org/",
]


def split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match("[^?#]*", rest[len(host) :])[0]


def fits(key, host, path):
    h = key.split("/", 1)[0]
    return (host == h or host.endswith("." + h)) and path.startswith(key[len(h) :])


def brute(urls, rules, listed):
    out = []
    for i, url in enumerate(urls):
        host, path = split(url)
        held = [k for k, _ in rules if k is not None and fits(k, host, path)]
        rule = max(held, key=lambda k: (len(k), len(k.split("/", 1)[0])), default=None)
        if rule is not None:
            verdict = "block" if (rule, "block") in rules else "allow"
        else:
            verdict = "block" if any(fits(k, host, path) for k in listed) else "allow"
        out.append((i, host, path, rule, verdict))
    return out


def by_words(urls):
    out = set()
    for url in urls:
        labels = split(url)[0].split(".")
        out |= {".".join(labels[k:]) for k, x in enumerate(labels[:-1]) if set(x.split("-")) & set(U.WORDS)}
    return out


def got(df):
    return sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect())


@pytest.mark.parametrize("most", [U.MOST_BYTES, 0])
def test_like_brute_force(spark, most):
    pages = spark.createDataFrame([(i, u, "", 1, "clash") for i, u in enumerate(URLS)], SCHEMA).repartition(3)
    assert {r.key for r in U.hosts_with(pages).collect()} == by_words(URLS)
    rules = [*U.RULES, ("a.net/e", "allow"), ("net/fr", "block"), ("net/fr", "allow"), ("org", "allow"), (None, "block"), ("pills.net/es", "allow"), ("b.org/é", "block")]
    listed = [*by_words(URLS), "x.com:80/", "com", "example.com/EN/", "com"]
    one = spark.createDataFrame([(k,) for k in listed], "key string")
    result = U.url_verdicts(pages, spark.createDataFrame(rules, "key string, verdict string"), one, most_bytes=most)
    assert got(result) == brute(URLS, rules, listed)
    none = spark.createDataFrame([], "key string")
    assert got(U.url_verdicts(pages, U.rules_of(spark), none, most_bytes=most)) == brute(URLS, U.RULES, [])
    assert U.url_verdicts(pages.limit(0), U.rules_of(spark), none, most_bytes=most).count() == 0


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(U, "BITS_A_KEY", 3)  # small filters, so that there are several levels
    listed = spark.range(0, 60_000, 3).select(F.concat(F.lit("host"), "id", F.lit(".org")).alias("key"))
    universe = spark.range(60_000).select(F.concat(F.lit("host"), "id", F.lit(".org")).alias("key"), (F.col("id") % 3 == 0).alias("listed"))
    cascade = U.Cascade(listed, universe.select("key").unionByName(universe.select("key")))
    assert len(cascade.filters) > 2  # false positives were met and settled
    wrong = universe.where(cascade.filters[0].passes(F.col("key")) & ~F.col("listed")).count()
    assert 0 < wrong < 60_000
    assert universe.where(cascade.holds(F.col("key")) != F.col("listed")).count() == 0


def test_sql_and_native(spark, tmp_path):
    path = tmp_path / "pages.parquet"
    spark.createDataFrame([(i, u, "", 1, "clash") for i, u in enumerate(URLS)], SCHEMA).coalesce(1).write.parquet(str(path))
    base = duckdb.connect()
    base.execute(f"create view pages as select * from '{path}/*.parquet'")
    rows = base.sql(f"select page_id, host, path, rule, verdict from ({U.OP12_SQL})").fetchall()
    result = U.op12_url_filter(spark, str(tmp_path))
    plan = result._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan
    assert sorted(rows) == got(result) == brute(URLS, U.RULES, by_words(URLS))
