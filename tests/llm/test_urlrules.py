from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from apptledger.llm import urlrules
from apptledger.llm.queries import URL_RULES

LETTERS = str.maketrans(urlrules.UPPER, urlrules.LOWER)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[end:]
    return rest[:end].translate(LETTERS), path[:min([path.index(c) for c in "?#" if c in path] or [len(path)])]


def judged(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


URLS = [
    None, "", "net", "http:/x.net/", "://", "http://", "http://net", "http://net/", "http://NET/en/", "http://xnet/",
    "http://example.net/en", "http://example.net/en/", "http://a.b.EXAMPLE.net/en/?q=/de/", "https://example.com/de/x#y",
    "http://example.com?x=/de/", "http://example.org/fr/1", "http://org/fr/", "x://a://b.net/", "http://.net/",
    "http://example.net/en/\nx", "http://" + "a." * 3000 + "net/", "http://example.com/de/" + "x" * 50_000,
    "http://\u0130.net/en/", "http://example.net/EN/", "http://example.net/en/", "http://example.net/en/"]


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")


def check(df, urls, rules):
    got = df.collect()
    assert len(got) == len(urls)
    for row in got:
        assert (row.host, row.path, row.rule, row.verdict) == judged(urls[row.page_id], rules), urls[row.page_id]


def test_registered_rules(spark, pages):
    check(urlrules.judge(pages, urlrules.rules_table(spark, URL_RULES)), URLS, URL_RULES)


def test_random_rules(spark):
    rng = random.Random(3)
    hosts = ["a", "b.a", "c.b.a", "aa", "b.aa", "c"]
    rules = {(h, p): rng.choice(["allow", "block"]) for h in hosts for p in ["", "/", "/x", "/x/", "/xy/z", "/y"] if rng.random() < 0.4}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"http://{rng.choice(['', 'd.', 'c.'])}{rng.choice(hosts)}{rng.choice(['', '/', '/x', '/x/', '/xy/z/1', '/y?x', '/z'])}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    check(urlrules.judge(df, urlrules.rules_table(spark, rules)), urls, rules)


def test_no_python_in_the_plan(spark, pages):
    plan = urlrules.judge(pages, urlrules.rules_table(spark, URL_RULES))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_tables(spark, pages):
    rules = urlrules.rules_table(spark, URL_RULES)
    clash = pages.withColumn("rule", F.lit("old")).withColumn("digest", F.lit(1)).withColumn("host", F.lit(2))
    check(urlrules.judge(clash, rules), URLS, URL_RULES)
    assert urlrules.judge(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in urlrules.judge(pages, rules.limit(0)).collect()} == {"allow"}
    odd = rules.unionByName(spark.createDataFrame([(None, "/", "block"), ("net", None, "block"), ("net", "/", "block")], urlrules.RULES))
    check(urlrules.judge(pages, odd), URLS, URL_RULES)
