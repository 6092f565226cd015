import random
import re

import pytest

from maskweave.llm import url_filter
from maskweave.session import staged

RULES = "host string, path string, verdict string"
ANSWER = ["page_id", "host", "path", "rule", "verdict"]


def plain(url, rules, listed):
    def cut(u):
        at = (u or "").find("://")
        if at < 0:
            return "", ""
        rest = u[at + 3 :]
        host = re.match("[^/?#]*", rest).group()
        low = "".join(c.lower() if c.isascii() else c for c in host)
        return low, re.match("[^?#]*", rest[len(host) :]).group()

    host, path = cut(url)
    best = None
    for h, p, v in rules:
        if h and p is not None:
            h = h.lower()
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                best = max(best or (-1,), (len(h + p), len(h), v, h + p))
    if best:
        return host, path, best[3], best[2]
    on_list = host + path != "" and any(cut(u) == (host, path) for u in listed)
    return host, path, None, "block" if on_list else "allow"


def check(spark, urls, rules, listed, **more):
    pages = spark.createDataFrame(
        [(i, u, "x", "y", i) for i, u in urls], "page_id bigint, url string, host string, verdict string, loud bigint"
    )
    got = url_filter.judged(
        pages,
        spark.createDataFrame(rules, RULES),
        spark.createDataFrame([(u, 1) for u in listed], "url string, key int"),
        **more,
    )
    assert got.columns == ANSWER
    want = [(i, *plain(u, rules, listed)) for i, u in urls]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


AWKWARD = [
    "http://Example.COM/a", "https://example.com", "http://example.com?q=://x/y", "http://www.example.com/a/b#f",
    "notexample.com/a", "http://notexample.com/a", None, "", "://", "http://", "http:///a", "a://b.c://d",
    "http://" + "a." * 3000 + "example.com/a", "http://example.com/" + "p" * 100_000, "http://É.example.com/ä",
    "http://example.com/a\nb", "http://example.com:80/a", "http://.com/", "HTTP://x.org/%41?",
]


def test_awkward_urls(spark):
    rules = [
        ("com", "/", "allow"), ("example.com", "/a", "block"), ("Example.com", "/a", "allow"),
        ("www.example.com", "", "allow"), ("example.com", "/é", "block"), (None, "/", "block"), ("", "/", "block"),
        ("org", None, "block"), ("c:", "/", "block"),
    ]
    listed = ["ftp://x.org/%41", None, "nothing", "http://example.com/", "http://X.org/%41#1"]
    urls = [*enumerate(AWKWARD), (None, AWKWARD[0]), (1, AWKWARD[0]), (1, AWKWARD[0])]
    check(spark, urls, rules, listed)
    check(spark, urls, [], listed)
    check(spark, urls, rules, [])
    check(spark, urls, [], [])
    check(spark, [], rules, listed)


@pytest.mark.parametrize("max_blocks", [1, 1 << 20])
def test_random_urls_whatever_the_size_of_the_filter(spark, max_blocks):
    rng = random.Random(max_blocks)

    def host():
        return ".".join(rng.choice(["a", "b", "com", "net"]) for _ in range(rng.randint(1, 4)))

    def path():
        return "".join("/" + rng.choice(["x", "y", "xy"]) for _ in range(rng.randint(0, 3)))

    rules = [(host(), path(), rng.choice(["allow", "block"])) for _ in range(40)]
    urls = [(i, f"http://{host()}{path()}") for i in range(600)]
    listed = [f"http://{host()}{path()}?{i}" for i in range(200)]
    check(spark, urls, rules, listed, max_blocks=max_blocks)


def test_filter_never_rejects_a_key_and_seldom_passes_another(spark):
    keys = staged(spark.range(20_000).selectExpr("'url' AS kind", "concat('k', id) AS key"), "test-keys")
    f = url_filter.Filter(keys, 20_000)
    assert f.blocks == 4000
    probes = spark.range(40_000).selectExpr("concat('k', id) AS key", "id < 20000 AS listed")
    passed = dict(
        probes.withColumn("passes", f.passes("url", probes["key"])).where("passes").groupBy("listed").count().collect()
    )
    assert passed[True] == 20_000
    assert passed.get(False, 0) < 1000


def test_no_python_on_the_main_path(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    got = url_filter.judged(pages, spark.createDataFrame([("com", "/", "block")], RULES), pages)
    assert "Python" not in got._jdf.queryExecution().toString()
