import pytest
from pyspark.sql import functions as F

from corpuswright.llm import queries, urlfilter


def slow(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        n = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
        tail = rest[n:]
        path = tail[: min((tail.index(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else default


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def want(pages, rules):
    return sorted([(r.page_id, *slow(r.url, rules)) for r in pages], key=str)


def test_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert rows_of(queries.op6_urls(spark, sf)) == want(pages, queries.URL_RULES)


URLS = [
    (1, "http://www.Example.COM/en/1"), (1, "http://www.Example.COM/en/1"), (None, "http://example.com/en/"), (3, None), (4, "no scheme"), (5, "://"), (6, "http://com"), (7, "http://com/"), (8, "http://x.com?en/"),
    (9, "http://a.net/es/x#/fr/"), (10, "http://a.net/es"), (11, "http://u@host.net:80/es/"), (12, "http://notexample.com/en/"), (13, "http://a..net//es/"), (14, "x://y://z.net/fr/a"), (15, "http://ÄÖ.net/fr/\n"), (16, "http://" + "a." * 300 + "net/es/" + "b/" * 300),
]
MORE = [*queries.URL_RULES, ("a.net", "/es", "allow"), ("net", "/es/x", "allow"), ("example.com", "", "block"), ("com", "/e", "block")]


@pytest.mark.parametrize("rules", [queries.URL_RULES, MORE])
@pytest.mark.parametrize("limit", [200_000, 0])
def test_odd_urls(spark, rules, limit):
    pages = spark.createDataFrame(URLS, "page_id long, url string").withColumns({c: F.lit("x") for c in ("row", "host", "path", "digest", "prefix", "verdict")})
    table = urlfilter.rule_table(spark, rules)
    assert rows_of(urlfilter.judge(pages, table, broadcast_rules=limit)) == want(pages.collect(), rules)
    assert urlfilter.judge(pages.limit(0), table).collect() == []


def test_odd_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    rules = urlfilter.rule_table(spark, [(None, "/", "block"), ("", "/", "block"), ("a.com", "/x", "maybe"), ("a.com", None, "block"), ("a.com", "", "allow")])
    assert rows_of(urlfilter.judge(pages, rules)) == [(1, "a.com", "/x", "a.com", "block")]
    assert rows_of(urlfilter.judge(pages, rules.limit(0), default="block")) == [(1, "a.com", "/x", None, "block")]
