import uuid

import pytest
from pyspark.sql import functions as F

from skeinwork.functions import urls as U
from skeinwork.functions.hosts import host_of


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_dedup_key(spark):
    cases = {
        "HTTP://Ex.COM/A/?b=1#c": "http://ex.com/a/",
        "http://ex.com/a///": "http://ex.com/a",
        "http://ex.com/": "http://ex.com/",
        "http://ex.com:80/a": "http://ex.com/a",
        "a/b/": "a/b/",
        "a/b//": "a/b/",
    }
    for url, want in cases.items():
        assert value(spark, U.dedup_key(F.lit(url))) == want, url


def test_crawl_and_graph_keys(spark):
    assert value(spark, U.crawl_url(F.lit("https://Ex.com/A/?q=1#f"))) == "https://ex.com/A"
    assert value(spark, U.crawl_url(F.lit("https://ex.com"))) == "https://ex.com/"
    assert value(spark, U.crawl_url(F.lit("ftp://ex.com/a"))) is None
    assert value(spark, U.graph_key(F.lit(" http://e.com/a/?x=1#y "))) == "http://e.com/a/?x=1"
    assert value(spark, U.graph_key(F.lit("http://e.com/"))) == "http://e.com/"
    assert value(spark, U.graph_key(F.lit("http://e.com/a/"))) == "http://e.com/a"


def test_nulls_stay_null(spark):
    n = F.lit(None).cast("string")
    for f in (U.dedup_key, U.crawl_url, U.graph_key, U.history_key, U.map_key, U.index_name, U.document_uid, host_of):
        assert value(spark, f(n)) is None


def test_uid_is_uuid5(spark):
    for url in ("https://example.com/a", "http://ü.example/ß?x=1", ""):
        assert value(spark, U.document_uid(F.lit(url))) == str(uuid.uuid5(uuid.NAMESPACE_DNS, url))


def test_globs(spark):
    fits = lambda u, p, **k: value(spark, U.glob(F.lit(u), p, **k))
    assert fits("https://a.com/x/y", "https://a.com/**")
    assert not fits("https://b.com/x", "https://a.com/**")
    assert fits("https://a.com/docs/changelog/1", "**/changelog/**")
    assert not fits("https://a.com/docs/changelog/1", "**/changelog/**", sitemap=True)
    assert fits("abc", "a*c") and not fits("a/b/c", "x*c")
    assert not fits("https://a.com/blog/1", "*/blog/*")  # a slash before the part
    assert fits("https://a.com/x", "https://a.com/x") and not fits("https://a.com/x/", "https://a.com/x")


def test_scope(spark):
    scope = lambda d, b, **k: value(spark, U.in_scope(F.lit(d), F.lit(b), **k))
    assert scope("www.A.com", "a.com") and scope("blog.a.com", "a.com")
    assert not scope("a.com", "blog.a.com") and not scope("blog.a.com", "a.com", follow_subdomains=False)
    assert scope("b.com", "a.com", follow_external=True)
    assert not scope("a.com", "a.com", allowed=["b.com"]) and scope("www.b.com", "a.com", allowed=["B.com"])


@pytest.mark.parametrize(("url", "want"), [("HTTP://WWW.Ex.com:8080/x", "ex.com"), ("https://u:p@ex.com/", "ex.com"), ("ex.com/a", "ex.com"), ("", None), ("https:///x", None)])
def test_host(spark, url, want):
    assert value(spark, host_of(F.lit(url))) == want


def test_small_functions(spark):
    assert value(spark, U.registered_domain(F.lit("a.b.co.uk"))) == "b.co.uk"
    assert value(spark, U.registered_domain(F.lit("a.b.example.com"))) == "example.com"
    assert value(spark, U.index_name(F.lit("https://www.ex.com/a b/c//"))) == "ex-com-a-b-c"
    assert value(spark, U.url_tags(F.lit("https://e.com/a/b?c"))) == ["/a", "/a/b"]
    assert value(spark, U.url_tags(F.lit("https://e.com/"))) == []
    assert value(spark, U.is_non_page(F.lit("https://e.com/a.PDF?x#y"))) and not value(spark, U.is_non_page(F.lit("https://e.com/a")))
    assert value(spark, U.error_status(F.lit("404 Not Found"))) == 404
    assert value(spark, U.error_status(F.lit("status: 503"))) == 503
    assert value(spark, U.error_status(F.lit("timeout"))) is None
    assert not value(spark, U.is_fetchable(F.lit("http://10.0.0.1/a"))) and value(spark, U.is_fetchable(F.lit("http://e.com/a")))
    hosts, patterns = U.crawl_seeds(F.array(F.lit("https://A.com/x/"), F.lit("https://b.com")), F.array().cast("array<string>"), F.array().cast("array<string>"))
    assert value(spark, hosts) == ["a.com", "b.com"] and value(spark, patterns) == ["https://A.com/x/*"]
