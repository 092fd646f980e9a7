"""Job states, the crawl loop, alerts, counters, the page store and index settings on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from skeinwork.operators import analytics as A
from skeinwork.operators import jobs as J
from skeinwork.operators import search as R
from skeinwork.sources import stores

EVENTS = "type string, job_id string, timestamp long, pages_crawled long, documents_indexed long, duration_secs long"


def event(kind, job, at, *told):
    return (kind, job, at, *(told or (None, None, None)))


def test_job_states(spark):
    rows = [event("job_started", "a", 1000), event("page_crawled", "a", 3000), event("page_crawled", "a", 11_000), event("page_failed", "a", 5000)]
    rows += [event("job_started", "b", 0), event("document_indexed", "b", 4000), event("job_completed", "b", 9000, 40, 30, 20), event("job_paused", "b", 2000)]
    rows += [event("job_started", "c", 0), event("job_failed", "c", 10), event("job_completed", "d", 7, 3, None, 0), event("job_started", "d", 7)]
    rows += [event("page_crawled", "e", 5), event("page_crawled", None, 5), event("job_started", "f", 1), event("job_cancelled", "f", 2), event("job_paused", "g", 2)]
    df = spark.createDataFrame(rows, EVENTS).repartition(3)
    got = {r.job_id: r for r in J.job_states(df, 12).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "running", "b": "completed", "c": "failed", "d": "completed", "e": "pending", "f": "cancelled", "g": "paused"}
    a, b, d = got["a"], got["b"], got["d"]
    assert (a.pages_crawled, a.errors, a.started_ms, a.ended_ms, a.crawl_rate, a.eta_secs) == (2, 1, 1000, None, 0.2, 50)
    assert (b.pages_crawled, b.documents_indexed, b.ended_ms, b.crawl_rate, b.eta_secs) == (40, 30, 9000, 2.0, None)
    assert (d.pages_crawled, d.documents_indexed, d.crawl_rate) == (3, 0, 0.0)
    assert J.job_summary(J.job_states(df)).first().asDict() == {"total": 7, "running": 1, "completed": 2, "failed": 2, "pending": 2}
    assert J.job_summary(J.job_states(df.limit(0))).first().total == 0
    assert J.lifecycle_events(df).count() == 11


def test_crawl_round(spark):
    now = dt.datetime(2024, 1, 31)
    rows = [("http://a.test/new", 0, 1), ("http://a.test/old", 1, 1), ("http://a.test/fresh", 0, 9), ("http://b.test/ranked", 3, 0), ("http://b.test/deep", 9, 9)]
    frontier = spark.createDataFrame([(u, d, p, now) for u, d, p in rows], "url string, depth int, priority int, discovered_at timestamp")
    records = [("http://a.test/old", now - dt.timedelta(days=30), 5, 1, 86_400, "e", None), ("http://a.test/fresh", now - dt.timedelta(minutes=5), 5, 1, 86_400, None, None)]
    history = spark.createDataFrame(records, "url string, last_crawled_at timestamp, crawl_count int, change_count int, recrawl_interval_secs long, etag string, last_modified string")
    scores = spark.createDataFrame([("http://b.test/ranked", 0.9), ("http://a.test/new", 0.00001)], "node string, score double")
    got = {r.url: r for r in J.crawl_round(frontier, history, scores, "2024-01-31 00:00:00", 10, max_depth=5).collect()}
    assert set(got) == {"http://a.test/new", "http://a.test/old", "http://b.test/ranked"}
    assert got["http://a.test/old"].use_conditional and got["http://a.test/old"].reason == "max_age" and got["http://b.test/ranked"].priority > 0
    assert {r.wait_ms for r in got.values()} == {0, 1000} and got["http://b.test/ranked"].wait_ms == 0
    assert len(J.crawl_round(frontier, history, scores, "2024-01-31 00:00:00", 1).collect()) == 1


def test_alerts_hold(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 10, m)
    rows = [("h", at(m), 500 if m in (5, 10, 15) else 200, "") for m in (0, 5, 10, 15, 25)] + [("q", at(0), 200, None)]
    df = spark.createDataFrame(rows, "domain string, timestamp timestamp, status_code int, error string")
    got = {(r.domain, r.started.minute): r for r in A.alert_windows(df, hold=3).collect()}
    assert {k for k, r in got.items() if r.firing} == {("h", 15)}
    assert got["h", 25].increase == 5 and got["h", 10].delta == 0 and got["h", 5].delta is None and got["q", 0].error_ratio == 0.0
    assert A.alert_windows(df.limit(0)).collect() == []


def test_response(spark):
    rows = [("h", dt.datetime(2024, 1, 30, 10), 200, "", 1, 5, 10, "a", "job", "crawl", False)]
    df = spark.createDataFrame(rows, "domain string, timestamp timestamp, status_code int, error string, pages_fetched long, duration_ms long, content_length long, account_id string, job_id string, operation string, js_rendered boolean")
    out = A.respond("top_domains", df, "2024-01-31 00:00:00")
    assert out["rows"] == 1 and out["data"][0]["domain"] == "h" and {"name": "domain", "type": "string"} in out["meta"] and out["statistics"]["elapsed"] >= 0


def test_map_search(spark):
    rows = [(1, "http://a/x", "About Maps", None), (2, "http://a/MAPS", None, None), (3, "http://a/y", None, "old maps"), (4, "http://a/z", "no", None), (5, None, "maps", None)]
    df = spark.createDataFrame(rows, "n int, url string, title string, description string")
    assert [r.n for r in R.map_search(df, "maps", 9, "n").collect()] == [2, 1, 3, 5]
    assert [r.n for r in R.map_search(df, "maps", 2, "n").collect()] == [2, 1] and [r.n for r in R.map_search(df, None, 3, "n").collect()] == [1, 2, 3]


def test_index_settings():
    base = (["title"], ["domain"], ["crawled_at"])
    assert R.index_settings(set(), *base) == {"searchable": ["title"], "filterable": ["domain"], "sortable": ["crawled_at"], "distinct": None}
    full = R.index_settings({"markdown", "schema", "block_split"}, *base, custom=["price"])
    assert full["searchable"] == ["title", "markdown", "custom.price", "h4", "h5", "h6"] and full["distinct"] == "parent_document_id"
    assert full["filterable"] == ["domain", "schema", "custom.price", "parent_document_id", "page_block", "anchor"] and full["sortable"] == ["crawled_at", "page_block"]


def test_counters_expire(spark):
    hits = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "k string")
    one = stores.increment(None, hits, "k", "2024-01-01 00:00:00", 60)
    assert {r.k: r.n for r in one.collect()} == {"a": 2, "b": 1}
    two = stores.increment(one, hits.filter("k = 'a'"), "k", "2024-01-01 00:00:30", 60)
    assert {r.k: (r.n, r.expires_at.second) for r in two.collect()} == {"a": (4, 30), "b": (1, 0)}
    late = stores.increment(two, hits.filter("k = 'b'"), "k", "2024-01-01 00:01:10", 60)
    assert {r.k: r.n for r in late.collect()} == {"a": 4, "b": 1}  # b's time was over, so it begins anew


def test_page_store(spark, tmp_path):
    path = str(tmp_path / "pages")
    pages = spark.createDataFrame([("http://e.test/a", "<p>a"), ("http://e.test/b", "<p>b"), ("http://f.test/", "<p>f"), ("http://f.test/n", None), (None, "x")], "url string, html string")
    stores.put_pages(pages, path)
    assert stores.stored_pages(spark, path, "pages/e.test/").count() == 2
    assert {(r.key[:13], r.size) for r in stores.stored_pages(spark, path, with_html=False).collect()} == {("pages/e.test/", 4), ("pages/f.test/", 4)}
    scan = stores.stored_pages(spark, path, "pages/f", with_html=False)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(key,pages/f)" in scan and "html" not in scan
    stores.delete_pages(spark, path, stores.stored_pages(spark, path, "pages/f.test/").select("key"))
    assert {r.html for r in stores.stored_pages(spark, path).select(F.col("html")).collect()} == {"<p>a", "<p>b"}
