import gzip
import json

import pytest
from pyspark.sql import functions as F

from skeinwork.operators.frontier import fold_history
from skeinwork.schemas import topic_schema
from skeinwork.sources import robots as R
from skeinwork.sources import sitemaps as S
from skeinwork.sources import stores, topics
from skeinwork.streaming import folds


def stream_of(spark, tmp_path, rows, schema, name="in"):
    path = str(tmp_path / name)
    for k in range(0, len(rows), 4):
        spark.createDataFrame(rows[k : k + 4], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name)


EVENTS = [
    ("page_crawled", "j1", 100, None, 1000), ("page_failed", "j1", None, None, 2000), ("urls_discovered", "j1", None, 7, 2500), ("page_crawled", "j2", 50, None, 1000),
    ("document_indexed", "j1", None, None, 3000), ("page_skipped", "j1", None, None, 3000), ("page_crawled", "j1", 11, None, 5000), ("page_crawled", None, 1, None, 1),
]
EVENT = "type string, job_id string, content_length bigint, count bigint, timestamp bigint"


def test_job_counters_stream_equals_batch(spark, tmp_path):
    batch = folds.job_counters(spark.createDataFrame(EVENTS, EVENT)).collect()
    stream = drain(folds.job_counters(stream_of(spark, tmp_path, EVENTS, EVENT)), "counters", "complete").collect()
    assert sorted(map(tuple, stream)) == sorted(map(tuple, batch))
    one = {r.job_id: r for r in batch}["j1"]
    assert (one.pages_crawled, one.errors, one.skipped, one.documents_indexed, one.urls_discovered, one.bytes_downloaded, one.crawl_rate) == (2, 1, 1, 1, 7, 111, 0.5)


def test_history_stream_equals_batch(spark, tmp_path):
    rows = [("u", h, 1000 + i * 1000) for i, h in enumerate(["a", "a", "b", None, None, "b", "b"])] + [("V ", "x", 5)]
    schema = "url string, content_hash string, timestamp bigint"
    out = drain(folds.history_stream(stream_of(spark, tmp_path, rows, schema)), "hist", "update")
    last = {r.url: (r.crawl_count, r.change_count, r.recrawl_interval_secs) for r in out.orderBy("crawl_count").collect()}
    df = spark.createDataFrame(rows, schema).withColumn("crawled_at", F.timestamp_millis("timestamp"))
    assert last == {r.url: (r.crawl_count, r.change_count, r.recrawl_interval_secs) for r in fold_history(df, ["crawled_at"]).collect()}


def test_token_bucket(spark, tmp_path):
    rows = [("d", 1000 + t) for t in [0] * 12 + [500, 1000, 1000]]
    out = drain(folds.token_bucket_stream(stream_of(spark, tmp_path, rows, "domain string, timestamp bigint")), "bucket").orderBy("timestamp").collect()
    assert sum(r.acquired for r in out) == 11 and {r.wait_ms for r in out if not r.acquired and r.timestamp == 1000} == {1000}


def test_sessions(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 30, 80, 200)], "account_id string, t bigint").withColumn("event_time", F.timestamp_seconds("t"))
    assert sorted((r.requests, r.refused) for r in folds.request_sessions(df, 2).collect()) == [(1, 0), (3, 1)]
    idle = folds.idle_sessions(df.withColumnRenamed("account_id", "job_id"), "10 seconds").collect()
    assert len(idle) == 4


def test_unique_stream(spark, tmp_path):
    rows = [("http://e.com/a", 1), ("http://E.com/a/", 2), ("http://e.com/b", 3), ("http://e.com/a#x", 4), ("http://e.com/b", 5)]
    s = stream_of(spark, tmp_path, rows, "url string, t bigint").withColumn("at", F.timestamp_seconds("t"))
    assert drain(folds.unique_stream(s, "url", "at"), "uniq").count() == 2


def test_topics(spark, tmp_path):
    rows = spark.createDataFrame([("http://e.com/a", ["http://e.com/b"], "j", 5)], topic_schema("links"))
    topics.write_topic(rows, "links", str(tmp_path))
    (tmp_path / "links" / "bad.txt").write_text('{"source_url": 5\nnot json\n')
    messages = topics.read_topic(spark, "links", str(tmp_path), streaming=False)
    good, dead = topics.decode(messages, "links")
    assert [r.target_urls for r in good.collect()] == [["http://e.com/b"]]
    assert dead.count() == 2 and {r.original_topic for r in dead.collect()} == {"links"}
    assert [(r.src, r.dst) for r in folds.edges_of(good).collect()] == [("http://e.com/a", "http://e.com/b")]
    seen = []
    q = folds.run_batches(topics.read_topic(spark, "links", str(tmp_path)), lambda df, n: seen.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sum(seen) == 3
    key = topics.encode(spark.createDataFrame([("https://H.com/x", "j")], "url string, job_id string")).first()
    assert key.key == "h.com" and json.loads(key.value)["job_id"] == "j"


def test_facts_and_swap(spark, tmp_path):
    path = str(tmp_path / "facts")
    df = spark.createDataFrame([("a", "crawl", "d", "2024-01-05 00:00:00"), ("b", "map", "d", "2024-02-05 00:00:00")], "account_id string, operation string, domain string, t string").select("account_id", "operation", "domain", F.col("t").cast("timestamp").alias("timestamp"))
    stores.append_facts(df, path)
    since = stores.read_facts(spark, path, "2024-02-01")
    assert [r.account_id for r in since.collect()] == ["b"] and "PartitionFilters: [isnotnull(month" in since._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert stores.expire(df, "2024-02-10", 10).count() == 1
    table = str(tmp_path / "t")
    stores.replace_table(spark.range(3).toDF("k"), table)
    stores.replace_table(spark.range(5).toDF("k"), table)
    assert spark.read.parquet(table).count() == 5


def test_keyed_tables(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, n int, v string")
    new = spark.createDataFrame([("b", 5, "z"), ("c", 1, "w"), ("c", 2, "q")], "k string, n int, v string")
    assert {(r.k, r.n, r.v) for r in stores.upsert(t, new, "k", ["n"]).collect()} == {("a", 1, "x"), ("b", 5, "z"), ("c", 2, "q")}
    assert {r.k for r in stores.insert_missing(t, new, "k").collect()} == {"a", "b", "c"}
    change = spark.createDataFrame([("a", None, "new")], "k string, n int, v string")
    assert {(r.k, r.n, r.v) for r in stores.update_where(t, change, "k").collect()} == {("a", 1, "new"), ("b", 1, "y")}
    assert [r.k for r in stores.prefix_scan(new, "k", "c").collect()] == ["c", "c"]
    assert stores.remove_stale(t.withColumn("_crawl_job_id", F.when(F.col("k") == "a", "j")), "j").count() == 1


ROBOTS = "User-agent: a\nUser-agent: bot\nDisallow: /x*y$\nAllow: /x1y\n\nUser-agent: *\nDisallow: /\nCrawl-delay: 1.5\nSitemap: https://e.com/s.xml"


@pytest.mark.parametrize(("agent", "path", "want"), [("bot/2", "/xzy", False), ("bot", "/xzyz", True), ("bot", "/x1y", False), ("bot", "/x1", True), ("other", "/a", False)])
def test_robots(agent, path, want):
    assert R.is_allowed(ROBOTS, agent, path) is want


def test_robots_join(spark):
    assert R.is_allowed(None, "x", "/") and R.crawl_delay_ms(ROBOTS, "z") == 1500 and R.crawl_delay_ms("User-agent: *\nCrawl-delay: -1", "z") is None
    urls = spark.createDataFrame([("https://e.com/a", "e.com"), ("HTTPS://e.com/a?x", "e.com"), ("//e.com/a", "e.com"), ("https://f.com/a", "f.com"), (None, None)], "url string, host string")
    robots = spark.createDataFrame([("e.com", ROBOTS)], "host string, body string")
    got = {r.url: (r.allowed, r.crawl_delay_ms) for r in R.allowed_urls(urls, robots, "other").collect()}
    assert got == {"https://e.com/a": (False, 1500), "HTTPS://e.com/a?x": (False, 1500), "//e.com/a": (False, 1500), "https://f.com/a": (True, None), None: (True, None)}
    maps = spark.range(1).select(R.named_sitemaps(F.lit(ROBOTS), F.lit("e.com")).alias("a"), R.named_sitemaps(F.lit(None).cast("string"), F.lit("e.com")).alias("b")).first()
    assert maps.a == ["https://e.com/s.xml"] and maps.b == ["https://e.com/sitemap.xml"]


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    index = f"<sitemapindex {ns}><sitemap><loc>u1</loc></sitemap><sitemap><loc>root</loc></sitemap></sitemapindex>".encode()
    urls = gzip.compress(f"<urlset {ns}><url><loc>p1</loc><priority>0.2</priority><changefreq>Daily</changefreq></url><url><loc>p2</loc></url><url/></urlset>".encode())
    files = spark.createDataFrame([("root", bytearray(index)), ("u1", bytearray(urls)), ("bad", bytearray(b"<x")), ("none", None)], "source string, data binary")
    pages = S.follow_sitemaps(files, spark.createDataFrame([("root",)], "source string"), "source", "data")
    assert [(r.loc, r.priority) for r in S.by_priority(pages).collect()] == [("p2", 0.5), ("p1", 0.2)]
    d = spark.range(1).select(*[S.parse_date(F.lit(x)).cast("string").alias(f"c{k}") for k, x in enumerate(["2024-01-02", "2024-01-02T03:04:05", "2024-01-02T03:04:05+01:00", "x"])]).first()
    assert list(d) == ["2024-01-02 00:00:00", "2024-01-02 03:04:05", "2024-01-02 02:04:05", None]


def test_delays(spark, tmp_path):
    codes = [200, 500, 500, 500, 429, 200, 200] + [0] * 12
    own = (1000, 0, False)
    for c in codes:
        own = folds.delay_step(own, c)
    assert folds.delay_step((2250, 4, False), 200) == (2025, 0, False) and own[2] and own[0] > 20_000
    rows = [("d", c, 1 + k) for k, c in enumerate(codes)] + [("e", 200, 1)]
    out = drain(folds.delay_stream(stream_of(spark, tmp_path, rows, "domain string, status_code int, timestamp bigint")), "delays", "update")
    last = {r.domain: (r.delay_ms, r.paused) for r in out.orderBy("timestamp").collect()}
    assert last == {"d": (own[0], True), "e": (1000, False)}


def test_states_end(spark, tmp_path):
    """A state whose last row is its time to live behind the watermark is dropped; the address begins anew."""
    day = 24 * 3_600_000
    schema = "url string, content_hash string, timestamp bigint"
    source = tmp_path / "source"
    spark.createDataFrame([("u", "a", day), ("u", "b", 2 * day)], schema).coalesce(1).write.mode("append").json(str(source))
    spark.createDataFrame([("v", "a", 60 * day)], schema).coalesce(1).write.mode("append").json(str(source))
    spark.createDataFrame([("u", "b", 61 * day)], schema).coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    out = drain(folds.history_stream(stream), "ends", "update").collect()
    assert sorted((r.url, r.last_ms // day, r.crawl_count) for r in out) == [("u", 2, 2), ("u", 61, 1), ("v", 60, 1)]
