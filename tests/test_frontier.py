from pyspark.sql import functions as F

from skeinwork.operators import dedup as D
from skeinwork.operators import frontier as Q

AS_OF = "2024-01-10 00:00:00"


def test_positions_of_heavy_keys(spark):
    df = spark.range(5000).selectExpr("IF(id % 4 = 0, 'rare', NULL) AS k", "id % 7 AS v", "id")
    got = Q.dense_position(df, ["k"], [F.desc("v"), F.col("id")]).collect()
    for k in ("rare", None):
        own = sorted((r for r in got if r.k == k), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(1, len(own) + 1))
        assert [(-r.v, r.id) for r in own] == sorted((-r.v, r.id) for r in own)


def test_priority(spark):
    df = spark.createDataFrame([("a", 0, 0), ("b", 1, 12), ("c", 2, 3), ("c", 2, 3)], "url string, depth int, priority int")
    assert [(r.url, r.score) for r in Q.pop(df, 3).collect()] == [("b", 1190), ("a", 1000), ("c", 280)]
    assert Q.pop(df, 3, capacity=1).count() == 1
    assert Q.admit(df, max_depth=1).count() == 2
    turns = {(r.url, r.level, r.turn) for r in Q.levelled_order(df.distinct()).collect()}
    assert turns == {("b", "high", 0), ("c", "normal", 0), ("a", "normal", 0)}


def test_politeness(spark):
    df = spark.createDataFrame([("u1", 1, None, "d"), ("u2", 5, None, "d"), ("u3", 1, None, "e")], "url string, priority int, discovered_at timestamp, domain string")
    assert {(r.url, r.wait_ms) for r in Q.politeness_schedule(df, 50).collect()} == {("u2", 0), ("u1", 100), ("u3", 0)}
    got = spark.range(1).select(Q.wait_time(F.lit(True), F.lit(0), F.lit(1), F.lit(5)).alias("a"), Q.wait_time(F.lit(False), F.lit(1), F.lit(1), F.lit(5)).alias("b"), Q.wait_time(F.lit(False), F.lit(0), F.lit(1), F.lit(-5)).alias("c")).first()
    assert tuple(got) == (60000, 100, 0)


def test_recrawl(spark):
    h = spark.createDataFrame(
        [("http://a", "2024-01-09 23:30:00", 3, 1, 3600, None, None), ("http://b", "2023-12-01 00:00:00", 3, 1, 3600, "e", None), ("http://c", "2024-01-09 12:00:00", 4, 3, 3600, None, "m"), ("http://d", "2024-01-09 12:00:00", 4, 1, 3600, None, None), ("http://e", "2024-01-09 12:00:00", 4, 1, 86400, None, None), ("http://f", None, 0, 0, 86400, None, None)],
        "url string, last_crawled_at string, crawl_count int, change_count int, recrawl_interval_secs bigint, etag string, last_modified string",
    ).withColumn("last_crawled_at", F.col("last_crawled_at").cast("timestamp"))
    u = spark.createDataFrame([(f"HTTP://{x} ", i) for i, x in enumerate("abcdefg")] + [(None, 9)], "url string, depth int")
    got = {r.depth: (r.decision, r.reason, r.priority_boost, r.retry_after, r.use_conditional) for r in Q.recrawl_decisions(u, h, AS_OF).collect()}
    assert got[0] == ("skip", "too_recent", 0, 1800, False)
    assert got[1] == ("crawl", "max_age", 5, None, True)
    assert got[2] == ("crawl", "high_change_rate", 7, None, True)
    assert got[3] == ("crawl", "interval_elapsed", 0, None, False)
    assert got[4] == ("skip", "not_due", 0, 43200, False)
    assert got[5][1] == "max_age" and got[6][1] == "first_crawl" and got[9][1] == "first_crawl"
    forced = {r.depth: r.reason for r in Q.recrawl_decisions(u, h, AS_OF, forced_interval=10_000).collect()}
    assert forced[0] == "too_recent" and forced[4] == "forced"


def test_history(spark):
    rows = [("u", "a", 1), ("U ", "a", 2), ("u", "b", 3), ("u", None, 4), ("u", None, 5), ("v", "x", 1)]
    df = spark.createDataFrame(rows, "url string, content_hash string, n int").withColumn("crawled_at", F.timestamp_seconds(F.col("n")))
    got = {r.url: (r.crawl_count, r.change_count, r.recrawl_interval_secs) for r in Q.fold_history(df, ["crawled_at"]).collect()}
    assert got == {"u": (5, 3, int(int(int(86400 * 1.5) * 0.5) * 0.5 * 0.5)), "v": (1, 0, 86400)}


def test_changes_and_hashes(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None), ("d", "x")], "url string, content string")
    sha = "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    hist = spark.createDataFrame([("a", "SHA256:" + sha.upper()), ("b", "0" * 64), ("c", sha)], "url string, content_hash string")
    got = {r.url: r.change for r in D.content_changes(docs, hist, "url", "content", "content_hash").collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "changed", "d": "first_crawl"}


def test_dedup(spark):
    df = spark.createDataFrame([("http://e.com/a/", 2, {"k": "v"}), ("http://E.com/a", 1, None), (None, 1, None)], "url string, n int, m map<string,string>")
    got = {r.dedup_key: r.n for r in D.unique_urls(df, "url", [F.col("n")]).collect()}
    assert got == {"http://e.com/a": 1, None: 1}
    seen = spark.createDataFrame([("http://e.com/a?x",), (None,)], "s string")
    assert [r.url for r in D.filter_unseen(df, seen, "url", "s").collect()] == [None]
    assert {r.n for r in D.latest_by(df.fillna("x", ["url"]), "url", ["n"]).collect()} == {1, 2}


def test_drop_repeats(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), (None, 5, "p"), (None, 4, "q")], "k string, n long, t string")
    assert {(r.k, r.n, r.t) for r in D.drop_repeats(df, ["k"], "n").collect()} == {("a", 1, "y"), ("b", 2, "z"), (None, 5, "p"), (None, 4, "q")}  # a null key repeats nothing
    assert D.drop_repeats(df.limit(0), ["k"], "n").collect() == []


def test_changefreq(spark):
    df = spark.createDataFrame([("Daily",), ("never",), ("odd",), (None,), ("always",)], "v string")
    assert [r.s for r in df.select(Q.changefreq_seconds("v").alias("s")).collect()] == [86400, None, None, None, 0]


def test_clashing_names(spark):
    u = spark.createDataFrame([("http://e.com/a", 1, "x", "y", "z", 3)], "url string, priority int, reason string, level string, dedup_key string, position int")
    h = spark.createDataFrame([], "url string, last_crawled_at timestamp, crawl_count int, change_count int, recrawl_interval_secs bigint, etag string, last_modified string")
    assert Q.recrawl_decisions(u, h, AS_OF).first().reason == "first_crawl"
    assert Q.levelled_order(u).first().level == "normal"
    assert D.unique_urls(u, "url", [F.col("priority")]).first().dedup_key == "http://e.com/a"
    assert Q.recrawl_decisions(u.limit(0), h, AS_OF).collect() == []
