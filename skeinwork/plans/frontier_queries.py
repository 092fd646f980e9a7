"""Queries of the frontier, de-duplication and the link graph, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import urls as U
from skeinwork.operators import dedup as D
from skeinwork.operators import frontier as Q
from skeinwork.operators import graph as G
from skeinwork.plans.url_queries import DEDUP_SQL, DOMAIN_SQL, GRAPH_SQL
from skeinwork.session import table

AS_OF = "2024-01-31 00:00:00"


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "crawl_urls")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "crawl_records")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.link_edges(_urls(spark, sf_dir).select("parent_url", "url"), "parent_url", "url")


def unique_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _urls(spark, sf_dir).select("url", "depth", "priority", "discovered_at")
    return D.unique_urls(rows, "url", [F.col("discovered_at"), F.col("url"), F.col("depth"), F.col("priority")])


def unseen_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.filter_unseen(_urls(spark, sf_dir).select("url", "depth"), _records(spark, sf_dir), "url", "url")


def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dedup_stats(_urls(spark, sf_dir), "url")


def content_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "crawl_documents").filter(F.col("parent_document_id").isNull()).select("rec_id", "url", "content")
    return D.content_changes(docs, _records(spark, sf_dir), "url", "content", "content_hash").select("rec_id", "url", D.fingerprint("content").alias("fingerprint"), "change")


def latest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "crawl_documents").select("uid", "rec_id", "crawled_at", "title")
    return D.latest_by(docs, "uid", ["crawled_at", "rec_id"])


def frontier_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.pop(_urls(spark, sf_dir).select("url", "depth", "priority", "discovered_at"), 100)


def levelled_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.levelled_order(_urls(spark, sf_dir).select(F.col("url"), "priority").distinct())


def politeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _urls(spark, sf_dir).select("url", "priority", "discovered_at", U.extract_domain("url").alias("domain")).distinct()
    return Q.politeness_schedule(rows, 1000)


def recrawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = _urls(spark, sf_dir).select("url", "depth")
    return Q.recrawl_decisions(urls, _records(spark, sf_dir), AS_OF)


def history_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.history_stats(_records(spark, sf_dir))


def crawl_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records folded from the deliveries of pages."""
    pages = table(spark, sf_dir, "raw_pages").select("url", F.sha2("html", 256).alias("content_hash"), F.col("fetched_at").alias("crawled_at"), "page_id")
    return Q.fold_history(pages, ["crawled_at", "page_id"])


def link_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(_edges(spark, sf_dir))


def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = G.pagerank(_edges(spark, sf_dir))
    return s.select("node", F.round("score", 9).alias("score"))


def most_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.most_linked(_edges(spark, sf_dir), 20)


def boosted_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frontier rows with the boost of their page's score."""
    edges = _edges(spark, sf_dir)
    n = G.nodes(edges).count()
    scores = G.pagerank(edges).select("node", F.round("score", 9).alias("score"))
    rows = _urls(spark, sf_dir).select("url", "priority").distinct().withColumn("node", U.graph_key("url"))
    boost = F.coalesce(G.priority_boost(F.col("score"), n), F.lit(0))
    return rows.join(scores, "node", "left").select("url", "priority", boost.alias("boost"), (F.col("priority") + boost).alias("boosted"))


def site_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    seeds = _urls(spark, sf_dir).filter("depth = 0").select(U.graph_key("url").alias("node"))
    return G.site_map(edges, seeds, 5, None)


def link_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.connected_components(_edges(spark, sf_dir), "src", "dst")


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    s = G.graph_stats(edges, G.pagerank(edges))
    return s.select(*[F.round(c, 9).alias(c) if c.endswith("score") or c.startswith("avg") else F.col(c) for c in s.columns])


QUERIES = {
    f.__name__: f
    for f in (unique_urls, unseen_urls, dedup_stats, content_changes, latest_documents, frontier_top, levelled_frontier, politeness, recrawl, history_stats, crawl_history, link_degrees, pagerank, most_linked, boosted_frontier, site_map, link_components, graph_stats)
}

_KEY = GRAPH_SQL
_EDGES = f"""e AS MATERIALIZED (SELECT DISTINCT src, dst FROM (SELECT {_KEY.replace('url', 'parent_url')} AS src, {_KEY} AS dst FROM crawl_urls) WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst),
v AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e)"""
_STEPS = ["s0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM v) AS score FROM v)", "o AS MATERIALIZED (SELECT src, count(*) AS n FROM e GROUP BY src)"]
_STEPS += [
    f"s{k} AS MATERIALIZED (SELECT v.node, 0.15::DOUBLE / (SELECT count(*) FROM v) + 0.85::DOUBLE * coalesce(r.part, 0) AS score FROM v LEFT JOIN (SELECT e.dst, sum(s.score / o.n) AS part FROM e JOIN o ON e.src = o.src JOIN s{k - 1} s ON s.node = e.src GROUP BY e.dst) r ON r.dst = v.node)"
    for k in range(1, 21)
]
_RANK = f"WITH {_EDGES}, {', '.join(_STEPS)}"
_SCORE = "(priority * 100 - depth * 10 + CASE WHEN depth = 0 THEN 1000 ELSE 0 END)"
_D = DEDUP_SQL
_AGE = f"(epoch_us(TIMESTAMPTZ '{AS_OF}+00') // 1000000 - epoch_us(r.last_crawled_at) // 1000000)"
SQL = {
    "unique_urls": f"SELECT dedup_key, url, depth, priority, discovered_at FROM (SELECT *, {_D} AS dedup_key, row_number() OVER (PARTITION BY {_D} ORDER BY discovered_at, url, depth, priority) AS k FROM crawl_urls) WHERE k = 1",
    "unseen_urls": f"SELECT url, depth FROM crawl_urls WHERE {_D} NOT IN (SELECT {_D} FROM crawl_records WHERE url IS NOT NULL)",
    "dedup_stats": f"SELECT count(*) AS rows, count(DISTINCT {_D}) AS unique_urls FROM crawl_urls",
    "content_changes": """SELECT d.rec_id, d.url, 'sha256:' || sha256(d.content) AS fingerprint, CASE WHEN r.url IS NULL THEN 'first_crawl'
WHEN regexp_extract(lower(r.content_hash), '([0-9a-f]{64})\\s*$', 1) = sha256(d.content) THEN 'unchanged' ELSE 'changed' END AS change
FROM crawl_documents d LEFT JOIN crawl_records r ON d.url = r.url WHERE d.parent_document_id IS NULL""",
    "latest_documents": "SELECT uid, rec_id, crawled_at, title FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY crawled_at DESC, rec_id DESC) AS k FROM crawl_documents) WHERE k = 1",
    "frontier_top": f"SELECT url, depth, priority, discovered_at, {_SCORE} AS score FROM crawl_urls ORDER BY {_SCORE} DESC, url, depth NULLS FIRST, priority NULLS FIRST, discovered_at NULLS FIRST LIMIT 100",
    "levelled_frontier": """WITH q AS (SELECT DISTINCT url, priority, CASE WHEN priority >= 10 THEN 'high' WHEN priority >= 0 THEN 'normal' ELSE 'low' END AS level FROM crawl_urls),
p AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY priority DESC, url) AS position FROM q)
SELECT url, priority, level, ((position - 1) // CASE level WHEN 'high' THEN 5 WHEN 'normal' THEN 3 ELSE 1 END)::BIGINT AS turn, position FROM p""",
    "politeness": f"""WITH q AS (SELECT DISTINCT url, priority, discovered_at, {DOMAIN_SQL} AS domain FROM crawl_urls)
SELECT *, (position - 1) * 1000 AS wait_ms FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY priority DESC, url, discovered_at) AS position FROM q)""",
    "recrawl": f"""WITH j AS (SELECT u.url, u.depth, r.url AS known, coalesce({_AGE}, 1099511627776) AS age, CASE WHEN r.crawl_count > 0 THEN r.change_count / r.crawl_count ELSE 0 END AS rate, r.recrawl_interval_secs AS i, r.etag, r.last_modified
FROM crawl_urls u LEFT JOIN crawl_records r ON lower(trim(u.url)) = lower(trim(r.url))),
k AS (SELECT *, CASE WHEN known IS NULL THEN 'first_crawl' WHEN age < 3600 THEN 'too_recent' WHEN age >= 604800 THEN 'max_age' WHEN age >= i AND rate > 0.5 THEN 'high_change_rate' WHEN age >= i THEN 'interval_elapsed' ELSE 'not_due' END AS reason FROM j)
SELECT url, depth, CASE WHEN reason IN ('too_recent', 'not_due') THEN 'skip' ELSE 'crawl' END AS decision, reason,
(CASE reason WHEN 'max_age' THEN 5 WHEN 'high_change_rate' THEN trunc(10.0 * rate) ELSE 0 END)::INT AS priority_boost,
CASE reason WHEN 'too_recent' THEN 3600 - age WHEN 'not_due' THEN i - age END AS retry_after,
reason NOT IN ('too_recent', 'not_due', 'first_crawl') AND (etag IS NOT NULL OR last_modified IS NOT NULL) AS use_conditional FROM k""",
    "history_stats": "SELECT count(*) AS tracked_urls, sum(crawl_count)::BIGINT AS total_crawls, sum(change_count)::BIGINT AS total_changes, round(avg(CASE WHEN crawl_count > 0 THEN change_count / crawl_count ELSE 0 END), 6) AS avg_change_rate, floor(avg(recrawl_interval_secs))::BIGINT AS avg_interval_secs FROM crawl_records",
    "link_degrees": f"WITH {_EDGES} SELECT node, coalesce(i.n, 0) AS inbound, coalesce(o.n, 0) AS outbound FROM v LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY 1) i ON i.dst = node LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY 1) o ON o.src = node",
    "most_linked": f"WITH {_EDGES} SELECT node, coalesce(i.n, 0) AS inbound, coalesce(o.n, 0) AS outbound FROM v LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY 1) i ON i.dst = node LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY 1) o ON o.src = node ORDER BY inbound DESC, node LIMIT 20",
    "pagerank": f"{_RANK} SELECT node, round(score, 9) AS score FROM s20",
    "boosted_frontier": f"""{_RANK}, q AS (SELECT DISTINCT url, priority, {_KEY} AS node FROM crawl_urls),
b AS (SELECT url, priority, CASE WHEN score IS NULL OR score < 0.0001 THEN 0 ELSE least(greatest(trunc(ln(1 + score * (SELECT count(*) FROM v)) * 10), 0), 50) END::INT AS boost FROM q LEFT JOIN (SELECT node, round(score, 9) AS score FROM s20) USING (node))
SELECT url, priority, boost, priority + boost AS boosted FROM b""",
    "site_map": f"""WITH RECURSIVE {_EDGES}, r AS (SELECT DISTINCT {_KEY} AS node, 0 AS depth FROM crawl_urls WHERE depth = 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 5)
SELECT node, min(depth) AS depth FROM r GROUP BY node""",
    "link_components": f"""WITH RECURSIVE {_EDGES}, b AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e),
r AS (SELECT node, node AS c FROM v UNION SELECT b.y, r.c FROM r JOIN b ON b.x = r.node) SELECT node, min(c) AS component FROM r GROUP BY node""",
    "crawl_history": """WITH f AS (SELECT lower(trim(url)) AS url, sha256(html) AS h, fetched_at, page_id, row_number() OVER w AS n, lag(sha256(html)) OVER w AS old FROM raw_pages WINDOW w AS (PARTITION BY lower(trim(url)) ORDER BY fetched_at, page_id)),
g AS (SELECT url, count(*) AS crawl_count, coalesce(list(CASE WHEN coalesce(h = old, false) THEN 0 ELSE 1 END ORDER BY n) FILTER (WHERE n > 1), []) AS s, max(n) AS last FROM f GROUP BY url)
SELECT g.url, crawl_count, coalesce(list_sum(s), 0)::INT AS change_count,
list_reduce(list_prepend(86400.0::DOUBLE, list_transform(s, lambda v: v::DOUBLE)), lambda a, v: CASE WHEN v = 1 THEN greatest(floor(a * 0.5), 3600) ELSE least(floor(a * 1.5), 604800) END)::BIGINT AS recrawl_interval_secs,
f.fetched_at AS last_crawled_at, f.h AS content_hash FROM g JOIN f ON f.url = g.url AND f.n = g.last""",
    "graph_stats": f"""{_RANK}, d AS (SELECT node, coalesce(i.n, 0) AS inbound, coalesce(o.n, 0) AS outbound FROM v LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY 1) i ON i.dst = node LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY 1) o ON o.src = node)
SELECT count(*) AS pages, sum(outbound)::BIGINT AS links, round(min(score), 9) AS min_score, round(max(score), 9) AS max_score, round(avg(score), 9) AS avg_score, min(inbound) AS min_inbound, max(inbound) AS max_inbound, round(avg(inbound), 9) AS avg_inbound FROM d JOIN s20 USING (node)""",
}
