"""Queries of the event folds (in their batch form), keyed tables, sketches and groupings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import urls as U
from skeinwork.functions.sketches import simhash
from skeinwork.operators import analytics as A
from skeinwork.operators import frontier as Q
from skeinwork.operators import jobs as J
from skeinwork.operators import search as R
from skeinwork.operators import similarity as S
from skeinwork.operators.content import head_fields
from skeinwork.plans.content_queries import SQL as CONTENT_SQL
from skeinwork.plans.similarity_queries import SQL as _SKETCH_SQL
from skeinwork.plans.url_queries import DOMAIN_SQL
from skeinwork.session import table
from skeinwork.sources import stores
from skeinwork.streaming import folds

AS_OF = "2024-01-31 00:00:00"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "request_events")


def _crawl_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request events as crawl events: failures, pages, and the addresses that were found."""
    e = _events(spark, sf_dir).filter("job_id <> ''")
    kind = F.when((F.col("status_code") == 0) | (F.col("status_code") >= 400), "page_failed").when(F.col("status_code").isin(204, 304), "page_skipped").otherwise("page_crawled")
    ms = F.unix_millis("timestamp").alias("timestamp")
    pages = e.select(kind.alias("type"), "job_id", "content_length", F.lit(None).cast("bigint").alias("count"), ms)
    found = e.filter("urls_found > 0").select(F.lit("urls_discovered").alias("type"), "job_id", F.lit(None).cast("bigint").alias("content_length"), F.col("urls_found").alias("count"), ms)
    return pages.unionByName(found)


def job_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.job_counters(_crawl_events(spark, sf_dir))


def _lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl events with the start of every job, and its end: a failure where over 3 of 10 requests failed, else a completion if it is over."""
    e = _crawl_events(spark, sf_dir).filter("type <> 'urls_discovered'")
    per = e.groupBy("job_id").agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"), F.count("*").alias("n"), F.count_if(F.col("type") == "page_failed").alias("f"))
    none = F.lit(None).cast("bigint")
    end = F.when(F.col("f") * 10 > F.col("n") * 3, "job_failed").when(F.col("hi") < F.unix_millis(F.lit(AS_OF).cast("timestamp")), "job_completed")
    ends = per.select(end.alias("type"), "job_id", F.col("hi").alias("timestamp"), F.col("n").alias("pages_crawled"), none.alias("documents_indexed"), F.lit(0).cast("bigint").alias("duration_secs")).filter("type IS NOT NULL")
    starts = per.select(F.lit("job_started").alias("type"), "job_id", F.col("lo").alias("timestamp"))
    return e.select("type", "job_id", "timestamp").unionByName(starts).unionByName(ends, allowMissingColumns=True)


def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.job_states(_lifecycle(spark, sf_dir), 500)


def system_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.job_summary(J.job_states(_lifecycle(spark, sf_dir)))


def alert_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.alert_windows(_events(spark, sf_dir).select("domain", "timestamp", "status_code", "error"), ratio=0.2, hold=2)


def map_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, description = head_fields("html")
    pages = table(spark, sf_dir, "raw_pages").select("page_id", "url", title.alias("title"), description.alias("description"))
    return R.map_search(pages, "Archive", 40, "page_id")


def job_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of activity of each job that ended with a pause of six hours."""
    return folds.idle_sessions(_events(spark, sf_dir).withColumnRenamed("timestamp", "event_time"), "6 hours")


def account_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.request_sessions(_events(spark, sf_dir).withColumnRenamed("timestamp", "event_time"), 10, gap="2 hours")


def admitted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "crawl_urls").select("url", "depth", "priority").distinct()
    return Q.admit(rows, max_depth=3, max_pages=200)


def conditional_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of the frontier with the headers of their last crawl, if it is not older than 30 days."""
    r = stores.expire(table(spark, sf_dir, "crawl_records"), AS_OF, 30, "last_crawled_at").select(U.history_key("url").alias("key"), "etag", "last_modified")
    u = table(spark, sf_dir, "crawl_urls").select("url").distinct()
    return u.join(r, U.history_key(u["url"]) == r["key"], "left").select("url", "etag", "last_modified")


def upserted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl records with the latest delivery of each page put in."""
    old = table(spark, sf_dir, "crawl_records").select("url", F.col("last_crawled_at").alias("seen_at"), F.col("last_status").alias("status"))
    new = table(spark, sf_dir, "raw_pages").select("url", F.col("fetched_at").alias("seen_at"), "status", "page_id")
    return stores.upsert(old.withColumn("page_id", F.lit(None).cast("bigint")), new, "url", ["seen_at", "page_id"])


def inserted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known addresses and those of the frontier that are not known yet."""
    known = table(spark, sf_dir, "crawl_records").select("url")
    return stores.insert_missing(known, table(spark, sf_dir, "crawl_urls").select("url"), "url")


def registered_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = U.registered_domain(U.normalize_domain(U.extract_domain("url")))
    return table(spark, sf_dir, "crawl_urls").groupBy(d.alias("registered_domain")).agg(F.count("*").alias("urls"), F.countDistinct(U.extract_domain("url")).alias("hosts"))


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.index(table(spark, sf_dir, "documents"), "doc_id", "text")


def simhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.hamming_pairs(table(spark, sf_dir, "documents").select(simhash("text", "md5hex").alias("h")), "h", 3)


def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.simhash_clusters(table(spark, sf_dir, "documents").select("doc_id", simhash("text", "md5hex").alias("h")), "doc_id", "h", 3).select("id", "cluster")


def simhash_cluster_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster of the md5 form of the hash, its rows, and their mean similarity."""
    rows = S.simhash_clusters(table(spark, sf_dir, "documents").select("doc_id", simhash("text", "md5hex").alias("h")), "doc_id", "h", 3)
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.first("avg_similarity"), 6).alias("avg_similarity"))


def simhash_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequential filter over the md5 form of the hash."""
    return S.simhash_filter(table(spark, sf_dir, "documents").select("doc_id", simhash("text", "md5hex").alias("h")), "doc_id", "h")


QUERIES = {f.__name__: f for f in (job_counters, job_states, system_stats, alert_windows, map_pages, job_pauses, account_sessions, admitted_urls, conditional_headers, upserted_records, inserted_urls, registered_domains, search_index, simhash_pairs, simhash_groups, simhash_cluster_means, simhash_kept)}


def _sessions(key: str, us: int) -> str:
    return f"""g AS (SELECT {key}, timestamp AS t, CASE WHEN epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER w <= {us} THEN 0 ELSE 1 END AS fresh FROM request_events WINDOW w AS (PARTITION BY {key} ORDER BY timestamp)),
s AS (SELECT {key}, t, sum(fresh) OVER (PARTITION BY {key} ORDER BY t RANGE UNBOUNDED PRECEDING) AS no FROM g)"""


_PLAIN = f"regexp_replace({DOMAIN_SQL}, '^www\\.', '')"
_HASHES = f"h0 AS MATERIALIZED ({_SKETCH_SQL['simhash_md5']})"
_NEAR = "p AS MATERIALIZED (SELECT a.h AS a, b.h AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM d a JOIN d b ON a.h < b.h AND bit_count(xor(a.h, b.h)) <= 3)"
_STATES = f"""e AS (SELECT *, CASE WHEN status_code = 0 OR status_code >= 400 THEN 'f' WHEN status_code IN (204, 304) THEN 's' ELSE 'c' END AS k, epoch_ms(timestamp) AS ms FROM request_events WHERE job_id <> ''),
c AS (SELECT job_id, count(*) FILTER (WHERE k = 'c') AS pages, count(*) FILTER (WHERE k = 'f') AS errors, count(*) AS n, min(ms) AS lo, max(ms) AS hi, max(CASE WHEN k <> 's' THEN ms END) AS active FROM e GROUP BY 1),
s AS (SELECT *, CASE WHEN errors * 10 > n * 3 THEN 'failed' WHEN hi < epoch_ms(TIMESTAMP '{AS_OF}') THEN 'completed' ELSE 'running' END AS status, (active - lo) // 1000 AS secs FROM c),
j AS (SELECT job_id, status, CASE WHEN status = 'completed' THEN n ELSE pages END AS pages_crawled, 0::BIGINT AS documents_indexed, errors, lo AS started_ms, CASE WHEN status <> 'running' THEN hi END AS ended_ms,
CASE WHEN secs > 0 THEN round(CASE WHEN status = 'completed' THEN n ELSE pages END / secs, 6) ELSE 0.0 END AS crawl_rate FROM s)"""
SQL = {
    "job_states": f"WITH {_STATES} SELECT *, CASE WHEN status = 'running' AND crawl_rate > 0 THEN ceil(greatest(500 - pages_crawled, 0) / crawl_rate)::BIGINT END AS eta_secs FROM j",
    "system_stats": f"WITH {_STATES} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, 0::BIGINT AS pending FROM j",
    "alert_windows": """WITH b AS (SELECT domain, time_bucket(INTERVAL 5 MINUTE, timestamp) AS started, count(*) AS n, count(*) FILTER (WHERE status_code >= 400 OR status_code = 0 OR coalesce(error, '') <> '') AS f FROM request_events GROUP BY 1, 2)
SELECT domain, started, round(n / 300, 6) AS rate, round(f / n, 6) AS error_ratio, sum(n) OVER (PARTITION BY domain ORDER BY started RANGE BETWEEN INTERVAL 25 MINUTE PRECEDING AND CURRENT ROW)::BIGINT AS increase,
n - (SELECT o.n FROM b o WHERE o.domain = b.domain AND o.started = b.started - INTERVAL 10 MINUTE) AS delta,
sum(CASE WHEN f / n > 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY domain ORDER BY started RANGE BETWEEN INTERVAL 5 MINUTE PRECEDING AND CURRENT ROW) = 2 AS firing FROM b""",
    "map_pages": f"""WITH h AS ({CONTENT_SQL['head_metadata']}), p AS (SELECT page_id, url, h.title, h.description FROM raw_pages JOIN h USING (page_id))
SELECT * FROM p WHERE contains(lower(url), 'archive') OR coalesce(contains(lower(title), 'archive'), false) OR coalesce(contains(lower(description), 'archive'), false) ORDER BY CASE WHEN contains(lower(url), 'archive') THEN 0 ELSE 1 END, page_id LIMIT 40""",
    "job_counters": """WITH e AS (SELECT *, CASE WHEN status_code = 0 OR status_code >= 400 THEN 'f' WHEN status_code IN (204, 304) THEN 's' ELSE 'c' END AS k, epoch_ms(timestamp) AS ms FROM request_events WHERE job_id <> ''),
c AS (SELECT job_id, count(*) FILTER (WHERE k = 'c') AS pages_crawled, count(*) FILTER (WHERE k = 'f') AS errors, count(*) FILTER (WHERE k = 's') AS skipped, 0::BIGINT AS documents_indexed,
coalesce(sum(CASE WHEN urls_found > 0 THEN urls_found END), 0)::BIGINT AS urls_discovered, coalesce(sum(CASE WHEN k = 'c' THEN content_length END), 0)::BIGINT AS bytes_downloaded, min(ms) AS first_ms, max(ms) AS last_ms FROM e GROUP BY 1)
SELECT *, CASE WHEN last_ms > first_ms THEN round(pages_crawled * 1000.0::DOUBLE / (last_ms - first_ms), 6) ELSE 0.0 END AS crawl_rate FROM c""",
    "job_pauses": f"WITH {_sessions('job_id', 6 * 3600 * 10**6)} SELECT job_id, min(t) AS started, max(t) + INTERVAL 6 HOUR AS idle_at, count(*) AS events FROM s GROUP BY job_id, no",
    "account_sessions": f"WITH {_sessions('account_id', 2 * 3600 * 10**6)} SELECT account_id, min(t) AS started, count(*) AS requests, greatest(count(*) - 10, 0) AS refused FROM s GROUP BY account_id, no",
    "admitted_urls": "SELECT url, depth, priority FROM (SELECT DISTINCT url, depth, priority FROM crawl_urls WHERE depth <= 3) ORDER BY priority * 100 - depth * 10 + CASE WHEN depth = 0 THEN 1000 ELSE 0 END DESC, url, depth, priority LIMIT 200",
    "conditional_headers": f"SELECT u.url, r.etag, r.last_modified FROM (SELECT DISTINCT url FROM crawl_urls) u LEFT JOIN (SELECT * FROM crawl_records WHERE last_crawled_at IS NULL OR last_crawled_at >= TIMESTAMPTZ '{AS_OF}+00' - INTERVAL 30 DAY) r ON lower(trim(u.url)) = lower(trim(r.url))",
    "upserted_records": """WITH b AS (SELECT url, fetched_at AS seen_at, status, page_id, 1 AS fresh FROM raw_pages UNION ALL SELECT url, last_crawled_at, last_status, NULL, 0 FROM crawl_records)
SELECT url, seen_at, status, page_id FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fresh DESC, seen_at DESC, page_id DESC) AS k FROM b) WHERE k = 1""",
    "inserted_urls": "SELECT url FROM crawl_records UNION ALL SELECT DISTINCT url FROM crawl_urls WHERE url NOT IN (SELECT url FROM crawl_records)",
    "registered_domains": f"""WITH k AS (SELECT {DOMAIN_SQL} AS dom, {_PLAIN} AS p FROM crawl_urls)
SELECT CASE WHEN len(string_split(p, '.')) <= 2 THEN p WHEN array_to_string(string_split(p, '.')[-2:], '.') IN ('co.uk', 'co.jp', 'com.au', 'co.nz', 'com.br') THEN array_to_string(string_split(p, '.')[-3:], '.') ELSE array_to_string(string_split(p, '.')[-2:], '.') END AS registered_domain,
count(*) AS urls, count(DISTINCT dom) AS hosts FROM k GROUP BY 1""",
    "search_index": r"""WITH t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT id, len(w)::INT AS size, unnest(w) AS term FROM t) SELECT id, term, count(*) AS tf, any_value(size) AS size FROM e GROUP BY id, term""",
    "simhash_pairs": f"WITH {_HASHES}, d AS (SELECT DISTINCT h FROM h0 WHERE h IS NOT NULL), {_NEAR} SELECT a, b, distance FROM p",
    "simhash_kept": f"""WITH RECURSIVE {_HASHES}, o AS MATERIALIZED (SELECT doc_id, h, row_number() OVER (ORDER BY doc_id) AS k FROM h0 WHERE coalesce(h, 0) <> 0),
f AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS ids, []::BIGINT[] AS hs, NULL::BIGINT AS id, NULL::BIGINT AS hit, NULL::BIGINT AS h UNION ALL
SELECT q.k, CASE WHEN q.hit IS NULL THEN list_append(q.ids, q.id) ELSE q.ids END, CASE WHEN q.hit IS NULL THEN list_append(q.hs, q.h) ELSE q.hs END, q.id, q.hit, q.h FROM
(SELECT o.k, f.ids, f.hs, o.doc_id AS id, o.h, list_filter(range(1, len(f.hs) + 1), lambda i: bit_count(xor(f.hs[i], o.h)) <= 3)[1] AS hit FROM f JOIN o ON o.k = f.k + 1) q)
SELECT id, CASE WHEN hit IS NOT NULL THEN ids[hit] END AS duplicate_of, CASE WHEN hit IS NOT NULL THEN 1 - bit_count(xor(hs[hit], h)) / 64 END AS similarity FROM f WHERE id IS NOT NULL
UNION ALL SELECT doc_id, NULL, NULL FROM h0 WHERE coalesce(h, 0) = 0""",
    "simhash_groups": f"""WITH RECURSIVE {_HASHES}, d AS (SELECT DISTINCT h FROM h0 WHERE h IS NOT NULL), {_NEAR},
n AS (SELECT a AS x, b AS y FROM p UNION SELECT b, a FROM p), r AS (SELECT h AS node, h AS o FROM d UNION SELECT n.y, r.o FROM r JOIN n ON n.x = r.node),
m AS (SELECT h, min(doc_id) AS rep FROM h0 WHERE h IS NOT NULL GROUP BY h)
SELECT h0.doc_id AS id, (SELECT min(m.rep) FROM r JOIN m ON m.h = r.o WHERE r.node = h0.h) AS cluster FROM h0 WHERE h0.h IS NOT NULL""",
}
SQL["simhash_cluster_means"] = f"""WITH g AS MATERIALIZED ({SQL['simhash_groups']}), {_HASHES}, m AS MATERIALIZED (SELECT g.cluster, g.id, h0.h FROM g JOIN h0 ON h0.doc_id = g.id),
n AS (SELECT cluster, count(*) AS n FROM m GROUP BY 1), p AS (SELECT a.cluster, avg(1 - bit_count(xor(a.h, b.h)) / 64) AS mean FROM m a JOIN m b ON a.cluster = b.cluster AND a.id < b.id GROUP BY 1)
SELECT n.cluster, n.n, round(coalesce(p.mean, 1.0), 6) AS avg_similarity FROM n LEFT JOIN p USING (cluster)"""
