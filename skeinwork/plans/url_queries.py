"""URL-plane queries over crawl_urls, raw_pages and crawl_records, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions import urls as U
from skeinwork.session import table

_SER = r"""(CASE WHEN regexp_matches({u}, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+') THEN
lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) || '://' ||
(CASE WHEN lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) = 'http' THEN regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), ':(80)?$', '')
WHEN lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) = 'https' THEN regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), ':(443)?$', '')
ELSE lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)) END) ||
(CASE WHEN starts_with(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*)$', 1), '/') THEN '' ELSE '/' END) || regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(.*)$', 1) ELSE {u} END)"""
_NOFRAG = "regexp_replace(lower(url), '#.*$', '')"
_BODY = f"regexp_replace({_NOFRAG}, '/+$', '')"
_STRIP = f"(CASE WHEN length({_NOFRAG}) > length({_BODY}) THEN {_BODY} || repeat('/', greatest(0, least(length({_NOFRAG}) - length({_BODY}), 2 - (length({_BODY}) - length(replace({_BODY}, '/', '')))))::INT) ELSE {_NOFRAG} END)"
DEDUP_SQL = f"regexp_replace({_SER.format(u=_STRIP)}, '\\?.*$', '')"
_CRAWL = f"regexp_replace({_SER.format(u='trim(url)')}, '[?#].*$', '')"
CRAWL_SQL = f"(CASE WHEN regexp_matches({_CRAWL}, '^https?://') THEN CASE WHEN regexp_matches({_CRAWL}, '^https?://[^/]*/$') THEN {_CRAWL} ELSE regexp_replace({_CRAWL}, '/$', '') END END)"
_G = "regexp_replace(trim(url), '#.*$', '')"
GRAPH_SQL = f"(CASE WHEN ends_with({_G}, '/') AND length({_G}) - length(replace({_G}, '/', '')) > 3 THEN regexp_replace({_G}, '/$', '') ELSE {_G} END)"
_HOST = r"regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':\d*$', '')"
DOMAIN_SQL = f"(CASE WHEN {_HOST} <> '' THEN lower({_HOST}) ELSE string_split(regexp_replace(url, '^(http://)+|^(https://)+', ''), '/')[1] END)"
_EXT = r"lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\.([^.]*)$', 1))"
_LIST = ", ".join(f"'{x}'" for x in U.NON_PAGE)
INCLUDE, EXCLUDE = ["https://**", "http*belmikul*"], ["**/blog/", "*/docs/*", "https://**.html"]


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "crawl_urls")


def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = U.extract_domain("url")
    return _urls(spark, sf_dir).select(
        "url",
        U.dedup_key("url").alias("dedup_key"),
        U.crawl_url("url").alias("crawl_url"),
        U.graph_key("url").alias("graph_key"),
        U.history_key("url").alias("history_key"),
        U.map_key("url").alias("map_key"),
        d.alias("domain"),
        U.normalize_domain(d).alias("plain_domain"),
        U.registered_domain(U.normalize_domain(d)).alias("registered_domain"),
        U.index_name("url").alias("index_name"),
        U.document_uid("url").alias("uid"),
        U.store_key("url").alias("store_key"),
    )


def url_tag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("url").distinct().select("url", F.explode(U.url_tags("url")).alias("tag"))


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _urls(spark, sf_dir)
    parent = U.extract_domain(F.coalesce("parent_url", "url"))
    return rows.select(
        "url",
        "parent_url",
        U.is_non_page("url").alias("non_page"),
        U.is_skipped_link("url").alias("skipped"),
        U.is_fetchable("url").alias("fetchable"),
        U.in_scope(U.extract_domain("url"), parent).alias("in_scope"),
        U.admitted("url", INCLUDE, EXCLUDE).alias("admitted"),
        U.admitted("url", INCLUDE[:1], EXCLUDE[2:], sitemap=True).alias("in_sitemap_scope"),
    )


def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "request_events").select(F.concat(F.col("status_code").cast("string"), F.lit(" "), "error").alias("a"), F.concat(F.lit("HTTP  "), F.col("status_code").cast("string")).alias("b"), F.concat(F.lit("status: "), F.col("duration_ms").cast("string")).alias("c"))
    m = e.select(F.explode(F.array("a", "b", "c")).alias("message"))
    return m.withColumn("code", U.error_status("message")).groupBy("code").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (url_keys, url_tag_rows, url_filters, error_codes)}

_ADMIT = r"((starts_with(url, 'https://')) OR regexp_matches(url, '^[^/]*?http[^/]*?belmikul')) AND NOT ends_with(url, '/blog/') AND NOT {docs} AND NOT (starts_with(url, 'https://') AND ends_with(url, '.html'))"
_DOCS = "(strpos(url, '/docs/') > 0 AND strpos(left(url, strpos(url, '/docs/') - 1), '/') = 0)"
_PLAIN = f"regexp_replace({DOMAIN_SQL}, '^www\\.', '')"
_UID = "lower(sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(url)))"
SQL = {
    "url_keys": f"""WITH k AS (SELECT url, {DEDUP_SQL} AS dedup_key, {CRAWL_SQL} AS crawl_url, {GRAPH_SQL} AS graph_key, lower(trim(url)) AS history_key,
regexp_replace({_SER.format(u='url')}, '#.*$', '') AS map_key, {DOMAIN_SQL} AS domain, {_PLAIN} AS plain_domain,
substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(url), '^(https://)+', ''), '^(http://)+', ''), '^(www\\.)+', ''), '/+$', ''), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 511) AS index_name, {_UID} AS h FROM crawl_urls)
SELECT url, dedup_key, crawl_url, graph_key, history_key, map_key, domain, plain_domain,
CASE WHEN len(string_split(plain_domain, '.')) <= 2 THEN plain_domain WHEN array_to_string(string_split(plain_domain, '.')[-2:], '.') IN ('co.uk', 'co.jp', 'com.au', 'co.nz', 'com.br') THEN array_to_string(string_split(plain_domain, '.')[-3:], '.') ELSE array_to_string(string_split(plain_domain, '.')[-2:], '.') END AS registered_domain,
index_name, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uid,
'pages/' || domain || '/' || substr(sha256(url), 1, 16) || '.html' AS store_key FROM k""",
    "url_tag_rows": r"""WITH s AS (SELECT url, list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM (SELECT DISTINCT url FROM crawl_urls))
SELECT url, '/' || array_to_string(p[1:i], '/') AS tag FROM s, generate_series(1, 50) AS g(i) WHERE i <= len(p)""",
    "url_filters": f"""SELECT url, parent_url, {_EXT} IN ({_LIST}) AS non_page, (trim(url) = '' OR regexp_matches(trim(url), '^(javascript:|mailto:|tel:|data:|#)')) AS skipped,
regexp_matches(url, '^https?://') AND regexp_extract(url, '^https?://([^/?#]*)', 1) <> '' AND NOT regexp_matches(regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^.*@', ''), '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}(:\\d*)?$|^\\[') AS fetchable,
(dom = base OR ends_with(dom, '.' || base)) AS in_scope, {_ADMIT.format(docs=_DOCS)} AS admitted, starts_with(url, 'https://') AND NOT (starts_with(url, 'https://') AND ends_with(url, '.html')) AS in_sitemap_scope
FROM (SELECT url, parent_url, {_PLAIN} AS dom, {_PLAIN.replace('url', 'coalesce(parent_url, url)')} AS base FROM crawl_urls)""",
    "error_codes": r"""WITH m AS (SELECT unnest([status_code || ' ' || error, 'HTTP  ' || status_code, 'status: ' || duration_ms]) AS message FROM request_events)
SELECT coalesce(nullif(regexp_extract(message, '^(\d{3})\s', 1), ''), nullif(regexp_extract(message, 'HTTP\s+(\d{3})', 1), ''), nullif(regexp_extract(message, 'status[:\s]+(\d{3})', 1), ''))::INT AS code, count(*) AS n FROM m GROUP BY 1""",
}
