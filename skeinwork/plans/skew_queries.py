"""Queries of problem 2 (a few hosts hold most rows) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions.hosts import host_of
from skeinwork.operators.skew import heavy_keys, keyed_run_states
from skeinwork.session import table

_HOST_SQL = r"nullif(regexp_replace(lower(regexp_replace(regexp_replace(regexp_extract(regexp_replace(trim(url), '^([a-zA-Z][a-zA-Z0-9+.\-]*:)?//', ''), '^[^/?#\\]*'), '^.*@', ''), ':\d*$', '')), '^www\.', ''), '')"


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "raw_pages").select(host_of("url").alias("host"), "fetched_at", "page_id")
    docs = table(spark, sf_dir, "crawl_documents").select(host_of("url").alias("host"), "crawled_at", "rec_id")
    a = heavy_keys(pages, "host", "fetched_at", "page_id", 0.03).withColumn("tbl", F.lit("raw_pages"))
    b = heavy_keys(docs, "host", "crawled_at", "rec_id", 0.03).withColumn("tbl", F.lit("crawl_documents"))
    return a.unionByName(b).select("tbl", F.col("key").alias("domain"))


def p2_host_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries of every host: rows, first and last fetch, longest pause between neighbouring fetches."""
    pages = table(spark, sf_dir, "raw_pages").select(host_of("url").alias("host"), "fetched_at", "page_id")
    s = keyed_run_states(pages, "host", "fetched_at", "page_id")
    return s.select(
        F.col("key").alias("domain"),
        F.col("n").alias("n_rows"),
        F.col("first_at").alias("first_us"),
        F.col("last_at").alias("last_us"),
        F.col("max_gap").alias("longest_pause_us"),
    )


def p2_host_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same profile of the extracted documents."""
    docs = table(spark, sf_dir, "crawl_documents").select(host_of("url").alias("host"), "crawled_at", "rec_id")
    s = keyed_run_states(docs, "host", "crawled_at", "rec_id")
    return s.select(
        F.col("key").alias("domain"),
        F.col("n").alias("n_rows"),
        F.col("first_at").alias("first_us"),
        F.col("last_at").alias("last_us"),
        F.col("max_gap").alias("longest_pause_us"),
    )


def _profile_sql(tbl: str, at: str) -> str:
    return f"""
WITH h AS (SELECT {_HOST_SQL} AS domain, epoch_us({at}) AS us FROM {tbl}),
g AS (SELECT domain, us, us - lag(us) OVER (PARTITION BY domain ORDER BY us) AS gap FROM h)
SELECT domain, count(*) AS n_rows, min(us) AS first_us, max(us) AS last_us, max(gap) AS longest_pause_us
FROM g GROUP BY domain"""


QUERIES = {"p2_found": p2_found, "p2_host_profile": p2_host_profile, "p2_host_documents": p2_host_documents}
SQL = {
    "p2_found": f"""
WITH h AS (SELECT 'raw_pages' AS tbl, {_HOST_SQL} AS domain FROM raw_pages
           UNION ALL SELECT 'crawl_documents', {_HOST_SQL} FROM crawl_documents),
n AS (SELECT tbl, count(*) AS total FROM h GROUP BY tbl)
SELECT h.tbl AS tbl, h.domain AS domain FROM h JOIN n ON h.tbl = n.tbl WHERE h.domain IS NOT NULL
GROUP BY h.tbl, h.domain, n.total HAVING count(*) >= 0.03 * n.total""",
    "p2_host_profile": _profile_sql("raw_pages", "fetched_at"),
    "p2_host_documents": _profile_sql("crawl_documents", "crawled_at"),
}
