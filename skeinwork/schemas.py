"""Schemas of the records in motion. Never inferred: what does not fit goes to the corrupt-record column."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


RAW_PAGE = "url string, final_url string, status int, headers map<string,string>, html string, content_type string, js_rendered boolean, fetched_at timestamp, fetch_duration_ms bigint"
CRAWL_URL = "url string, depth int, priority int, parent_url string, anchor_text string, discovered_at timestamp, retry_count int, requires_js boolean, etag string, last_modified string"
CRAWL_EVENT = """type string, job_id string, account_id string, index_uid string, start_urls array<string>, url string, source_url string, status int, content_length bigint,
duration_ms bigint, error string, retry_count int, document_id string, count bigint, domain string, wait_ms bigint, reason string, pages_crawled bigint, documents_indexed bigint,
errors bigint, bytes_downloaded bigint, duration_secs bigint, timestamp bigint"""
LINKS = "source_url string, target_urls array<string>, job_id string, timestamp bigint"
CRAWL_HISTORY = "url string, etag string, last_modified string, content_hash string, status int, content_length bigint, content_changed boolean, job_id string, timestamp bigint"
REQUEST_EVENT = """account_id string, api_key_id string, job_id string, operation string, url string, domain string, status_code int, duration_ms bigint, content_length bigint, error string,
js_rendered boolean, ai_summary boolean, ai_extraction boolean, ai_prompt_tokens bigint, ai_completion_tokens bigint, ai_model string, urls_found bigint, pages_fetched bigint,
search_query string, results_count bigint, timestamp timestamp"""

TOPICS = {"urls.frontier": CRAWL_URL, "pages.raw": RAW_PAGE, "events": CRAWL_EVENT, "links": LINKS, "crawl.history": CRAWL_HISTORY}


def topic_schema(topic: str) -> T.StructType:
    return _schema(TOPICS[topic])
