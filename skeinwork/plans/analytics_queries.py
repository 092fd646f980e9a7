"""Analytics queries over request_events and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skeinwork.operators import analytics as A
from skeinwork.session import table

AS_OF = "2024-01-31 00:00:00"
HOURS = 24 * 40

_T = f"request_events WHERE timestamp >= TIMESTAMPTZ '{AS_OF}+00' - INTERVAL {HOURS} HOUR"
_M = """sum(pages_fetched)::BIGINT AS {0}, coalesce(sum(CASE WHEN status_code >= 200 AND status_code < 400 THEN pages_fetched END), 0)::BIGINT AS {1},
coalesce(sum(CASE WHEN status_code >= 400 OR status_code = 0 OR coalesce(error, '') <> '' THEN pages_fetched END), 0)::BIGINT AS {2},
round(avg(duration_ms), 6) AS avg_duration_ms, sum(content_length)::BIGINT AS total_bytes"""
_SHORT = _M.format("requests", "successes", "failures")
_LONG = _M.format("total_requests", "successful_requests", "failed_requests")
_USAGE = _LONG + """, count(DISTINCT domain) AS unique_domains, count(*) FILTER (WHERE js_rendered) AS js_renders,
sum(ai_prompt_tokens)::BIGINT AS ai_prompt_tokens, sum(ai_completion_tokens)::BIGINT AS ai_completion_tokens"""
_FAILED = "(status_code >= 400 OR status_code = 0 OR coalesce(error, '') <> '')"
_DAILY = """sum(pages_fetched)::BIGINT AS requests, sum(content_length)::BIGINT AS bytes, count(*) FILTER (WHERE js_rendered) AS js_renders,
sum(ai_prompt_tokens)::BIGINT AS ai_prompt_tokens, sum(ai_completion_tokens)::BIGINT AS ai_completion_tokens"""


def _rate(inner: str, ok: str, requests: str) -> str:
    return f"SELECT *, CASE WHEN {requests} > 0 THEN round({ok} * 100.0::DOUBLE / {requests}, 6) ELSE 0.0 END AS success_rate FROM ({inner})"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "request_events")


QUERIES = {
    "hourly_stats": lambda s, d: A.hourly_stats(_events(s, d), AS_OF, HOURS),
    "daily_stats": lambda s, d: A.daily_stats(_events(s, d), AS_OF, 40),
    "top_domains": lambda s, d: A.top_domains(_events(s, d), AS_OF, HOURS, 20),
    "domain_stats": lambda s, d: A.domain_stats(_events(s, d), AS_OF, None, HOURS),
    "domain_stats_missing": lambda s, d: A.domain_stats(_events(s, d), AS_OF, "no.such.domain", HOURS),
    "error_distribution": lambda s, d: A.error_distribution(_events(s, d), AS_OF, HOURS),
    "account_usage": lambda s, d: A.account_usage(_events(s, d), AS_OF, None, HOURS),
    "top_accounts": lambda s, d: A.top_accounts(_events(s, d), AS_OF, HOURS, 20),
    "account_daily_usage": lambda s, d: A.account_daily_usage(_events(s, d), AS_OF, None, 40),
    "account_daily_usage_by_operation": lambda s, d: A.account_daily_usage_by_operation(_events(s, d), AS_OF, None, 40),
    "api_key_usage": lambda s, d: A.api_key_usage(_events(s, d), AS_OF, None, HOURS),
    "job_timeline": lambda s, d: A.job_timeline(_events(s, d).select("job_id", "timestamp", "operation", "url", "status_code", "duration_ms", "pages_fetched"), None, 100),
    "job_stats": lambda s, d: A.job_stats(_events(s, d)),
    "job_event_summary": lambda s, d: A.job_event_summary(_events(s, d), None, "operation"),
    "ai_usage": lambda s, d: A.ai_usage(A.ai_usage_events(_events(s, d)), AS_OF, None, HOURS),
    "kpis": lambda s, d: A.kpis(_events(s, d), AS_OF, HOURS),
    "domain_diagnostics": lambda s, d: A.domain_diagnostics(_events(s, d), None, 20),
    "recent_errors_by_status": lambda s, d: A.recent_errors_by_status(_events(s, d), 100),
    "error_domains": lambda s, d: A.error_domains(_events(s, d), 10),
    "operation_totals": lambda s, d: A.operation_totals(_events(s, d)),
    "daily_filled": lambda s, d: A.daily_filled(_events(s, d), "2023-12-20", "2024-02-05"),
    "monitoring_windows": lambda s, d: A.rate_and_error_windows(_events(s, d)),
}
SQL = {
    "hourly_stats": _rate(f"SELECT date_trunc('hour', timestamp) AS hour, {_SHORT} FROM {_T} GROUP BY 1", "successes", "requests"),
    "daily_stats": _rate(f"SELECT timestamp::DATE AS date, {_SHORT} FROM {_T} GROUP BY 1", "successes", "requests"),
    "top_domains": _rate(f"SELECT domain, {_LONG} FROM {_T} GROUP BY 1 ORDER BY total_requests DESC, domain LIMIT 20", "successful_requests", "total_requests"),
    "domain_stats": _rate(f"SELECT domain, {_LONG} FROM {_T} GROUP BY 1", "successful_requests", "total_requests"),
    "domain_stats_missing": "SELECT 'no.such.domain' AS domain, 0::BIGINT AS total_requests, 0::BIGINT AS successful_requests, 0::BIGINT AS failed_requests, 0.0::DOUBLE AS avg_duration_ms, 0::BIGINT AS total_bytes, 0.0::DOUBLE AS success_rate",
    "error_distribution": f"SELECT status_code, count(*) AS count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percentage FROM {_T} AND (status_code >= 400 OR coalesce(error, '') <> '') GROUP BY 1",
    "account_usage": f"SELECT account_id, {_USAGE} FROM {_T} GROUP BY 1",
    "top_accounts": f"SELECT account_id, {_USAGE} FROM {_T} AND account_id <> '' GROUP BY 1 ORDER BY total_requests DESC, account_id LIMIT 20",
    "account_daily_usage": f"SELECT account_id, timestamp::DATE AS date, {_DAILY} FROM {_T} GROUP BY 1, 2",
    "account_daily_usage_by_operation": f"SELECT account_id, timestamp::DATE AS date, operation, {_DAILY} FROM {_T} GROUP BY 1, 2, 3",
    "api_key_usage": f"SELECT account_id, api_key_id, {_USAGE} FROM {_T} AND api_key_id <> '' GROUP BY 1, 2",
    "job_timeline": """SELECT * FROM (SELECT job_id, timestamp, operation, url, status_code, duration_ms, pages_fetched,
        row_number() OVER (PARTITION BY job_id ORDER BY timestamp DESC, operation NULLS FIRST, url NULLS FIRST, status_code NULLS FIRST, duration_ms NULLS FIRST, pages_fetched NULLS FIRST)::INT AS position
        FROM request_events) WHERE position <= 100""",
    "job_stats": f"SELECT *, (epoch_us(last_activity_at) // 1000000 - epoch_us(started_at) // 1000000) AS duration_secs FROM ({_rate(f'SELECT job_id, {_LONG}, count(DISTINCT domain) AS unique_domains, min(timestamp) AS started_at, max(timestamp) AS last_activity_at FROM request_events GROUP BY 1', 'successful_requests', 'total_requests')})",
    "job_event_summary": "SELECT job_id, operation AS event_type, count(*) AS event_count, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM request_events GROUP BY 1, 2",
    "ai_usage": f"SELECT ai_model AS model, count(*) AS total_calls, sum(ai_prompt_tokens)::BIGINT AS total_prompt_tokens, sum(ai_completion_tokens)::BIGINT AS total_completion_tokens, sum(ai_prompt_tokens + ai_completion_tokens)::BIGINT AS total_tokens, round(avg(duration_ms), 6) AS avg_duration_ms FROM {_T} AND coalesce(ai_model, '') <> '' GROUP BY 1",
    "kpis": f"""WITH d AS (SELECT domain, {_LONG}, avg(duration_ms) AS exact FROM {_T} GROUP BY 1)
SELECT sum(total_requests)::BIGINT AS total_requests, sum(successful_requests)::BIGINT AS successful_requests, sum(failed_requests)::BIGINT AS failed_requests,
round(sum(successful_requests) * 100.0::DOUBLE / sum(total_requests), 6) AS success_rate, round(sum(exact * total_requests) / sum(total_requests), 6) AS avg_duration_ms,
sum(total_bytes)::BIGINT AS total_bytes, count(*) AS unique_domains FROM d""",
    "domain_diagnostics": f"""SELECT domain, requests, successes, failures, (CASE WHEN successes > 0 THEN floor(total_ms / successes) ELSE 0 END)::BIGINT AS avg_ms FROM (
SELECT domain, count(*) AS requests, count(*) FILTER (WHERE status_code >= 200 AND status_code < 400) AS successes, count(*) FILTER (WHERE {_FAILED}) AS failures, sum(duration_ms) AS total_ms FROM request_events GROUP BY 1)
ORDER BY requests DESC, domain LIMIT 20""",
    "recent_errors_by_status": f"SELECT status_code, count(*) AS count FROM (SELECT status_code FROM request_events WHERE {_FAILED} ORDER BY timestamp DESC, url NULLS FIRST, status_code NULLS FIRST, error NULLS FIRST, job_id NULLS FIRST LIMIT 100) GROUP BY 1",
    "error_domains": f"SELECT domain, count(*) AS errors FROM request_events WHERE {_FAILED} GROUP BY 1 ORDER BY errors DESC, domain LIMIT 10",
    "operation_totals": "SELECT operation, grouping(operation)::INT AS is_total, sum(pages_fetched)::BIGINT AS requests, sum(content_length)::BIGINT AS bytes, sum(ai_prompt_tokens + ai_completion_tokens)::BIGINT AS tokens FROM request_events GROUP BY ROLLUP (operation)",
    "daily_filled": "SELECT d::DATE AS date, coalesce(p.pages, 0)::BIGINT AS pages FROM generate_series(DATE '2023-12-20', DATE '2024-02-05', INTERVAL 1 DAY) AS g(d) LEFT JOIN (SELECT timestamp::DATE AS date, sum(pages_fetched) AS pages FROM request_events GROUP BY 1) p ON p.date = d::DATE",
    "monitoring_windows": f"""WITH w AS (SELECT *, to_timestamp((floor(epoch(timestamp) / 900) - k) * 900) AS start FROM request_events, generate_series(0, 3) AS g(k))
SELECT start, count(*) AS n, count(*) FILTER (WHERE {_FAILED}) AS failures, round(count(*) FILTER (WHERE {_FAILED}) / count(*)::DOUBLE, 6) AS error_ratio,
round(quantile_cont(duration_ms, 0.5), 6) AS p50_ms, round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms FROM w GROUP BY 1""",
}
