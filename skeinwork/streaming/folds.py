"""Stateful folds over event streams: job counters, idle jobs, URL history, token buckets, request sessions, link ingest.

All work on event time. Rows later than the watermark are dropped. Each has a batch form with the same result on a finite input
in event order, which the tests compare.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from skeinwork.functions.urls import dedup_key

LEAST, MOST, DEFAULT = 3600, 7 * 24 * 3600, 24 * 3600
#: State whose last row is so much older (ms of event time) than the watermark is dropped; rows may be late by LATENESS.
HISTORY_TTL, BUCKET_TTL, DELAY_TTL = 30 * 24 * 3_600_000, 3_600_000, 24 * 3_600_000
LATENESS = "1 day"


def _timed(rows: DataFrame) -> DataFrame:
    """rows (with timestamp in ms) with a watermark, so that states can end; a timer of the clock would keep bounded runs alive."""
    return rows.withColumn("event_time", F.timestamp_millis("timestamp")).withWatermark("event_time", LATENESS)


def _keep(state: GroupState, value: tuple, last: int, ttl: int) -> None:
    state.update(value)
    state.setTimeoutTimestamp(max(last + ttl, state.getCurrentWatermarkMs() + 1))


def job_counters(events: DataFrame) -> DataFrame:
    """Counters of every job from crawl events (type, job_id, content_length, count, timestamp in ms), batch or stream.

    All are sums, minima and maxima, so late and repeated order make no difference; events without a job are left out.
    """
    kind = F.col("type")
    n = lambda t: F.count_if(kind == t)
    return events.filter(F.col("job_id").isNotNull()).groupBy("job_id").agg(
        n("page_crawled").alias("pages_crawled"),
        n("page_failed").alias("errors"),
        n("page_skipped").alias("skipped"),
        n("document_indexed").alias("documents_indexed"),
        F.coalesce(F.sum(F.when(kind == "urls_discovered", F.col("count"))), F.lit(0)).alias("urls_discovered"),
        F.coalesce(F.sum(F.when(kind == "page_crawled", F.col("content_length"))), F.lit(0)).alias("bytes_downloaded"),
        F.min("timestamp").alias("first_ms"),
        F.max("timestamp").alias("last_ms"),
    ).withColumn("crawl_rate", F.when(F.col("last_ms") > F.col("first_ms"), F.round(F.col("pages_crawled") * 1000.0 / (F.col("last_ms") - F.col("first_ms")), 6)).otherwise(F.lit(0.0)))


def idle_sessions(events: DataFrame, gap: str = "10 seconds", watermark: str = "1 minute", key: str = "job_id", at: str = "event_time") -> DataFrame:
    """Stretches of activity per key that ended with a pause of ``gap``: ``key, started, idle_at, events``. at: a timestamp."""
    rows = events.withWatermark(at, watermark) if events.isStreaming else events
    s = rows.groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("events"))
    return s.select(key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("idle_at"), "events")


def unique_stream(urls: DataFrame, url_col: str, at: str, within: str = "1 hour") -> DataFrame:
    """Rows whose address, de-duplicated, has not been seen within the watermark."""
    keyed = urls.withColumn("dedup_key", dedup_key(url_col))
    return keyed.withWatermark(at, within).dropDuplicatesWithinWatermark(["dedup_key"]) if urls.isStreaming else keyed.dropDuplicates(["dedup_key"])


_HISTORY = "url string, crawl_count long, change_count long, recrawl_interval_secs long, content_hash string, last_ms long"


def _step(state: tuple | None, content_hash: str | None, at: int) -> tuple:
    if state is None:
        return 1, 0, DEFAULT, content_hash, at
    crawls, changes, interval, old, _ = state
    changed = content_hash is None or content_hash != old
    interval = max(LEAST, int(interval * 0.5)) if changed else min(MOST, int(interval * 1.5))
    return crawls + 1, changes + changed, interval, content_hash, at


def history_stream(crawls: DataFrame, ttl: int = HISTORY_TTL) -> DataFrame:
    """Records of addresses (url, content_hash, timestamp in ms) as they change, in update mode; a record whose last crawl is ttl ms behind the watermark is forgotten."""

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = tuple(state.get) if state.exists else None
        if own is not None and own[-1] + ttl <= state.getCurrentWatermarkMs():  # over, but met by a new row before its end was due
            own = None
        rows = pd.concat(list(pdfs)).sort_values("timestamp", kind="stable")
        for h, at in zip(rows["content_hash"], rows["timestamp"]):
            own = _step(own, h if isinstance(h, str) else None, int(at))
        _keep(state, own, own[-1], ttl)
        yield pd.DataFrame([(key[0], *own)], columns=["url", "crawl_count", "change_count", "recrawl_interval_secs", "content_hash", "last_ms"])

    keyed = crawls.select(F.lower(F.trim("url")).alias("url"), "content_hash", "timestamp")
    return _timed(keyed).groupBy("url").applyInPandasWithState(fold, _HISTORY, "n long, c long, i long, h string, t long", "update", "EventTimeTimeout")


_BUCKET = "domain string, timestamp long, acquired boolean, wait_ms long"


def bucket_steps(rows: list[tuple[int, ...]], tokens: float | None, last: int | None, rate: float, burst: int) -> tuple[list[tuple[bool, int]], float, int]:
    """Verdicts for requests in time order: a token is taken if there is one, else the time to the next is told (10 ms at least).

    A refused request leaves the bucket as it is."""
    out = []
    tokens = float(burst) if tokens is None else tokens
    for (at, *_) in rows:
        available = min(float(burst), tokens + max(0, at - (at if last is None else last)) * rate / 1000.0)
        if available >= 1.0:
            tokens, last = available - 1.0, at
            out.append((True, 0))
        else:
            out.append((False, max(10, int((1.0 - available) / rate * 1000.0))))
    return out, tokens, last if last is not None else 0


def token_bucket_stream(requests: DataFrame, rate: float = 1.0, burst: int = 10) -> DataFrame:
    """``domain, timestamp, acquired, wait_ms`` of each request (domain, timestamp in ms) under a bucket per domain."""

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # a bucket that nobody asks for is full again
            state.remove()
            return
        tokens, last = tuple(state.get) if state.exists else (None, None)
        rows = pd.concat(list(pdfs)).sort_values("timestamp", kind="stable")
        verdicts, tokens, last = bucket_steps([(int(t),) for t in rows["timestamp"]], tokens, last, rate, burst)
        _keep(state, (tokens, last), int(rows["timestamp"].iloc[-1]), BUCKET_TTL)
        yield pd.DataFrame({"domain": key[0], "timestamp": rows["timestamp"].to_numpy(), "acquired": [v[0] for v in verdicts], "wait_ms": [v[1] for v in verdicts]})

    return _timed(requests.select("domain", "timestamp")).groupBy("domain").applyInPandasWithState(fold, _BUCKET, "tokens double, last long", "append", "EventTimeTimeout")


def request_sessions(requests: DataFrame, limit: int, key: str = "account_id", at: str = "event_time", gap: str = "60 seconds", watermark: str = "5 minutes") -> DataFrame:
    """Runs of requests without a pause of a minute, and how many of each were over the limit: the counter of a key lives on with
    every request, so it behaves like a session."""
    rows = requests.withWatermark(at, watermark) if requests.isStreaming else requests
    s = rows.groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("requests"))
    return s.select(key, F.col("session_window.start").alias("started"), "requests", F.greatest(F.col("requests") - F.lit(limit), F.lit(0)).alias("refused"))


def edges_of(messages: DataFrame) -> DataFrame:
    """``src, dst`` rows of link messages (source_url, target_urls)."""
    return messages.select(F.col("source_url").alias("src"), F.explode("target_urls").alias("dst")).filter("src <> dst")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Start a stream that hands every micro-batch to a function; available_now by default, so it ends when the input is read."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


_DELAY = "domain string, timestamp long, delay_ms long, paused boolean"
DELAY_DEFAULT, DELAY_MOST, PAUSE_AFTER = 1000, 30_000, 10


def delay_step(state: tuple[int, int, bool], status: int) -> tuple[int, int, bool]:
    """(delay, errors in a row, paused) of a domain after a request: success brings the delay a tenth nearer to the default;
    a refusal for rate (429), and any failure from the third in a row on, makes it half as long again; ten in a row pause."""
    delay, errors, paused = state
    if 200 <= status < 400:
        return (max(DELAY_DEFAULT, int(delay * 0.9)) if delay > DELAY_DEFAULT else delay), 0, paused
    errors += 1
    if status == 429 or errors >= 3:
        delay = min(DELAY_MOST, int(delay * 1.5))
    return delay, errors, paused or errors >= PAUSE_AFTER


def delay_stream(requests: DataFrame) -> DataFrame:
    """The delay of each domain after every micro-batch of its requests (domain, status_code, timestamp in ms)."""

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = tuple(state.get) if state.exists else (DELAY_DEFAULT, 0, False)
        rows = pd.concat(list(pdfs)).sort_values("timestamp", kind="stable")
        for status in rows["status_code"]:
            own = delay_step(own, int(status))
        _keep(state, own, int(rows["timestamp"].iloc[-1]), DELAY_TTL)
        yield pd.DataFrame([(key[0], int(rows["timestamp"].iloc[-1]), own[0], own[2])], columns=["domain", "timestamp", "delay_ms", "paused"])

    return _timed(requests.select("domain", "status_code", "timestamp")).groupBy("domain").applyInPandasWithState(fold, _DELAY, "delay long, errors long, paused boolean", "update", "EventTimeTimeout")
