"""Job states folded from crawl events, their summary, and one round of the crawl loop put together from the frontier's operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.urls import extract_domain, graph_key, normalize_domain
from skeinwork.operators import frontier, graph

# fixed values: the state each lifecycle event leads to
STATES = {"job_started": "running", "job_resumed": "running", "job_paused": "paused", "job_completed": "completed", "job_failed": "failed", "job_cancelled": "cancelled"}


def job_states(events: DataFrame, max_pages: Column | int | None = None) -> DataFrame:
    """``job_id, status, pages_crawled, documents_indexed, errors, started_ms, ended_ms, crawl_rate, eta_secs`` of every job.

    events: type, job_id, timestamp (ms), and of completions pages_crawled, documents_indexed, duration_secs. The latest lifecycle event
    gives the state (pending without any; of equal times the completion, failure or cancellation); a completion's counts
    replace the counted ones. The rate is per second since the start, or over the told duration; eta is what is left of max_pages at that
    rate, for running jobs only. Everything is a sum, a minimum or a greatest value, so order and late rows make no difference and
    a job with most events costs one row per task. Events without a job are left out.
    """
    kind = F.col("type")
    state = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in STATES.items()])
    told = F.when(kind == "job_completed", F.struct("timestamp", "pages_crawled", "documents_indexed", "duration_secs"))
    last = F.max(F.when(state.isNotNull(), F.struct(F.col("timestamp").alias("at"), (~state.isin("running", "paused")).alias("final"), state.alias("state"))))
    sums = events.filter(F.col("job_id").isNotNull()).groupBy("job_id").agg(
        last.alias("last"),
        F.max(told).alias("told"),
        F.count_if(kind == "page_crawled").alias("pages"),
        F.count_if(kind == "document_indexed").alias("documents"),
        F.count_if(kind == "page_failed").alias("errors"),
        F.min(F.when(kind == "job_started", F.col("timestamp"))).alias("started_ms"),
        F.max(F.when(kind.isin("page_crawled", "page_failed", "document_indexed"), F.col("timestamp"))).alias("active_ms"),
    )
    done = F.col("last.state") == "completed"
    pages = F.when(done, F.coalesce("told.pages_crawled", "pages")).otherwise(F.col("pages"))
    secs = F.floor((F.col("active_ms") - F.col("started_ms")) / 1000)
    secs = F.when(done & (F.col("told.duration_secs") > 0), F.col("told.duration_secs")).otherwise(secs)
    out = sums.select(
        "job_id",
        F.coalesce("last.state", F.lit("pending")).alias("status"),
        pages.alias("pages_crawled"),
        F.when(done, F.coalesce("told.documents_indexed", "documents")).otherwise(F.col("documents")).alias("documents_indexed"),
        "errors",
        "started_ms",
        F.when(F.col("last.final"), F.col("last.at")).alias("ended_ms"),
        F.when(secs > 0, F.round(pages / secs, 6)).otherwise(F.lit(0.0)).alias("crawl_rate"),
    )
    most = F.lit(None).cast("long") if max_pages is None else F.lit(max_pages) if isinstance(max_pages, int) else max_pages
    eta = F.when((F.col("status") == "running") & (F.col("crawl_rate") > 0), F.ceil(F.greatest(most - F.col("pages_crawled"), F.lit(0)) / F.col("crawl_rate")))
    return out.withColumn("eta_secs", eta)


def job_summary(states: DataFrame) -> DataFrame:
    """One row: jobs in all, running, completed, failed (with cancelled) and pending (with paused)."""
    s = F.col("status")
    return states.agg(F.count("*").alias("total"), F.count_if(s == "running").alias("running"), F.count_if(s == "completed").alias("completed"), F.count_if(s.isin("failed", "cancelled")).alias("failed"), F.count_if(s.isin("pending", "paused")).alias("pending"))


def lifecycle_events(events: DataFrame) -> DataFrame:
    """The events that change a job's state."""
    return events.filter(F.col("type").isin(*STATES))


def crawl_round(frontier_rows: DataFrame, history: DataFrame, scores: DataFrame, as_of: str, n: int, max_depth: int | None = None, delay_ms: int = 1000) -> DataFrame:
    """One round of the loop: re-crawl decisions, link-rank boosts, admission by depth, the best n, and when each may be fetched.

    frontier_rows: url, depth, priority, discovered_at; scores: node, score. The rows dispatched, with ``reason, use_conditional,
    wait_ms``; for a stream hand it to ``folds.run_batches``. The pages of the graph are counted while the query is built.
    """
    rows = frontier.recrawl_decisions(frontier_rows.select("url", "depth", "priority", "discovered_at"), history, as_of)
    ranked = scores.select(F.col("node").alias("__node"), graph.priority_boost(F.col("score"), scores.count()).alias("__boost"))
    due = rows.filter("decision = 'crawl'").join(ranked, graph_key("url") == F.col("__node"), "left")
    due = due.withColumn("priority", F.col("priority") + F.col("priority_boost") + F.coalesce("__boost", F.lit(0)))
    best = frontier.pop(frontier.admit(due, max_depth).select("url", "depth", "priority", "discovered_at", "reason", "use_conditional"), n)
    return frontier.politeness_schedule(best.withColumn("domain", normalize_domain(extract_domain("url"))), delay_ms).drop("score", "position")
