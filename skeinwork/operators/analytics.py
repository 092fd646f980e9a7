"""Usage analytics over request, job and AI-usage events (the parameterised pipes).

Every pipe takes the events and its parameters and returns a DataFrame; ``as_of`` stands for the present, so results do
not depend on the clock. Requests are ``sum(pages_fetched)``, not rows; empty strings and zeros stand for missing values, nulls
are read as such. Pipes named after one account, job or domain give every one of them when that is None.
Orders of equal measures are settled by the key, so limits are deterministic. Empty tables give no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ok() -> Column:
    return (F.col("status_code") >= 200) & (F.col("status_code") < 400)


def _failed() -> Column:
    return (F.col("status_code") >= 400) | (F.col("status_code") == 0) | (F.coalesce(F.col("error"), F.lit("")) != "")


def _sum_if(value: str, condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0))


def _since(events: DataFrame, as_of: datetime | str, hours: int | None) -> DataFrame:
    """Events of the last hours before as_of; the month bounds are spelled out so that monthly partitions are pruned."""
    if hours is None:
        return events
    start = F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(hours))
    return events.filter(F.col("timestamp") >= start)


def _measures(names: tuple[str, str, str]) -> list[Column]:
    return [
        F.sum("pages_fetched").alias(names[0]),
        _sum_if("pages_fetched", _ok()).alias(names[1]),
        _sum_if("pages_fetched", _failed()).alias(names[2]),
        F.round(F.avg("duration_ms"), 6).alias("avg_duration_ms"),
        F.sum("content_length").alias("total_bytes"),
    ]


_SHORT = ("requests", "successes", "failures")
_LONG = ("total_requests", "successful_requests", "failed_requests")


def success_rate(ok: Column, requests: Column) -> Column:
    """Percentage of successful requests; 0 without requests."""
    return F.when(requests > 0, F.round(ok * 100.0 / requests, 6)).otherwise(F.lit(0.0))


def _with_rate(df: DataFrame, names: tuple[str, str, str]) -> DataFrame:
    return df.withColumn("success_rate", success_rate(F.col(names[1]), F.col(names[0])))


def hourly_stats(events: DataFrame, as_of: datetime | str, hours: int = 24) -> DataFrame:
    by = _since(events, as_of, hours).groupBy(F.date_trunc("hour", "timestamp").alias("hour"))
    return _with_rate(by.agg(*_measures(_SHORT)), _SHORT)


def daily_stats(events: DataFrame, as_of: datetime | str, days: int = 30) -> DataFrame:
    by = _since(events, as_of, 24 * days).groupBy(F.to_date("timestamp").alias("date"))
    return _with_rate(by.agg(*_measures(_SHORT)), _SHORT)


def _domain_measures(events: DataFrame, as_of: datetime | str, hours: int | None) -> DataFrame:
    return _with_rate(_since(events, as_of, hours).groupBy("domain").agg(*_measures(_LONG)), _LONG)


def top_domains(events: DataFrame, as_of: datetime | str, hours: int = 24, limit: int = 20) -> DataFrame:
    return _domain_measures(events, as_of, hours).orderBy(F.desc("total_requests"), "domain").limit(limit)


def domain_stats(events: DataFrame, as_of: datetime | str, domain: str | None = None, hours: int = 24) -> DataFrame:
    """One row per domain, or the row of one domain (of zeros if it has no events)."""
    if domain is None:
        return _domain_measures(events, as_of, hours)
    found = _domain_measures(events.filter(F.col("domain") == domain), as_of, hours)
    return _zero_row(found, {"domain": domain})


def _zero_row(found: DataFrame, keys: dict[str, str]) -> DataFrame:
    """found, or one row of its keys and zeros if it is empty."""
    spark = found.sparkSession
    name = next(iter(keys))
    base = spark.range(1).select(*[F.lit(v).alias(k) for k, v in keys.items()])
    joined = base.join(found.withColumnRenamed(name, "__key"), F.col(name) == F.col("__key"), "left").drop("__key")
    return joined.select(*[F.col(c) if c in keys else F.coalesce(F.col(c), F.lit(0)).alias(c) for c in found.columns])


def error_distribution(events: DataFrame, as_of: datetime | str, hours: int = 24) -> DataFrame:
    """Rows per status among failures (status 0 without an error text is none), with their share of all failures."""
    bad = _since(events, as_of, hours).filter((F.col("status_code") >= 400) | (F.coalesce(F.col("error"), F.lit("")) != ""))
    counts = bad.groupBy("status_code").agg(F.count("*").alias("count"))
    whole = Window.partitionBy()  # one row per status code
    return counts.withColumn("percentage", F.round(F.col("count") * 100.0 / F.sum("count").over(whole), 6))


def _usage_measures() -> list[Column]:
    return [
        *_measures(_LONG),
        F.countDistinct("domain").alias("unique_domains"),
        F.count_if(F.col("js_rendered")).alias("js_renders"),
        F.sum("ai_prompt_tokens").alias("ai_prompt_tokens"),
        F.sum("ai_completion_tokens").alias("ai_completion_tokens"),
    ]


def account_usage(events: DataFrame, as_of: datetime | str, account: str | None = None, hours: int = 24) -> DataFrame:
    own = _since(events, as_of, hours)
    if account is None:
        return own.groupBy("account_id").agg(*_usage_measures())
    return _zero_row(own.filter(F.col("account_id") == account).groupBy("account_id").agg(*_usage_measures()), {"account_id": account})


def top_accounts(events: DataFrame, as_of: datetime | str, hours: int = 24, limit: int = 20) -> DataFrame:
    own = _since(events, as_of, hours).filter(F.col("account_id") != "")
    return own.groupBy("account_id").agg(*_usage_measures()).orderBy(F.desc("total_requests"), "account_id").limit(limit)


def _daily(events: DataFrame, as_of: datetime | str, account: str | None, days: int, keys: list[str]) -> DataFrame:
    own = _since(events, as_of, 24 * days)
    if account is not None:
        own = own.filter(F.col("account_id") == account)
    return own.groupBy("account_id", F.to_date("timestamp").alias("date"), *keys).agg(
        F.sum("pages_fetched").alias("requests"),
        F.sum("content_length").alias("bytes"),
        F.count_if(F.col("js_rendered")).alias("js_renders"),
        F.sum("ai_prompt_tokens").alias("ai_prompt_tokens"),
        F.sum("ai_completion_tokens").alias("ai_completion_tokens"),
    )


def account_daily_usage(events: DataFrame, as_of: datetime | str, account: str | None = None, days: int = 30) -> DataFrame:
    return _daily(events, as_of, account, days, [])


def account_daily_usage_by_operation(events: DataFrame, as_of: datetime | str, account: str | None = None, days: int = 30) -> DataFrame:
    return _daily(events, as_of, account, days, ["operation"])


def api_key_usage(events: DataFrame, as_of: datetime | str, account: str | None = None, hours: int = 24) -> DataFrame:
    own = _since(events, as_of, hours).filter(F.col("api_key_id") != "")
    if account is not None:
        own = own.filter(F.col("account_id") == account)
    return own.groupBy("account_id", "api_key_id").agg(*_usage_measures())


def job_timeline(events: DataFrame, job: str | None = None, limit: int = 100) -> DataFrame:
    """The latest events of each job (of one job), newest first; equal times are settled by all columns."""
    own = events if job is None else events.filter(F.col("job_id") == job)
    order = [F.desc("timestamp"), *[F.col(c).asc_nulls_first() for c in events.columns if c not in ("timestamp", "job_id")]]
    return own.withColumn("position", F.row_number().over(Window.partitionBy("job_id").orderBy(*order))).filter(F.col("position") <= limit)


def job_stats(events: DataFrame, job: str | None = None) -> DataFrame:
    own = events if job is None else events.filter(F.col("job_id") == job)
    stats = own.groupBy("job_id").agg(*_measures(_LONG), F.countDistinct("domain").alias("unique_domains"), F.min("timestamp").alias("started_at"), F.max("timestamp").alias("last_activity_at"))
    return _with_rate(stats, _LONG).withColumn("duration_secs", F.unix_seconds("last_activity_at") - F.unix_seconds("started_at"))


def job_event_summary(events: DataFrame, job: str | None = None, type_col: str = "event_type") -> DataFrame:
    own = events if job is None else events.filter(F.col("job_id") == job)
    return own.groupBy("job_id", F.col(type_col).alias("event_type")).agg(F.count("*").alias("event_count"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def ai_usage(events: DataFrame, as_of: datetime | str, account: str | None = None, hours: int = 24) -> DataFrame:
    """events: AI usage (model, prompt_tokens, completion_tokens, total_tokens, duration_ms, account_id, timestamp)."""
    own = _since(events, as_of, hours)
    if account:
        own = own.filter(F.col("account_id") == account)
    return own.groupBy("model").agg(
        F.count("*").alias("total_calls"),
        F.sum("prompt_tokens").alias("total_prompt_tokens"),
        F.sum("completion_tokens").alias("total_completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.round(F.avg("duration_ms"), 6).alias("avg_duration_ms"),
    )


def ai_usage_events(events: DataFrame) -> DataFrame:
    """The AI-usage facts contained in request events (those that name a model)."""
    total = F.col("ai_prompt_tokens") + F.col("ai_completion_tokens")
    own = events.filter(F.coalesce(F.col("ai_model"), F.lit("")) != "")
    return own.select("account_id", "job_id", F.col("ai_model").alias("model"), F.col("ai_prompt_tokens").alias("prompt_tokens"), F.col("ai_completion_tokens").alias("completion_tokens"), total.alias("total_tokens"), "duration_ms", "timestamp")


def kpis(events: DataFrame, as_of: datetime | str, hours: int = 24) -> DataFrame:
    """Totals over the per-domain measures; the mean duration is weighted by requests. One row, also without events."""
    d = _since(events, as_of, hours).groupBy("domain").agg(*_measures(_LONG), F.avg("duration_ms").alias("exact"))
    total = F.coalesce(F.sum("total_requests"), F.lit(0))
    ok = F.coalesce(F.sum("successful_requests"), F.lit(0))
    return d.agg(
        total.alias("total_requests"),
        ok.alias("successful_requests"),
        F.coalesce(F.sum("failed_requests"), F.lit(0)).alias("failed_requests"),
        success_rate(ok, total).alias("success_rate"),
        F.when(total > 0, F.round(F.sum(F.col("exact") * F.col("total_requests")) / total, 6)).otherwise(F.lit(0.0)).alias("avg_duration_ms"),
        F.coalesce(F.sum("total_bytes"), F.lit(0)).alias("total_bytes"),
        F.count("*").alias("unique_domains"),
    )


def domain_diagnostics(events: DataFrame, contains: str | None = None, limit: int = 20) -> DataFrame:
    """Rows, successes and failures per domain; the mean duration divides all milliseconds by the successes."""
    own = events if contains is None else events.filter(F.col("domain").contains(contains))
    d = own.groupBy("domain").agg(F.count("*").alias("requests"), F.count_if(_ok()).alias("successes"), F.count_if(_failed()).alias("failures"), F.sum("duration_ms").alias("total_ms"))
    mean = F.when(F.col("successes") > 0, F.floor(F.col("total_ms") / F.col("successes"))).otherwise(F.lit(0))
    return d.withColumn("avg_ms", mean.cast("long")).drop("total_ms").orderBy(F.desc("requests"), "domain").limit(limit)


def recent_errors_by_status(events: DataFrame, last: int = 100) -> DataFrame:
    """Status counts among the latest failures."""
    cols = [F.desc("timestamp"), *[F.col(c).asc_nulls_first() for c in ("url", "status_code", "error", "job_id")]]
    return events.filter(_failed()).orderBy(*cols).limit(last).groupBy("status_code").agg(F.count("*").alias("count"))


def error_domains(events: DataFrame, limit: int = 10) -> DataFrame:
    return events.filter(_failed()).groupBy("domain").agg(F.count("*").alias("errors")).orderBy(F.desc("errors"), "domain").limit(limit)


def operation_totals(events: DataFrame) -> DataFrame:
    """Requests, bytes and tokens per operation with a grand total (operation null, is_total 1)."""
    return events.rollup("operation").agg(
        F.grouping("operation").cast("int").alias("is_total"),
        F.sum("pages_fetched").alias("requests"),
        F.sum("content_length").alias("bytes"),
        F.sum(F.col("ai_prompt_tokens") + F.col("ai_completion_tokens")).alias("tokens"),
    )


def daily_filled(events: DataFrame, first: str, last: str) -> DataFrame:
    """Pages per day from first to last, days without events as zero."""
    days = events.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    pages = events.groupBy(F.to_date("timestamp").alias("date")).agg(F.sum("pages_fetched").alias("pages"))
    return days.join(pages, "date", "left").select("date", F.coalesce("pages", F.lit(0)).alias("pages"))


def rate_and_error_windows(events: DataFrame, size: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """Sliding-window monitoring: rows, failures, error ratio, and median and 95th percentile of the duration."""
    w = events.groupBy(F.window("timestamp", size, slide))
    out = w.agg(F.count("*").alias("n"), F.count_if(_failed()).alias("failures"), F.percentile("duration_ms", F.array(F.lit(0.5), F.lit(0.95))).alias("q"))
    return out.select(F.col("window.start").alias("start"), "n", "failures", F.round(F.col("failures") / F.col("n"), 6).alias("error_ratio"), F.round(F.col("q")[0], 6).alias("p50_ms"), F.round(F.col("q")[1], 6).alias("p95_ms"))


def alert_windows(events: DataFrame, key: str = "domain", ratio: float = 0.5, hold: int = 3, bucket: str = "5 minutes") -> DataFrame:
    """Per key and bucket of time with events: ``rate`` (per second), ``error_ratio``, ``increase`` (rows of the last 30 minutes), ``delta``
    (against the bucket 10 minutes before, null without one), and ``firing``: the ratio was over its limit in the last ``hold``
    buckets on end. Rows are summed per bucket before anything is ordered, so a key's window holds its buckets only."""
    per = events.groupBy(key, F.window("timestamp", bucket).start.alias("started")).agg(F.count("*").alias("n"), F.count_if(_failed()).alias("failures"))
    secs = F.unix_seconds("started")
    w = Window.partitionBy(key).orderBy(secs)
    step = 300
    before = F.max("n").over(w.rangeBetween(-600, -600))
    bad = (F.col("failures") / F.col("n") > ratio).cast("int")
    held = F.sum(bad).over(w.rangeBetween(-step * (hold - 1), 0)) == hold
    return per.select(key, "started", F.round(F.col("n") / step, 6).alias("rate"), F.round(F.col("failures") / F.col("n"), 6).alias("error_ratio"), F.sum("n").over(w.rangeBetween(-1800 + step, 0)).alias("increase"), (F.col("n") - before).alias("delta"), held.alias("firing"))


PIPES: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (hourly_stats, daily_stats, top_domains, domain_stats, error_distribution, kpis, job_stats, ai_usage, job_timeline, job_event_summary, account_usage, account_daily_usage, account_daily_usage_by_operation, api_key_usage, top_accounts)
}


def respond(name: str, *args, **params) -> dict:
    """A pipe's answer: meta (names and types of its columns), data, rows and statistics (seconds). For pipes whose rows are bounded by
    a limit or by the calendar; they are brought to the driver."""
    began = time.time()
    df = pipe(name, *args, **params)
    data = [r.asDict(recursive=True) for r in df.collect()]
    return {"meta": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields], "data": data, "rows": len(data), "statistics": {"elapsed": time.time() - began, "rows_read": len(data)}}


def pipe(name: str, *args, **params) -> DataFrame:
    """A pipe by its name in the catalogue."""
    if name not in PIPES:
        raise KeyError(f"no pipe named {name}; there are {', '.join(sorted(PIPES))}")
    return PIPES[name](*args, **params)
