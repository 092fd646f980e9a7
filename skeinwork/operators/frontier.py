"""Frontier order: priority scores, bounded and levelled queues, partitions, politeness, re-crawl decisions, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwork.functions.urls import extract_domain, history_key, normalize_domain
from skeinwork.session import cut_lineage

MIN_AGE, MAX_AGE = 3600, 7 * 24 * 3600
DEFAULT_INTERVAL, LEAST_INTERVAL, MOST_INTERVAL = 24 * 3600, 3600, 7 * 24 * 3600


def priority_score(priority: Column | str = "priority", depth: Column | str = "depth") -> Column:
    p = F.col(priority) if isinstance(priority, str) else priority
    d = F.col(depth) if isinstance(depth, str) else depth
    return p * 100 - d * 10 + F.when(d == 0, F.lit(1000)).otherwise(F.lit(0))


def pop(queue: DataFrame, n: int, capacity: int | None = None) -> DataFrame:
    """The n best rows of a queue (that holds its ``capacity`` best), best first; equal scores by address and all else."""
    ties = [F.col(c).asc_nulls_first() for c in queue.columns if c not in ("url", "score")]
    best = queue.withColumn("score", priority_score())
    return best.orderBy(F.desc("score"), "url", *ties).limit(n if capacity is None else min(n, capacity))


def level_of(score: Column) -> Column:
    return F.when(score >= 10, "high").when(score >= 0, "normal").otherwise("low")


def levelled_order(queue: DataFrame, priority_col: str = "priority", weights: tuple[int, int, int] = (5, 3, 1)) -> DataFrame:
    """Rows with the round (``turn``) in which a queue of three levels, served 5, 3 and 1 at a time, hands them out.

    The rank within a level comes from a range sort and per-partition offsets, not from one window over a level.
    """
    own = queue.withColumn("level", level_of(F.col(priority_col)))
    ranked = dense_position(own, ["level"], [F.desc(priority_col), F.col("url")])
    weight = F.when(F.col("level") == "high", weights[0]).when(F.col("level") == "normal", weights[1]).otherwise(weights[2])
    return ranked.withColumn("turn", F.floor((F.col("position") - 1) / weight)).select(*[c for c in queue.columns if c not in ("level", "turn", "position")], "level", "turn", "position")


def dense_position(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """rows with ``position`` (1, 2, …) within their keys, for keys of any size: ranges are numbered separately and shifted by
    the counts of the ranges before them."""
    by = [F.col(k) for k in keys] + order
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id())
    local = Window.partitionBy("__part", *keys).orderBy(*order)
    # written while the query is built: counts and rows must come from one and the same cut into ranges
    numbered = cut_lineage(ranged.withColumn("__at", F.row_number().over(local)))
    counts = numbered.groupBy("__part", *keys).agg(F.max("__at").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("__shift", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    on = ["__part", *keys]
    return numbered.join(shifts, on).withColumn("position", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def domain_partition(url: Column | str, partitions: int = 16) -> Column:
    return F.pmod(F.xxhash64(normalize_domain(extract_domain(url))), F.lit(partitions)).cast("int")


def politeness_schedule(queue: DataFrame, delay_ms: Column | int = 1000, domain_col: str = "domain", robots_factor: Column | float = 1.0) -> DataFrame:
    """queue with ``wait_ms``: the sum of the delays of the better rows of the same domain. delay_ms may be a column."""
    d = F.lit(delay_ms) if isinstance(delay_ms, int) else delay_ms
    own = F.least(F.greatest(d * robots_factor, F.lit(100)), F.lit(30_000)).cast("long")
    rows = dense_position(queue.withColumn("__delay", own), [domain_col], [F.desc("priority"), F.col("url"), F.col("discovered_at")])
    return rows.withColumn("wait_ms", (F.col("position") - 1) * F.col("__delay")).drop("__delay")


def wait_time(paused: Column, in_flight: Column, cap: Column, remaining_ms: Column) -> Column:
    """Milliseconds to wait: a minute when paused, a tenth of a second at the cap, else what is left of the delay."""
    return F.when(paused, 60_000).when(in_flight >= cap, 100).otherwise(F.greatest(remaining_ms, F.lit(0)))


def change_rate(changes: Column | str = "change_count", crawls: Column | str = "crawl_count") -> Column:
    c, n = (F.col(x) if isinstance(x, str) else x for x in (changes, crawls))
    return F.when(n > 0, c / n).otherwise(F.lit(0.0))


def recrawl_decisions(urls: DataFrame, history: DataFrame, as_of: str, forced_interval: int | None = None, boost: float = 10.0) -> DataFrame:
    """urls with ``decision`` (crawl or skip), ``reason``, ``priority_boost``, ``retry_after`` (seconds) and ``use_conditional``.

    In this order: no record, crawl; younger than an hour, skip; a forced interval that is over; older than a week;
    older than the record's interval (with a boost where more than half of its crawls changed); else skip.
    Addresses meet trimmed and in lower case; of several records of an address the latest counts. A null age counts as endless.
    Columns of urls with the names of the result are replaced.
    """
    h = history.select(history_key("url").alias("__key"), *[F.col(c).alias(f"__{c}") for c in ("last_crawled_at", "crawl_count", "change_count", "recrawl_interval_secs", "etag", "last_modified")])
    h = h.groupBy("__key").agg(F.max_by(F.struct(*[c for c in h.columns if c != "__key"]), "__last_crawled_at").alias("h"))
    age = F.coalesce(F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("h.__last_crawled_at"), F.lit(1 << 40))
    rate = change_rate(F.col("h.__change_count"), F.col("h.__crawl_count"))
    interval = F.col("h.__recrawl_interval_secs")
    forced = F.lit(False) if forced_interval is None else age >= forced_interval
    j = urls.drop("reason").join(h, history_key(F.col("url")) == F.col("__key"), "left").withColumn("__age", age).withColumn("__rate", rate)
    reason = (
        F.when(F.col("__key").isNull(), "first_crawl")
        .when(F.col("__age") < MIN_AGE, "too_recent")
        .when(forced, "forced")
        .when(F.col("__age") >= MAX_AGE, "max_age")
        .when((F.col("__age") >= interval) & (F.col("__rate") > 0.5), "high_change_rate")
        .when(F.col("__age") >= interval, "interval_elapsed")
        .otherwise("not_due")
    )
    j = j.withColumn("reason", reason)
    crawl = ~F.col("reason").isin("too_recent", "not_due")
    gain = F.when(F.col("reason") == "max_age", 5).when(F.col("reason") == "high_change_rate", (F.lit(boost) * F.col("__rate")).cast("int")).otherwise(0)
    retry = F.when(F.col("reason") == "too_recent", F.lit(MIN_AGE) - F.col("__age")).when(F.col("reason") == "not_due", interval - F.col("__age"))
    cond = crawl & (F.col("reason") != "first_crawl") & (F.col("h.__etag").isNotNull() | F.col("h.__last_modified").isNotNull())
    made = ("decision", "reason", "priority_boost", "retry_after", "use_conditional")
    return j.select(*[c for c in urls.columns if c not in made], F.when(crawl, "crawl").otherwise("skip").alias("decision"), "reason", gain.alias("priority_boost"), retry.alias("retry_after"), cond.alias("use_conditional"))


def fold_history(crawls: DataFrame, order: list[str]) -> DataFrame:
    """The record of each address after its crawls (url, content_hash, crawled_at), in order: ``url, crawl_count, change_count,
    recrawl_interval_secs, last_crawled_at, content_hash``.

    A crawl with another hash than the one before halves the interval (an hour at least), one with the same hash makes it half as
    long again (a week at most); the first leaves the default of a day. Whether a step changes anything needs only the
    row before it, so changes are found with a window and folded over a sorted array of flags.
    """
    key = history_key("url")
    w = Window.partitionBy("__key").orderBy(*order)
    flagged = crawls.withColumn("__key", key).withColumn("__n", F.row_number().over(w)).withColumn("__old", F.lag("content_hash").over(w))
    flagged = flagged.withColumn("__changed", ~F.coalesce(F.col("content_hash") == F.col("__old"), F.lit(False)))
    folded = flagged.groupBy("__key").agg(
        F.count("*").alias("crawl_count"),
        F.sort_array(F.collect_list(F.struct("__n", "__changed"))).alias("steps"),
        F.max_by("content_hash", "__n").alias("content_hash"),
        F.max_by("crawled_at", "__n").alias("last_crawled_at"),
    )
    later = F.filter("steps", lambda s: s["__n"] > 1)
    interval = F.aggregate(
        later,
        F.lit(DEFAULT_INTERVAL).cast("long"),
        lambda acc, s: F.when(s["__changed"], F.greatest(F.floor(acc * 0.5), F.lit(LEAST_INTERVAL))).otherwise(F.least(F.floor(acc * 1.5), F.lit(MOST_INTERVAL))).cast("long"),
    )
    changes = F.size(F.filter(later, lambda s: s["__changed"]))
    return folded.select(F.col("__key").alias("url"), "crawl_count", changes.alias("change_count"), interval.alias("recrawl_interval_secs"), "last_crawled_at", "content_hash")


def history_stats(history: DataFrame) -> DataFrame:
    return history.agg(
        F.count("*").alias("tracked_urls"),
        F.coalesce(F.sum("crawl_count"), F.lit(0)).alias("total_crawls"),
        F.coalesce(F.sum("change_count"), F.lit(0)).alias("total_changes"),
        F.round(F.avg(change_rate()), 6).alias("avg_change_rate"),
        F.floor(F.avg("recrawl_interval_secs")).alias("avg_interval_secs"),
    )


def admit(urls: DataFrame, max_depth: int | None = None, max_pages: int | None = None) -> DataFrame:
    """Rows within the depth limit, and of these the best ``max_pages``."""
    own = urls if max_depth is None else urls.filter(F.col("depth") <= max_depth)
    return own if max_pages is None else pop(own, max_pages).drop("score")


def changefreq_seconds(value: Column | str) -> Column:
    """Seconds between changes by the sitemap words; 0 for always, null for never and unknown words."""
    v = F.lower(F.trim(F.col(value) if isinstance(value, str) else value))
    out = F.lit(None).cast("long")
    for word, secs in (("yearly", 31_536_000), ("monthly", 2_592_000), ("weekly", 604_800), ("daily", 86_400), ("hourly", 3600), ("always", 0)):
        out = F.when(v == word, F.lit(secs).cast("long")).otherwise(out)
    return out
