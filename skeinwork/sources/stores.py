"""Tables at rest: monthly facts, keyed upserts, stale-row removal and atomic replacement. Paths are folders of Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions.urls import store_key
from skeinwork.operators.dedup import latest_by


def append_facts(events: DataFrame, path: str, at: str = "timestamp", sort: tuple[str, ...] = ("account_id", "operation", "domain")) -> None:
    """Append facts by month, sorted within files so that min/max statistics prune."""
    own = [c for c in (*sort, at) if c in events.columns]
    events.withColumn("month", F.date_format(at, "yyyyMM")).repartition("month").sortWithinPartitions("month", *own).write.mode("append").partitionBy("month").parquet(path)


def read_facts(spark: SparkSession, path: str, since: str | None = None, at: str = "timestamp") -> DataFrame:
    """Facts since a time, with the month spelled out so that older folders are not read."""
    facts = spark.read.parquet(path)
    if since is None:
        return facts.drop("month")
    t = F.lit(since).cast("timestamp")
    return facts.filter((F.col("month").cast("string") >= F.date_format(t, "yyyyMM")) & (F.col(at) >= t)).drop("month")


def expire(facts: DataFrame, as_of: str, days: int, at: str = "timestamp") -> DataFrame:
    """Rows not older than so many days; rows without a time stay."""
    return facts.filter(F.col(at).isNull() | (F.col(at) >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days))))


def replace_table(rows: DataFrame, path: str) -> None:
    """Write beside the table, then swap by two renames; a failed write changes nothing.

    Between the renames readers find no table, and on an object store a rename copies: use it where the file system renames at once.
    """
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    rows.write.parquet(fresh)
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(root):
        fs.rename(root, jvm.org.apache.hadoop.fs.Path(old))
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(fresh), root):
        fs.rename(jvm.org.apache.hadoop.fs.Path(old), root)
        raise OSError(f"could not swap {path}")
    fs.delete(jvm.org.apache.hadoop.fs.Path(old), True)


def upsert(table: DataFrame | None, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The table with rows put in by key: of equal keys a new row stays, of these the greatest by order. Null keys are one key."""
    both = rows.withColumn("__new", F.lit(1)) if table is None else table.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return latest_by(both, key, ["__new", *order]).drop("__new")


def insert_missing(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with those rows whose key it does not have; of several rows of one key any one."""
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(*table.columns))


def update_where(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with the non-null values of changes (one row per key) in place of its own."""
    names = [c for c in changes.columns if c != key and c in table.columns]
    new = changes.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in names])
    j = table.join(new, F.col(key) == F.col("__key"), "left")
    return j.select(*[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns])


def remove_stale(docs: DataFrame, job_id: str, job_col: str = "_crawl_job_id") -> DataFrame:
    """Documents of the given job only; those without a job are stale."""
    return docs.filter(F.col(job_col) == job_id)


def prefix_scan(table: DataFrame, key: str, prefix: str) -> DataFrame:
    return table.filter(F.col(key).startswith(prefix)).orderBy(key)


def increment(table: DataFrame | None, hits: DataFrame, key: str, as_of: str, ttl_secs: int) -> DataFrame:
    """A table of counters (key, n, expires_at) after hits: each adds one and puts the end off; counters whose time is over begin anew."""
    now = F.lit(as_of).cast("timestamp")
    new = hits.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__hits"))
    new = new.withColumn("__end", now + F.make_dt_interval(secs=F.lit(ttl_secs)))
    if table is None:
        return new.select(key, F.col("__hits").alias("n"), F.col("__end").alias("expires_at"))
    live = table.filter(F.col("expires_at") > now)
    return live.join(new, key, "full").select(key, (F.coalesce("n", F.lit(0)) + F.coalesce("__hits", F.lit(0))).alias("n"), F.coalesce("__end", "expires_at").alias("expires_at"))


def put_pages(pages: DataFrame, path: str, url_col: str = "url", html_col: str = "html") -> None:
    """Add pages to the store at path under their keys (``key, html, size``), sorted by key within files; null pages are not stored."""
    own = pages.filter(F.col(html_col).isNotNull() & F.col(url_col).isNotNull())
    own = own.select(store_key(url_col).alias("key"), F.col(html_col).alias("html"), F.length(html_col).alias("size"))
    own.repartition(F.substring("key", 1, 16)).sortWithinPartitions("key").write.mode("append").parquet(path)


def stored_pages(spark: SparkSession, path: str, prefix: str = "", with_html: bool = True) -> DataFrame:
    """The stored pages whose key begins with prefix; without html only keys and sizes are read."""
    rows = spark.read.parquet(path).filter(F.col("key").startswith(prefix))
    return rows if with_html else rows.select("key", "size")


def delete_pages(spark: SparkSession, path: str, keys: DataFrame) -> None:
    """Take the pages with these keys (one column ``key``) out of the store."""
    replace_table(spark.read.parquet(path).join(keys.select("key").distinct(), "key", "left_anti"), path)
