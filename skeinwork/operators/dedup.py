"""Exact de-duplication, seen sets, fingerprints and change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.urls import dedup_key
from skeinwork.session import cut_lineage


def unique_urls(urls: DataFrame, url_col: str, order: list[Column]) -> DataFrame:
    """One row per address in its de-duplicated form. Exact: unlike a filter of bits it never takes a new address for a seen one.

    Rows are reduced to the first of each key within every task before the shuffle (min_by is combined map-side). Null addresses
    are one address; a column dedup_key of urls is replaced.
    """
    names = [c for c in urls.columns if c != "dedup_key"]
    keyed = urls.select(*names, dedup_key(url_col).alias("dedup_key"))
    packed = F.min_by(F.struct(*[F.col(c) for c in names]), F.struct(*[c.alias(f"__{k}") for k, c in enumerate(order)]))
    return keyed.groupBy("dedup_key").agg(packed.alias("r")).select("dedup_key", *[F.col(f"r.{c}").alias(c) for c in names])


def filter_unseen(urls: DataFrame, seen: DataFrame, url_col: str, seen_col: str) -> DataFrame:
    """Rows whose address, in its de-duplicated form, is not among the seen ones; rows with a null address stay."""
    known = seen.select(dedup_key(seen_col).alias("__key")).filter("__key IS NOT NULL").distinct()
    return urls.join(known, dedup_key(F.col(url_col)) == F.col("__key"), "left_anti")


def dedup_stats(urls: DataFrame, url_col: str) -> DataFrame:
    return urls.agg(F.count("*").alias("rows"), F.countDistinct(dedup_key(url_col)).alias("unique_urls"))


def fingerprint(text: Column | str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def clean_hash(value: Column | str) -> Column:
    """The hex digits of a content hash written in any of its forms: with or without a prefix, in either letter case."""
    c = F.col(value) if isinstance(value, str) else value
    return F.nullif(F.regexp_extract(F.lower(c), r"([0-9a-f]{64})\s*$", 1), F.lit(""))


def content_changes(docs: DataFrame, history: DataFrame, url_col: str, text_col: str, hash_col: str) -> DataFrame:
    """``url_col, change``: ``first_crawl`` without a record, ``unchanged`` if its hash is the text's, else ``changed``
    (also where the old hash or the text is null). history has at most one row per address."""
    old = history.select(F.col(url_col).alias("__url"), clean_hash(hash_col).alias("__old"), F.lit(True).alias("__known"))
    joined = docs.join(old, F.col(url_col) == F.col("__url"), "left")
    same = F.coalesce(F.col("__old") == F.sha2(F.col(text_col), 256), F.lit(False))
    change = F.when(F.col("__known").isNull(), "first_crawl").when(same, "unchanged").otherwise("changed")
    return joined.withColumn("change", change).drop("__url", "__old", "__known")


def latest_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Upsert: the last row of each key (null is a key) by the columns of order, nulls first; ties are settled by the whole row's order
    of arrival, so order should be unique within a key.

    The greatest row of each key is combined map-side, so a key with many rows costs one row per task.
    """
    names = rows.columns
    last = rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*names), F.struct(*order)).alias("__r"))
    return last.select(*[F.col(f"__r.{c}").alias(c) for c in names])


def drop_repeats(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key by ``order`` (a unique column without nulls); rows with a null in a key are nobody's repeats.

    Only keys and order are shuffled to find the rows to leave out, and the first of each key is combined map-side. The rows to
    leave out are written to the shared folder while the query is built, so that their size is known when the join is planned: few
    of them are broadcast by Spark and wide rows stay where they are; many are joined by sorting.
    """
    narrow = rows.select(*keys, order).dropna(subset=keys)
    firsts = narrow.groupBy(*keys).agg(F.min(order).alias("__first"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    repeats = narrow.join(firsts, keys).filter(F.col(order) > F.col("__first")).select(F.col(order).alias("__repeat"))
    return rows.join(cut_lineage(repeats), F.col(order) == F.col("__repeat"), "left_anti")
