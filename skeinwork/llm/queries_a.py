"""Queries of problem 1 (near-duplicate records)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.near_dup import near_duplicate_pairs, text_classes
from skeinwork.operators.graph import connected_components
from skeinwork.session import cut_lineage, table


def _long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "crawl_documents").select("rec_id", "uid", "content")
    return docs.filter(F.length("content") >= 500)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of uids: those of equal texts and, through class representatives, those of near texts."""
    docs = _long_documents(spark, sf_dir)
    members = text_classes(docs, "rec_id", "content").join(docs.select(F.col("rec_id").alias("id"), "uid"), "id").select("rep", "uid").distinct()
    near = near_duplicate_pairs(docs, "rec_id", "content", width=3, threshold=0.6).select("rep_a", "rep_b")
    left = members.select(F.col("rep").alias("rep_a"), F.col("uid").alias("ua"))
    right = members.select(F.col("rep").alias("rep_b"), F.col("uid").alias("ub"))
    across = near.join(left, "rep_a").join(right, "rep_b")
    equal = left.join(right, F.col("rep_a") == F.col("rep_b")).filter(F.col("ua") < F.col("ub"))
    pairs = across.select("ua", "ub").union(equal.select("ua", "ub")).filter(F.col("ua") != F.col("ub"))
    return pairs.select(F.least("ua", "ub").alias("uid_a"), F.greatest("ua", "ub").alias("uid_b")).distinct()


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record: the group of like texts it belongs to (its least rec_id) and the links its text has to other texts."""
    docs = _long_documents(spark, sf_dir)
    classes = text_classes(docs, "rec_id", "content")
    near = cut_lineage(near_duplicate_pairs(docs, "rec_id", "content", width=3, threshold=0.6))
    linked = near.select(F.col("rep_a").alias("rep")).union(near.select("rep_b")).groupBy("rep").agg(F.count("*").alias("n_links"))
    groups = connected_components(near, "rep_a", "rep_b").select(F.col("node").alias("rep"), "component")
    out = classes.join(linked, "rep", "left").join(groups, "rep", "left")
    return out.select(F.col("id").alias("rec_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups}
SQL = {
    "p1_found": r"""
WITH d AS (SELECT uid, min(content) AS content FROM crawl_documents WHERE length(content) >= 500 GROUP BY uid),
w AS (SELECT uid, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM d),
s AS MATERIALIZED (SELECT DISTINCT uid, hash(unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS h FROM w),
n AS (SELECT uid, count(*) AS n FROM s GROUP BY uid),
p AS (SELECT a.uid AS uid_a, b.uid AS uid_b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.uid < b.uid GROUP BY 1, 2)
SELECT uid_a, uid_b FROM p JOIN n a ON a.uid = uid_a JOIN n b ON b.uid = uid_b WHERE k >= 0.6 * (a.n + b.n - k)""",
    "p1_groups": r"""
WITH RECURSIVE d AS (SELECT content, min(rec_id) AS rep FROM crawl_documents WHERE length(content) >= 500 GROUP BY content),
w AS (SELECT rep, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM d),
s AS MATERIALIZED (SELECT DISTINCT rep, hash(unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS h FROM w),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
p AS (SELECT a.rep AS x, b.rep AS y, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.rep < b.rep GROUP BY 1, 2),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.rep = x JOIN n b ON b.rep = y WHERE k >= 0.6 * (a.n + b.n - k)),
t AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT rep AS x, rep AS y FROM d UNION SELECT r.x, t.y FROM r JOIN t ON r.y = t.x),
g AS (SELECT x AS rep, min(y) AS group_id FROM r GROUP BY x),
l AS (SELECT x AS rep, count(*) AS n_links FROM t GROUP BY x)
SELECT c.rec_id, g.group_id, coalesce(l.n_links, 0) AS n_links FROM crawl_documents c JOIN d ON c.content = d.content JOIN g ON g.rep = d.rep LEFT JOIN l ON l.rep = d.rep""",
}
