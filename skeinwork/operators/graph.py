"""Link graph: edges, degrees, PageRank, priority boosts, site maps; connected components.

Iterations cut their lineage with tables written to the shared folder. No node list, edge list or
component is collected to the driver; the driver sees one number per round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from skeinwork.functions.urls import graph_key
from skeinwork.session import cut_lineage

DAMPING, ITERATIONS = 0.85, 20


def link_edges(links: DataFrame, source_col: str, target_col: str) -> DataFrame:
    """Distinct edges ``src, dst`` of normalised addresses without self-links; rows with a null end are no links."""
    e = links.select(graph_key(source_col).alias("src"), graph_key(target_col).alias("dst"))
    return e.filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``node, inbound, outbound`` of every node."""
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return both.groupBy("node").agg(F.sum("i").alias("inbound"), F.sum("o").alias("outbound"))


def pagerank(edges: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING, checkpoint_every: int = 5) -> DataFrame:
    """``node, score`` after a fixed number of Jacobi steps from 1/n; dangling nodes do not hand on their score.

    The edges are partitioned by source once and kept so on the executors' disks (a lost executor's part is computed again); each
    round moves scores to them, never edges. Sums are combined before each shuffle, so a page that everything links to does not
    hold up the round. Spark jobs run while the query is built. An empty edge table gives no rows.
    """
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weighted = cut_lineage(edges.join(out, "src")).repartition(parts, "src").persist(StorageLevel.DISK_ONLY)
    all_nodes = cut_lineage(nodes(edges))
    n = all_nodes.count()
    if n == 0:
        return all_nodes.withColumn("score", F.lit(0.0))
    base = (1.0 - damping) / n
    scores = all_nodes.withColumn("score", F.lit(1.0 / n))
    for step in range(1, iterations + 1):
        given = weighted.join(scores, weighted["src"] == scores["node"]).select("dst", (F.col("score") / F.col("out")).alias("part"))
        received = given.groupBy("dst").agg(F.sum("part").alias("part"))
        scores = all_nodes.join(received, all_nodes["node"] == received["dst"], "left").select("node", (F.lit(base) + F.lit(damping) * F.coalesce("part", F.lit(0.0))).alias("score"))
        if step % checkpoint_every == 0 and step < iterations:
            scores = cut_lineage(scores)
    return scores


def priority_boost(score: Column, n: Column | int, highest: int = 50) -> Column:
    """0 for scores under 0.0001, else trunc(ln(1 + score * n) * highest / 5) between 0 and ``highest``."""
    count = n if isinstance(n, Column) else F.lit(n)
    raw = (F.log(F.lit(1.0) + score * count) * F.lit(highest / 5.0)).cast("int")
    return F.when(score < 1e-4, F.lit(0)).otherwise(F.least(F.greatest(raw, F.lit(0)), F.lit(highest)))


def top_pages(scores: DataFrame, limit: int = 10) -> DataFrame:
    return scores.orderBy(F.desc("score"), "node").limit(limit)


def most_linked(edges: DataFrame, limit: int = 10) -> DataFrame:
    return degrees(edges).orderBy(F.desc("inbound"), "node").limit(limit)


def graph_stats(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: pages, links, and least, greatest and mean score and number of inbound links."""
    per = degrees(edges).join(scores, "node")
    return per.agg(
        F.count("*").alias("pages"),
        F.coalesce(F.sum("outbound"), F.lit(0)).alias("links"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        F.avg("score").alias("avg_score"),
        F.min("inbound").alias("min_inbound"),
        F.max("inbound").alias("max_inbound"),
        F.avg("inbound").alias("avg_inbound"),
    )


def site_map(edges: DataFrame, seeds: DataFrame, max_depth: int = 5, limit: int | None = 10_000) -> DataFrame:
    """Breadth-first levels from the seeds (one column ``node``): ``node, depth``; at most ``limit`` pages in all, within a
    level by address; None for all. Null seeds are left out."""

    def first(level: DataFrame, n: int | None) -> DataFrame:
        return level if n is None else level.orderBy("node").limit(n)

    reached = cut_lineage(first(seeds.select("node").filter("node IS NOT NULL").distinct(), limit).withColumn("depth", F.lit(0)))
    front = reached
    left = None if limit is None else limit - reached.count()
    for depth in range(1, max_depth + 1):
        if left is not None and left <= 0:
            break
        found = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        front = cut_lineage(first(found.join(reached, "node", "left_anti"), left).withColumn("depth", F.lit(depth)))
        new = front.count()
        if not new:
            break
        left = None if left is None else left - new
        reached = reached.unionByName(front)
    return reached


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component`` (the least node) of every node of undirected edges.

    Each round joins every node to the least label around it and then to its label's label, so that chains shrink by
    half; a hub's neighbours are combined before the shuffle. Rounds go on until no label changes. Spark jobs run while the query is built.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    both = cut_lineage(e.union(e.select("y", "x")).distinct())
    labels = cut_lineage(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("component")))
    while True:
        around = both.join(labels.select(F.col("node").alias("y"), "component"), "y").groupBy(F.col("x").alias("node")).agg(F.min("component").alias("near"))
        nearer = labels.join(around, "node", "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = cut_lineage(nearer.join(jump, "component", "left").select("node", "old", F.least("component", "far").alias("component")))
        changed = new.filter(F.col("component") != F.col("old")).limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
