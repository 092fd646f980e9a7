import math
import random

from pyspark.sql import functions as F

from skeinwork.operators import graph as G


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def brute_rank(pairs, steps=20, d=0.85):
    nodes = sorted({x for p in pairs for x in p})
    out = {n: [b for a, b in pairs if a == n] for n in nodes}
    score = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(steps):
        score = {n: (1 - d) / len(nodes) + d * sum(score[a] / len(out[a]) for a, b in pairs if b == n) for n in nodes}
    return score


def test_pagerank(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "dangling"), ("x", "a")]
    got = {r.node: r.score for r in G.pagerank(edges(spark, pairs)).collect()}
    want = brute_rank(pairs)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_link_edges(spark):
    df = spark.createDataFrame([("http://e.com/a/", "http://e.com/a"), ("http://e.com/a", "http://e.com/b#x"), ("http://e.com/a", "http://e.com/b"), (None, "http://e.com/b")], "s string, t string")
    e = G.link_edges(df, "s", "t")
    assert [(r.src, r.dst) for r in e.collect()] == [("http://e.com/a", "http://e.com/b")]
    assert {(r.node, r.inbound, r.outbound) for r in G.degrees(e).collect()} == {("http://e.com/a", 0, 1), ("http://e.com/b", 1, 0)}


def test_empty(spark):
    e = edges(spark, [])
    assert G.pagerank(e).collect() == [] and G.degrees(e).collect() == [] and G.connected_components(e, "src", "dst").collect() == []


def test_boost(spark):
    got = spark.range(1).select(*[G.priority_boost(F.lit(s), n).alias(f"c{k}") for k, (s, n) in enumerate([(0.5, 100), (0.00001, 10**6), (0.001, 10), (0.9, 10**9)])]).first()
    assert list(got) == [int(math.log(51) * 10), 0, 0, 50]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("hub", f"h{i}") for i in range(30)]
    pairs += [(f"r{rng.randrange(80):02}", f"r{rng.randrange(80):02}") for _ in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in G.connected_components(edges(spark, pairs), "src", "dst").collect()}
    assert got == {n: find(n) for n in parent}


def test_site_map(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("d", "a")])
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in G.site_map(e, seeds).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert {r.node for r in G.site_map(e, seeds, limit=2).collect()} == {"a", "b"}
    assert {r.node for r in G.site_map(e, seeds, max_depth=1).collect()} == {"a", "b", "c"}


def test_pagerank_moves_no_edges(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{(k * 7 + j) % 50}") for k in range(50) for j in range(3)], "src string, dst string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scores = G.pagerank(edges, iterations=3, checkpoint_every=100)
        scores.collect()
        plan = scores._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "InMemoryTableScan" in plan and "Exchange hashpartitioning(src" not in plan.split("InMemoryRelation")[0]
        lines = [x for x in plan.split("\n") if "Exchange" in x and "hashpartitioning(src" in x and "REPARTITION_BY_NUM" not in x]
        assert not lines, lines
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert abs(sum(r.score for r in scores.collect()) - 1) < 1e-9


def test_long_chain_is_one_component(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(3000)], "a long, b long")
    assert {r.component for r in G.connected_components(chain, "a", "b").select("component").distinct().collect()} == {0}
