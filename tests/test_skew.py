import random

from skeinwork.operators.skew import heavy_keys, keyed_run_states

SCHEMA = "host string, at long, id long, key string"


def brute(rows):
    out = {}
    for host in {r[0] for r in rows}:
        at = sorted(r[1] for r in rows if r[0] == host and r[1] is not None)
        gaps = [b - a for a, b in zip(at, at[1:])]
        out[host] = (sum(r[0] == host for r in rows), at[0] if at else None, at[-1] if at else None, max(gaps) if gaps else None)
    return out


def result(df):
    return {r.key: (r.n, r.first_at, r.last_at, r.max_gap) for r in df.collect()}


def test_heavy_key_nulls_and_ties(spark):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        host = "hot" if i % 3 == 0 else rng.choice(["a", "b", None, "", f"h{i % 50}"])
        rows.append((host, rng.choice([None, 5, 5, rng.randrange(10_000)]), i, "clash"))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(keyed_run_states(df, "host", "at", "id", partitions=7)) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert keyed_run_states(df, "host", "at", "id").collect() == []
    assert heavy_keys(df, "host", "at", "id", 0.03).collect() == []


def test_only_nulls(spark):
    df = spark.createDataFrame([(None, None, 1, None), (None, None, 2, None)], SCHEMA)
    assert result(keyed_run_states(df, "host", "at", "id")) == {None: (2, None, None, None)}
    assert heavy_keys(df, "host", "at", "id", 0.03).collect() == []


def test_heavy_key_is_split(spark):
    df = spark.range(4000).selectExpr("'one' AS host", "id % 100 AS at", "id", "'x' AS key")
    ranged = df.repartitionByRange(8, "host", "at", "id")
    sizes = [r["count"] for r in ranged.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500
    assert result(keyed_run_states(df, "host", "at", "id", partitions=8)) == {"one": (4000, 0, 99, 1)}


def test_heavy_keys_count_null_hosts_in_total(spark):
    df = spark.createDataFrame([("a", 1, 1, "")] * 3 + [(None, 1, 1, "")] * 97, SCHEMA)
    assert [r.key for r in heavy_keys(df, "host", "at", "id", 0.03).collect()] == ["a"]
    assert heavy_keys(df, "host", "at", "id", 0.031).collect() == []
