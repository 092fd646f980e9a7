import pytest

from skeinwork.operators import analytics as A
from skeinwork.operators.search import index, search
from skeinwork.schemas import REQUEST_EVENT

AS_OF = "2024-01-31 00:00:00"


def test_empty_tables(spark):
    e = spark.createDataFrame([], REQUEST_EVENT)
    for f in (A.hourly_stats, A.daily_stats, A.top_domains, A.domain_stats, A.error_distribution, A.account_usage, A.top_accounts, A.account_daily_usage, A.api_key_usage):
        assert f(e, AS_OF).collect() == [], f
    k = A.kpis(e, AS_OF).first()
    assert k.total_requests == 0 and k.success_rate == 0.0 and k.unique_domains == 0
    zero = A.account_usage(e, AS_OF, "a").first()
    assert zero.account_id == "a" and zero.total_requests == 0 and zero.unique_domains == 0
    assert A.job_stats(e).collect() == [] and A.job_timeline(e).collect() == []


def test_measures(spark):
    row = dict.fromkeys([c.split()[0] for c in REQUEST_EVENT.replace("\n", " ").split(", ")])
    rows = [row | {"domain": d, "status_code": s, "error": x, "pages_fetched": p, "duration_ms": 10, "content_length": 1, "timestamp": None} for d, s, x, p in [("a", 200, "", 2), ("a", 200, "late", 1), ("a", 0, None, 1), ("a", 150, "", 4), ("b", 404, "", 0), (None, 500, "", 1)]]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], REQUEST_EVENT)
    got = {r.domain: (r.total_requests, r.successful_requests, r.failed_requests, r.success_rate) for r in A.domain_stats(df, AS_OF, hours=None).collect()}
    assert got == {"a": (8, 3, 2, 37.5), "b": (0, 0, 0, 0.0), None: (1, 0, 1, 0.0)}
    dist = {r.status_code: (r["count"], r.percentage) for r in A.error_distribution(df, AS_OF, None).collect()}
    assert dist == {200: (1, 33.333333), 404: (1, 33.333333), 500: (1, 33.333333)}


def test_catalogue(spark):
    assert len(A.PIPES) == 15
    with pytest.raises(KeyError):
        A.pipe("none")


def test_search(spark):
    docs = spark.createDataFrame([(1, "red fish, blue fish", "p"), (2, "one fish", "p"), (3, None, "q"), (4, "", "q"), (5, "bird", None), (6, "fish bird", None)], "id long, text string, parent string")
    assert [r.id for r in search(docs, "id", "text", "FISH bird!").collect()][:1] == [6]
    assert {r.id for r in search(docs, "id", "text", "fish", distinct="parent").collect()} == {1, 6}
    assert search(docs, "id", "text", "").collect() == [] and search(docs, "id", "text", "absent").collect() == []
    assert [r.id for r in search(docs, "id", "text", "fish", limit=1, offset=1).collect()] != []
    assert {(r.id, r.term, r.tf) for r in index(docs, "id", "text").filter("id = 1").collect()} == {(1, "red", 1), (1, "fish", 2), (1, "blue", 1)}
