from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from skeinwork.functions.text import json_payload, truncate_bytes
from skeinwork.session import cut_lineage, shared_folder


@pytest.mark.parametrize(
    ("answer", "want"),
    [('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ('Here: {"a": [1]} thanks', '{"a": [1]}'), ("list [1, 2] end", "[1, 2]"), ("nothing", None), (None, None), ("{broken", None)],
)
def test_json_payload(spark, answer, want):
    assert spark.range(1).select(json_payload(F.lit(answer).cast("string")).alias("v")).first().v == want


@pytest.mark.parametrize("text", ["plain ascii", "éééééé", "日本語テキスト", "a👩b💻c", "", None, "aé日👩" * 3])
def test_truncation(spark, text):
    for most in range(1, 14):
        got = spark.range(1).select(truncate_bytes(F.lit(text).cast("string"), most).alias("v")).first().v
        assert got == (None if text is None else text.encode()[:most].decode("utf-8", "ignore"))


def test_cut_lineage(spark):
    df = spark.range(5).selectExpr("id", "CAST(NULL AS map<string,int>) AS m", "array(id) AS a")
    cut = cut_lineage(df)
    assert cut.schema.simpleString() == df.schema.simpleString() and sorted(r.id for r in cut.collect()) == list(range(5))
    assert cut_lineage(df.limit(0)).collect() == []


def test_the_named_folder_is_used():
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: "file:///shared/" if k == "spark.checkpoint.dir" else d))
    assert shared_folder(named) == "file:///shared"
    unnamed = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master="spark://cluster:7077"))
    with pytest.raises(ValueError):
        shared_folder(unnamed)
