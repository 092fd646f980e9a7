"""Queries of problem 7."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.language import Model, identify, label_code, train_on
from skeinwork.llm.queries_c import record_residue
from skeinwork.session import table


def _codes(spark: SparkSession, sf_dir: str) -> list[str]:
    """The codes of lang_codes, a table of one row per language."""
    return [r.code for r in table(spark, sf_dir, "lang_codes").select("code").distinct().collect()]


def _model(spark: SparkSession, sf_dir: str) -> Model | None:
    docs = table(spark, sf_dir, "crawl_documents").select("content", "language")
    texts = table(spark, sf_dir, "documents").select("text", "lang")
    return train_on(docs.union(texts), "content", "language", _codes(spark, sf_dir))


def _segments(spark: SparkSession, sf_dir: str, model: Model | None) -> DataFrame:
    docs = table(spark, sf_dir, "crawl_documents").select("rec_id", "uid", "content", "language")
    # all deliveries are read, and of the small results those of each document's first delivery are kept: no text is shuffled
    found = identify(docs.filter(F.length("content") > 0), ["rec_id", "uid", "language"], "content", model)
    parts = F.collect_list(F.struct("seg_no", "lang", "confidence", "first_line", "last_line"))
    each = found.groupBy("uid", "rec_id").agg(F.first("language").alias("language"), parts.alias("parts"))
    first = each.groupBy("uid").agg(F.min_by(F.struct("rec_id", "language", "parts"), "rec_id").alias("d"))
    return first.select("uid", "d.rec_id", "d.language", F.explode("d.parts").alias("p")).select("rec_id", "uid", "language", "p.*")


def p7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every document, with its confidence and the label the document came with."""
    return _segments(spark, sf_dir, _model(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = [c.lower() for c in _codes(spark, sf_dir)]
    with ThreadPoolExecutor(1) as pool:  # the model is fitted on the driver while the executors look for the cases of problem 5
        fitted = pool.submit(_model, spark, sf_dir)
        residue = record_residue(spark, sf_dir)
        segments = _segments(spark, sf_dir, fitted.result())
    junk = table(spark, sf_dir, "crawl_documents").select("rec_id", "uid").join(residue, "rec_id").select("uid").distinct()
    label = F.coalesce(label_code(F.col("language")), F.lit(""))
    label = F.when(label.isin(known), label).otherwise(F.lit(""))
    kinds = segments.groupBy("uid").agg(F.count("*").alias("n"), F.first(label).alias("label"), F.sort_array(F.collect_list(F.struct("seg_no", "lang"))).alias("s"))
    wrong = kinds.filter((F.col("n") > 1) | (F.col("label") != F.col("s")[0]["lang"]))
    return wrong.join(junk, "uid", "left_anti").select("uid", F.explode("s").alias("x")).select("uid", "x.seg_no", "x.lang")


QUERIES = {f.__name__: f for f in (p7_segments, p7_found)}
