"""Queries of problems 5 and 6."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm.main_content import foreign_lines, main_text
from skeinwork.llm.residue import content_lines, page_residue_lines, pages_read_once, residue_rows
from skeinwork.session import cut_lineage, table


def record_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id of the records that are cases of problem 5, by the same verdicts as in p5_found."""
    return p5_found(spark, sf_dir).filter(F.col("tbl") == "crawl_documents").select(F.col("id").alias("rec_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "crawl_documents").select("rec_id", "url", "content", "title")
    pages = table(spark, sf_dir, "raw_pages").select("page_id", "url", "status", "html", "content_type")
    a = content_lines(docs, "rec_id", "url", "content", "title", "crawl_documents")
    b = page_residue_lines(pages, "page_id", "url", "status", "html", "content_type", "raw_pages")
    return residue_rows(a.unionByName(b))


def p5_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that are left when the cases are taken out."""
    docs = table(spark, sf_dir, "crawl_documents").select("rec_id", "uid", "url", F.length("content").alias("n_chars"))
    return docs.join(record_residue(spark, sf_dir), "rec_id", "left_anti")


def p6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and main body of every page with html."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"page_id": pdf["page_id"], "main_text": [main_text(h) for h in pdf["html"]]})

    pages = table(spark, sf_dir, "raw_pages").filter(F.length("html") > 0)
    return pages.select("page_id", "html").mapInPandas(run, "page_id long, main_text string")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from outside the main body, without the cases of problem 5 (by the verdicts of p5_found); every page is read once."""
    docs = table(spark, sf_dir, "crawl_documents").select("rec_id", "uid", "url", "content", "title")
    pages = table(spark, sf_dir, "raw_pages").select("url", "page_id", "status", "html", "content_type")
    read = cut_lineage(pages_read_once(pages, "page_id", "url", "status", "html", "content_type", "raw_pages"))
    lines = cut_lineage(content_lines(docs, "rec_id", "url", "content", "title", "crawl_documents"))
    found = residue_rows(lines.unionByName(read.select(lines.columns)), written=True).filter(F.col("tbl") == "crawl_documents").select(F.col("id").alias("rec_id"))
    junk = docs.select("rec_id", "uid").join(found, "rec_id").select("uid").distinct()
    sides = read.filter(F.col("url").isNotNull()).select("url", F.col("id").alias("page_id"), "outside")
    return foreign_lines(docs, sides).join(junk, "uid", "left_anti")


QUERIES = {f.__name__: f for f in (p5_found, p5_kept, p6_main_text, p6_found)}
