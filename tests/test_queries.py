"""Every query of the core against its SQL on the smallest data, and its plan's promises."""

import json
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from compare import norm
from skeinwork.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert len(set(cols)) == len(cols)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name in registry.SQL:
        rel = con.sql(registry.SQL[name])
        assert sorted(rel.columns) == cols
        order = [rel.columns.index(c) for c in cols]
        assert got == Counter(tuple(norm(r[i]) for i in order) for r in rel.fetchall())


LONG = "The harbour was quiet in the early morning and only a few boats had gone out to the deeper water beyond the lights."
LD = {"@context": "https://schema.org", "@type": "Article", "name": "Boats", "datePublished": "2024-05-06"}
PAGE = f"""<html lang=en><head><title> Harbour news </title><meta name="description" content="All about boats"><meta property="og:title" content="OG Harbour"><link rel="canonical" href="/harbour">
<script type="application/ld+json">{json.dumps(LD)}</script></head>
<body><nav><ul><li><a href="/home">Home</a></li><li><a href="javascript:x()">Bad</a></li><li><a href="pic.png">Picture</a></li></ul></nav>
<article><h1>Harbour</h1><p>{LONG} In 2023 it grew.</p><h2 id="boats">Boats</h2><p>{LONG}</p><h3>Small boats</h3><p>{LONG} <a href="https://other.test/x#y">More</a></p><h2>Empty</h2></article>
<div itemscope itemtype="https://schema.org/Place"><span itemprop="name">Pier</span></div></body></html>"""


@pytest.fixture(scope="module")
def page_dir(spark, tmp_path_factory):
    """A page with everything, one with too little, a file, and a page without body."""
    d = tmp_path_factory.mktemp("pages")
    rows = [(1, "http://h.test/news/", PAGE, "text/html"), (2, "http://h.test/short", "<p>Too short</p>", None), (3, "http://h.test/pdf", "%PDF", "application/pdf"), (4, "http://h.test/none", None, "text/html")]
    spark.createDataFrame(rows, "page_id long, url string, html string, content_type string").write.parquet(f"{d}/raw_pages.parquet")
    return str(d)


def rows_of(spark, page_dir, name, key="page_id"):
    return {r[key]: r.asDict(recursive=True) for r in registry.QUERIES[name](spark, page_dir).collect()}


def test_page_documents_fixed(spark, page_dir):
    got = rows_of(spark, page_dir, "page_documents")
    assert set(got) == {1, 2}
    full, empty = got[1], got[2]
    # the article is a leaf of the text walk: what stands in it is joined as it is
    assert full["content"] == f"Harbour{LONG} In 2023 it grew.Boats{LONG}Small boats{LONG} MoreEmpty"
    assert (full["title"], full["language"], full["uid"]) == ("Harbour news", "en", "54b85c79-1b6e-5217-b425-efc123e35a7e")
    assert full["metadata"] == {"meta:description": "All about boats", "description": "All about boats", "canonical_url": "/harbour", "title": "Harbour news", "og:title": "OG Harbour"}
    assert json.loads(full["json_ld"]) == LD
    assert empty["metadata"] == {} and {empty[c] for c in ("title", "content", "language", "json_ld")} == {None}


def test_page_markdown_fixed(spark, page_dir):
    got = rows_of(spark, page_dir, "page_markdown")
    assert got[1]["main_markdown"] == f"# Harbour\n\n{LONG} In 2023 it grew.\n\n## Boats\n\n{LONG}\n\n### Small boats\n\n{LONG} [More](https://other.test/x#y)\n\n## Empty\n\nPier"
    assert got[1]["main_mini_html"] == f'<h1>Harbour</h1><p>{LONG} In 2023 it grew.</p><h2>Boats</h2><p>{LONG}</p><h3>Small boats</h3><p>{LONG} <a href="https://other.test/x#y">More</a></p><h2>Empty</h2> Pier'
    assert got[2]["main_markdown"] == "Too short" and got[2]["main_mini_html"] == "<p>Too short</p>"


def test_page_blocks_fixed(spark, page_dir):
    got = rows_of(spark, page_dir, "page_blocks", "page_block")
    assert [got[k]["block_url"] for k in sorted(got)] == ["http://h.test/news/#block-0", "http://h.test/news/#boats", "http://h.test/news/#block-2"]
    assert [got[k]["title"] for k in sorted(got)] == ["Harbour news", "Harbour news - Boats", "Harbour news - Small boats"]
    assert [got[k]["urls_tags"] for k in sorted(got)] == [["Harbour"], ["Harbour", "Boats"], ["Harbour", "Boats", "Small boats"]]
    assert [got[k]["content"] for k in sorted(got)] == [f"Harbour {LONG} In 2023 it grew.", LONG, f"{LONG} More"]
    assert {r["parent_document_id"] for r in got.values()} == {"54b85c79-1b6e-5217-b425-efc123e35a7e"} and got[1]["anchor"] == "boats"
    assert [got[2][f"h{k}"] for k in range(1, 7)] == ["Harbour", "Boats", "Small boats", None, None, None]


def test_page_schema_links_and_fields_fixed(spark, page_dir):
    schema = rows_of(spark, page_dir, "page_schema")
    assert json.loads(schema[1]["schema_items"]) == [{"type": "Article", "data": LD}, {"type": "Place", "data": {"@type": "Place", "name": "Pier"}}]
    assert schema[2]["schema_items"] == "[]"
    links = {(r.target, r.anchor) for r in registry.QUERIES["page_links"](spark, page_dir).collect()}
    assert links == {("http://h.test/home", "Home"), ("https://other.test/x#y", "More")}
    fields = {k: json.loads(r["fields"]) for k, r in rows_of(spark, page_dir, "page_fields").items()}
    nav = [{"label": "Home", "to": "/home"}, {"label": "Bad", "to": "javascript:x()"}, {"label": "Picture", "to": "pic.png"}]
    assert fields == {1: {"first_year": "2023", "headline": "Harbour", "n_links": 4, "nav": nav, "sections": "Boats"}, 2: {"n_links": 0}}


def test_columns_and_filters_reach_the_scan(spark):
    plan = registry.QUERIES["top_domains"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "search_query" not in plan and "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in plan


def test_one_pass_of_python_per_page(spark):
    plan = registry.QUERIES["page_documents"](spark, SF).filter("title <> ''")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_the_core_does_not_import_the_subpackage():
    for p in Path(registry.__file__).parents[1].rglob("*.py"):
        if "llm" not in p.parts:
            assert "skeinwork.llm" not in p.read_text(), p
