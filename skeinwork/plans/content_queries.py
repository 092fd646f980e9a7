"""Content-plane queries over raw_pages and documents, and their SQL where it can be expressed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions.selectors import FieldRule
from skeinwork.functions.urls import document_uid, graph_key, is_non_page, is_skipped_link
from skeinwork.operators import content as C
from skeinwork.operators import graph as G
from skeinwork.operators.search import build_index, search, search_index
from skeinwork.plans.url_queries import GRAPH_SQL
from skeinwork.session import shared_path, table


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "raw_pages")
    return p.filter(C.is_parsable("content_type") & (F.length("html") > 0)).select("page_id", "url", "html")


def page_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = C.extract(_pages(spark, sf_dir), ["title", "content", "language", "metadata", "json_ld"])
    return d.withColumn("uid", document_uid("url"))


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.extract(_pages(spark, sf_dir), ["main_markdown", "main_mini_html"])


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.extract(_pages(spark, sf_dir), ["title"]).select("page_id", "title")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = C.extract(_pages(spark, sf_dir), ["links"]).select("page_id", "url", F.explode("links").alias("l"))
    own = p.select("page_id", "url", F.col("l.url").alias("target"), F.col("l.anchor").alias("anchor"))
    return own.filter(~is_skipped_link("target") & ~is_non_page("target"))


def page_link_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(G.link_edges(page_links(spark, sf_dir), "url", "target"))


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.block_documents(C.extract(_pages(spark, sf_dir), ["title", "blocks"]))


def page_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.extract(_pages(spark, sf_dir), ["schema_items", "json_ld"])


def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {
        "headline": FieldRule(("article h1", "h1"), transforms=(("trim",),)),
        "sections": FieldRule(("h2[id]",), mode="list", transforms=(("trim",), ("join", " | "))),
        "n_links": FieldRule(("a[href]",), mode="count", default=0),
        "nav": FieldRule(("nav li, header li",), mode="list_of_objects", fields={"label": FieldRule(("a",)), "to": FieldRule(("a",), mode="attribute", attribute="href")}),
        "first_year": FieldRule(("p",), transforms=(("regex", r"(20\d\d)"),)),
    }
    return C.extract(_pages(spark, sf_dir), [], rules=rules)


def head_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    title, description = C.head_fields("html")
    return table(spark, sf_dir, "raw_pages").select("page_id", title.alias("title"), description.alias("description"))


def structured_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of the stored structured data, read as variants."""
    v = F.try_parse_json("schema")
    kind = F.try_variant_get(v, "$['@type']", "string")
    return table(spark, sf_dir, "crawl_documents").select(kind.alias("type")).groupBy("type").agg(F.count("*").alias("n"))


def stored_page_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by their graph key with the title that they were stored under."""
    d = table(spark, sf_dir, "crawl_documents").filter("parent_document_id IS NULL")
    return d.groupBy(graph_key("url").alias("key")).agg(F.count("*").alias("n"), F.max("title").alias("title"))


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), "doc_id", "text", "crawler sitemap budget", limit=None)


def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of search_documents through an index written to the shared folder."""
    path = shared_path(spark)
    build_index(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    return search_index(spark, path, "crawler sitemap budget")


def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "crawl_documents").select("rec_id", "content", "language", F.coalesce("parent_document_id", "uid").alias("parent"))
    return search(docs, "rec_id", "content", "broken sitemap, archive", 50, 0, F.col("language") == "en", "parent")


QUERIES = {f.__name__: f for f in (page_documents, page_markdown, page_titles, page_links, page_link_degrees, page_blocks, page_schema, page_fields, head_metadata, structured_types, stored_page_map, search_documents, indexed_search, search_pages)}

_HEAD = "CASE WHEN strpos(lower(html), '</head>') > 0 THEN substr(html, 1, strpos(lower(html), '</head>') - 1) ELSE substr(html, 1, 8192) END"


def _bm25(docs: str, ident: str, text: str, words: list[str]) -> str:
    tf = [f"len(list_filter(w, lambda x: x = '{t}'))" for t in words]
    parts = [f"ln(1 + ((SELECT n FROM s) - (SELECT df{k} FROM s) + 0.5) / ((SELECT df{k} FROM s) + 0.5)) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * size / (SELECT mean FROM s)))" for k in range(len(words))]
    return f"""WITH t AS (SELECT *, list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {docs} WHERE {text} IS NOT NULL),
c AS (SELECT *, len(w) AS size, {', '.join(f'{x} AS tf{k}' for k, x in enumerate(tf))} FROM t),
s AS (SELECT count(*)::DOUBLE AS n, avg(size) AS mean, {', '.join(f'count(*) FILTER (WHERE tf{k} > 0)::DOUBLE AS df{k}' for k in range(len(words)))} FROM c),
r AS (SELECT *, {ident} AS id, round({' + '.join(parts)}, 6) AS score FROM c)"""


_PARSED = "p AS (SELECT page_id, url, html FROM raw_pages WHERE (content_type IS NULL OR lower(content_type) LIKE '%html%' OR lower(content_type) LIKE '%markdown%') AND length(html) > 0)"


def _plain(markup: str) -> str:
    """Text of a stretch of markup in SQL: without tags, with the five named characters, spaces collapsed."""
    out = f"regexp_replace({markup}, '<[^>]*>', '', 'g')"
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{name}', '{sign}')"
    return f"nullif(trim(regexp_replace({out}, '\\s+', ' ', 'g')), '')"


_LINKS = f"""{_PARSED},
a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*')) AS a FROM p),
l AS (SELECT page_id, url, regexp_extract(a, '"([^"]*)"', 1) AS href, {_plain("regexp_extract(a, '>(.*)', 1, 's')")} AS anchor FROM a),
links AS (SELECT page_id, url, CASE WHEN href LIKE '/%' THEN lower(regexp_extract(url, '^[A-Za-z]+:')) || regexp_extract(url, '//[^/?#]*') || href WHEN href LIKE '#%' THEN regexp_replace(url, '#.*$', '') || href ELSE href END AS target, anchor FROM l)"""
SQL = {
    "page_titles": f"""WITH {_PARSED} SELECT page_id, coalesce({_plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, {_plain("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}) AS title FROM p""",
    "page_links": f"WITH {_LINKS} SELECT page_id, url, target, anchor FROM links",
    "page_link_degrees": f"""WITH {_LINKS},
s AS (SELECT DISTINCT {GRAPH_SQL} AS src, t FROM (SELECT url, target AS t FROM links)),
e AS (SELECT DISTINCT src, {GRAPH_SQL} AS dst FROM (SELECT src, t AS url FROM s))
SELECT node, sum(i)::BIGINT AS inbound, sum(o)::BIGINT AS outbound FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e WHERE src <> dst UNION ALL SELECT dst, 1, 0 FROM e WHERE src <> dst) GROUP BY node""",
    "head_metadata": rf"""SELECT page_id, nullif(trim(regexp_extract({_HEAD}, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title,
coalesce(nullif(trim(regexp_extract({_HEAD}, '(?is)<meta[^>]+name\s*=\s*["'']description["''][^>]+content\s*=\s*["'']([^"'']*)["'']', 1)), ''), nullif(trim(regexp_extract({_HEAD}, '(?is)<meta[^>]+content\s*=\s*["'']([^"'']*)["''][^>]+name\s*=\s*["'']description["'']', 1)), '')) AS description FROM raw_pages""",
    "stored_page_map": f"SELECT {GRAPH_SQL} AS key, count(*) AS n, max(title) AS title FROM crawl_documents WHERE parent_document_id IS NULL GROUP BY 1",
    "structured_types": "SELECT json_extract_string(schema, '$.\"@type\"') AS type, count(*) AS n FROM crawl_documents GROUP BY 1",
    "search_documents": _bm25("documents", "doc_id", "text", ["crawler", "sitemap", "budget"]) + " SELECT id, score FROM r WHERE score > 0",
    "indexed_search": _bm25("documents", "doc_id", "text", ["crawler", "sitemap", "budget"]) + " SELECT id, score FROM r WHERE score > 0",
    "search_pages": _bm25("crawl_documents", "rec_id", "content", ["broken", "sitemap", "archive"])
    + " SELECT id, score FROM (SELECT id, score, row_number() OVER (PARTITION BY coalesce(parent_document_id, uid) ORDER BY score DESC, id) AS k FROM r WHERE score > 0 AND language = 'en') WHERE k = 1 ORDER BY score DESC, id LIMIT 50",
}
