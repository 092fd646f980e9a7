"""Content extraction over pages: the tree of a page is built once per row, and only the asked-for features are computed."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.functions import page_meta as M
from skeinwork.functions import readable as R
from skeinwork.functions.dom import Node, parse
from skeinwork.functions.language import Profiles, detect
from skeinwork.functions.selectors import FieldRule, extract_fields, select
from skeinwork.functions.urls import document_uid

MIN_CONTENT_BYTES = 100


def _content(root: Node, url: str | None) -> str | None:
    text = R.clean_text(R.extract_content(root))
    return text if len(text.encode()) >= MIN_CONTENT_BYTES else None


def _language(root: Node, url: str | None) -> str | None:
    """Where the content is asked for as well, ``extract`` reads it from there."""
    text = _content(root, url)
    return detect(text)[0] if text else None


def _items(root: Node, url: str | None) -> str:
    both = M.schema_items(M.json_ld(root)) + M.microdata(root)
    return json.dumps([{"type": k, "data": d} for k, d in both], ensure_ascii=False, sort_keys=True)


def _json_ld(root: Node, url: str | None) -> str | None:
    values = M.json_ld(root)
    return None if not values else json.dumps(values[0] if len(values) == 1 else values, ensure_ascii=False, sort_keys=True)


#: Feature: its Spark type and what computes it from the tree and the page's address.
FEATURES: dict[str, tuple[str, Callable[[Node, str | None], object]]] = {
    "title": ("string", lambda r, u: M.title_of(r)),
    "content": ("string", _content),
    "markdown": ("string", lambda r, u: R.markdown(r) or None),
    "main_markdown": ("string", lambda r, u: R.markdown(r, True) or None),
    "mini_html": ("string", lambda r, u: R.mini_html(r)),
    "main_mini_html": ("string", lambda r, u: R.mini_html(r, True)),
    "text": ("string", lambda r, u: R.clean_text(r.text(R.STRIPPED)) or None),
    "language": ("string", _language),
    "meta": ("map<string,string>", lambda r, u: M.meta_map(r)),
    "metadata": ("map<string,string>", lambda r, u: M.flat_metadata(M.rich_metadata(r))),
    "feeds": ("array<struct<url:string,feed_type:string,title:string>>", lambda r, u: M.rich_metadata(r)["feeds"]),
    "alternates": ("map<string,string>", lambda r, u: M.rich_metadata(r)["alternates"]),
    "favicon": ("string", lambda r, u: M.rich_metadata(r)["favicon"]),
    "json_ld": ("string", _json_ld),
    "schema_items": ("string", _items),
    "links": ("array<struct<url:string,anchor:string>>", lambda r, u: [{"url": a, "anchor": b} for a, b in M.links(r, u)] if u else []),
    "blocks": (
        "array<struct<index:int,content:string,heading:string,heading_level:int,anchor:string,h1:string,h2:string,h3:string,h4:string,h5:string,h6:string>>",
        lambda r, u: R.heading_blocks(r)[0],
    ),
}


def extract(pages: DataFrame, features: list[str], html_col: str = "html", url_col: str = "url", rules: dict[str, FieldRule] | None = None, include: list[str] = (), exclude: list[str] = (), profiles: Profiles | None = None) -> DataFrame:
    """pages without their HTML and with a column per feature (and ``fields``, JSON, for rules).

    The language is told by profiles, if any are given, else by scripts and frequent words. include keeps only what the selectors find, exclude removes what they find, before anything is computed. Null and empty pages
    give nulls. A feature's name replaces a column of pages. No page can fail: what cannot be read counts as absent.
    """
    kept = [f for f in pages.schema.fields if f.name not in (html_col, "fields", *features)]
    names = [*features, *(["fields"] if rules else [])]
    made = [T.StructField(n, T.StringType() if n == "fields" else T._parse_datatype_string(FEATURES[n][0])) for n in names]
    schema = T.StructType([*kept, *made])
    work = {n: FEATURES[n][1] for n in features}
    columns = [f.name for f in kept]
    trained = None if profiles is None else pages.sparkSession.sparkContext.broadcast(profiles)
    own, html, address = list(features), html_col, url_col if url_col in pages.columns else None

    def prepared(page: str) -> Node:
        root = parse(page)
        if include:
            found = [n for s in include for n in select(root, s)]
            root, body = Node("html"), Node("body")
            root.children, body.parent = [body], root
            body.children = found
        for s in exclude:
            for n in select(root, s):
                if n.parent is not None:
                    n.parent.children = [c for c in n.parent.children if c is not n]
        return root

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tell = detect if trained is None else trained.value.detect
        for pdf in batches:
            out: dict[str, list] = {n: [] for n in names}
            urls = pdf["__url"]
            for page, url in zip(pdf["__html"], urls):
                root = prepared(page) if page else None
                for n in own:
                    if n == "language" and root is not None:
                        text = out["content"][-1] if "content" in own and own.index("content") < own.index("language") else _content(root, url)
                        out[n].append(tell(text)[0] if text else None)
                    else:
                        out[n].append(work[n](root, url) if root is not None else None)
                if rules:
                    out["fields"].append(json.dumps(extract_fields(root, rules)[0], ensure_ascii=False, sort_keys=True) if root is not None else None)
            result = pdf[columns].copy()
            for n in names:
                result[n] = pd.Series(out[n], index=result.index, dtype="object")
            yield result

    source = pages.select(*columns, F.col(html).alias("__html"), (F.col(address) if address else F.lit(None).cast("string")).alias("__url"))
    return source.mapInPandas(run, schema)


def is_parsable(content_type: Column | str) -> Column:
    """HTML, XHTML and Markdown are parsed; a missing type passes."""
    c = F.lower(F.col(content_type) if isinstance(content_type, str) else content_type)
    return c.isNull() | c.contains("html") | c.contains("markdown")


def block_documents(pages: DataFrame, title_col: str = "title", url_col: str = "url") -> DataFrame:
    """One row per block of pages with the feature blocks: block_url, uid, parent_document_id, page_block, title, tags, content, headings."""
    b = pages.select(F.col(url_col).alias("url"), F.col(title_col).alias("page_title"), F.posexplode("blocks").alias("page_block", "b"))
    place = F.coalesce(F.concat(F.lit("#"), F.nullif("b.anchor", F.lit(""))), F.concat(F.lit("#block-"), F.col("page_block")))
    address = F.concat(F.col("url"), place)
    title = F.when(F.col("b.heading").isNull(), F.col("page_title")).otherwise(F.concat_ws(" - ", "page_title", "b.heading"))
    tags = F.filter(F.array("b.h1", "b.h2", "b.h3", "b.h4"), lambda x: x.isNotNull())
    return b.select(address.alias("block_url"), document_uid(address).alias("uid"), document_uid(F.col("url")).alias("parent_document_id"), "page_block", title.alias("title"), tags.alias("urls_tags"), F.col("b.content").alias("content"), "b.anchor", *[f"b.h{k}" for k in range(1, 7)])


def markdown_documents(pages: DataFrame, text_col: str) -> DataFrame:
    """Markdown pages: their first first-level heading as ``title`` and the text without signs as ``content``."""

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: R.markdown_to_text(t) if t is not None else None)

    title = F.nullif(F.trim(F.regexp_extract(F.col(text_col), r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    return pages.withColumn("title", title).withColumn("content", plain(F.col(text_col)))


# fixed values: the two attributes of a description, in either order, with any others around them
_NAME, _CONTENT = r"""name\s*=\s*["']description["']""", r"""content\s*=\s*["']([^"']*)["']"""


def head_fields(html: Column | str) -> tuple[Column, Column]:
    """Title and description by patterns within the head (or the first 8,192 characters): no tree is built."""
    h = F.col(html) if isinstance(html, str) else html
    end = F.instr(F.lower(h), "</head>")
    head = F.when(end > 0, F.substr(h, F.lit(1), end - 1)).otherwise(F.substring(h, 1, 8192))
    title = F.regexp_extract(head, r"(?is)<title[^>]*>(.*?)</title>", 1)
    a = F.regexp_extract(head, f"(?is)<meta[^>]+{_NAME}[^>]+{_CONTENT}", 1)
    b = F.regexp_extract(head, f"(?is)<meta[^>]+{_CONTENT}[^>]+{_NAME}", 1)
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    return clean(title), F.coalesce(clean(a), clean(b))
