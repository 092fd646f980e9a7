import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinwork.functions import language as L
from skeinwork.functions import page_meta as M
from skeinwork.functions import readable as R
from skeinwork.functions.dom import parse
from skeinwork.functions.selectors import FieldRule, extract_field, extract_fields, select, transform
from skeinwork.operators import content as C
from skeinwork.operators import search as I


def tags(root):
    return [n.tag for n in root.walk()]


def test_implied_end_tags():
    root = parse("<ul><li>a<li>b</ul><p>one<p>two<div>three</div><table><tr><td>1<td>2<tr><td>3</table>")
    assert [n.text() for n in root.find_all("li")] == ["a", "b"]
    assert [n.text() for n in root.find_all("p")] == ["one", "two"]
    assert [[c.text() for c in tr.find_all("td")] for tr in root.find_all("tr")] == [["1", "2"], ["3"]]


def test_raw_text_and_comments():
    root = parse('<script>var a = "</p><b>";</script><!-- <p>no</p> --><p>&copy; &amp; x</p><style>p{}</style>')
    assert [n.text() for n in root.find_all("p")] == ["© & x"]
    assert root.first("b") is None


def test_stray_and_missing():
    assert parse(None).children == [] and parse("").children == []
    assert parse("</div><b>x").text() == "x"
    assert parse("a < b").text() == "a < b"
    deep = parse("<div>" * 5000 + "x")
    assert deep.text() == "x"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/ab p\"'=!-&;\x00\n", max_size=200))
def test_never_fails(page):
    root = parse(page)
    R.extract_content(root)
    R.markdown(root)
    R.mini_html(root)
    R.heading_blocks(root)
    M.rich_metadata(root)
    root.outer_html()


PAGE = """<html><head><title>T</title><meta name="description" content="d"><meta property="og:description" content="og d">
<meta name="DC.creator" content="c"><link rel="alternate" type="application/rss+xml" href="/f.xml"><link rel="alternate" hreflang="de" href="/de">
<script type="application/ld+json">[{"@type":"A","startDate":"2024-05-06"},{"@graph":[{"@type":["B","C"]}]}]</script><script type="application/ld+json">{bad</script></head>
<body><header><h1>Top</h1></header><article class="a b"><p id="x" data-k="v1 v2">First paragraph, long enough to be taken as a paragraph of its own.</p>
<h2 id="s">Sec</h2><p>Body of the section, which has more than fifty bytes of text in it.</p><h3>Sub</h3>short</article><aside>side</aside></body></html>"""


def test_selectors():
    root = parse(PAGE)
    ids = lambda s: [n.attrs.get("id") or n.tag for n in select(root, s)]
    assert ids("article > p") == ["x", "p"]
    assert ids("article p:first-child, #s") == ["x", "s"]
    assert ids("[data-k~=v2]") == ["x"] and ids("[data-k^='v1']") == ["x"] and ids("[data-k$=v1]") == []
    assert ids("p + h2") == ["s"] and ids("p ~ h3") == ["h3"] and ids(".a.b p:not(#x)") == ["p"]
    assert ids("nav p") == []


def test_fields_and_transforms():
    root = parse(PAGE)
    assert extract_field(root, FieldRule(("nope", "h2"))) == "Sec"
    assert extract_field(root, FieldRule(("p",), mode="count")) == 2
    values, missing = extract_fields(root, {"a": FieldRule(("nope",), default=1), "b": FieldRule(("nope",)), "c": FieldRule(("p[",))})
    assert values == {"a": 1} and missing == ["b", "c"]
    assert transform(" 1,234.50 EUR", (("parse_number",),)) == 1234.5
    assert transform("Yes", (("parse_boolean",),)) is True
    assert transform(" a , b", (("split", ","), ("join", "+"))) == "a+b"
    assert transform("<b>x</b>y", (("strip_tags",), ("uppercase",), ("truncate", 1))) == "X"
    assert transform("ab12", (("regex", r"(\d+)"),)) == "12" and transform("ab", (("regex", "("),)) is None
    assert transform([" a ", 1], (("trim",), ("lowercase",))) == ["a", 1]


def test_blocks():
    blocks, cut = R.heading_blocks(parse(PAGE), min_bytes=5)
    assert [b["heading"] for b in blocks] == [None, "Sec", "Sub"] and not cut
    assert blocks[1]["h1"] == "Top" and blocks[2]["h2"] == "Sec" and blocks[1]["anchor"] == "s"
    assert [b["index"] for b in R.heading_blocks(parse(PAGE), min_bytes=50)[0]] == [0, 1]
    assert R.heading_blocks(parse(PAGE), min_bytes=5, max_blocks=3)[1] is True


def test_metadata():
    m = M.rich_metadata(parse(PAGE))
    assert m["description"] == "og d" and m["author"] == "c" and m["alternates"] == {"de": "/de"}
    assert m["feeds"] == [{"url": "/f.xml", "feed_type": "rss", "title": None}]
    items = M.schema_items(M.json_ld(parse(PAGE)), dates=True)
    assert [k for k, _ in items] == ["A", "B", "C"] and items[0][1]["startDate"] == 1714953600
    flat = M.flat_metadata(m)
    assert flat["meta:description"] == "d" and flat["title"] == "T"


def test_content_and_markdown():
    root = parse("<body><article>" + "<p>Some words that fill a paragraph up to a good length.</p>" * 5 + "</article></body>")
    assert R.extract_content(root).startswith("Some words")
    md = R.markdown(parse("<h1>A</h1><ul><li>x<li>y <b>z</b></ul><a href='/q'>t</a><img alt='i' src='s.png'><script>no</script>"))
    assert md == "# A\n\n- x\n- y **z**\n\n[t](/q)![i](s.png)"
    assert R.markdown_to_text(md) == "A x y z ti"
    assert R.is_garbage("self.__next_f static/chunks/ x") and not R.is_garbage("plain text")


def test_links():
    root = parse('<a href="b?x=1">B</a><a href="mailto:x">m</a><a href="//o.com/">o</a><a href="http://[bad">z</a><a>none</a>')
    assert M.links(root, "https://e.com/a/") == [("https://e.com/a/b?x=1", "B"), ("https://o.com/", "o")]


def test_no_page_stops_a_job(spark):
    """Half surrogates, endless nesting, broken markup and odd bytes: the job ends, and what cannot be read is absent."""
    ld = '<script type="application/ld+json">{}</script>'
    pages = {
        1: ld.format('{"@type": "A", "name": "x\\ud800y", "\\udfff": 1}'),
        2: ld.format("[" * 200_000),
        3: ld.format("[" * 150 + "]" * 150),
        4: ld.format('{"@type": "B", "a": ' + '{"b": ' * 60 + "1" + "}" * 60 + "}"),
        5: "<div itemscope itemtype=https://schema.org/T>" + "<div itemprop=p itemscope>" * 3000,
        6: "<html><head><title>unclosed",
        7: "\x00\x01<p>\ufffd</p>" + "<b>" * 500,
        8: "",
        9: None,
        10: "<table><tr><td>" * 300,
        11: "&#xD800;&#x110000;&bogus;<p>&amp",
        12: "<p>" + "x" * 300_000,
    }
    df = spark.createDataFrame(list(pages.items()), "page_id int, html string").withColumn("url", F.lit("http://h.test/p"))
    got = {r.page_id: r for r in C.extract(df, sorted(C.FEATURES)).collect()}
    assert set(got) == set(pages) and got[9].title is None and got[6].title is not None
    assert "A" in got[1].schema_items and "\ufffd" in got[1].json_ld and "B" in got[4].schema_items
    assert all(not got[k].json_ld or got[k].json_ld in ("null", "[]") for k in (2, 3))


@pytest.mark.parametrize(
    ("head", "want"),
    [
        ('<meta name="description" lang="en" content=" D ">', "D"),
        ("<META data-x='1' CONTENT = 'D' id=q NAME='description'>", "D"),
        ('<meta name = "description" content="">', None),
        ('<meta name="descriptions" content="D">', None),
        ('<meta property="og:x"><meta content="D" name="description">', "D"),
    ],
)
def test_head_fields(spark, head, want):
    title, description = C.head_fields("h")
    row = spark.createDataFrame([(f"<head><title lang=x> T </title>{head}</head><meta name=description content=E>",)], "h string").select(title.alias("t"), description.alias("d")).first()
    assert (row.t, row.d) == ("T", want)


def test_index_finds_what_the_scan_finds(spark, tmp_path):
    df = spark.createDataFrame([(1, "red fish, blue fish"), (2, "one red"), (3, None), (4, ""), (5, "nothing here")], "id long, t string")
    I.build_index(df, "id", "t", str(tmp_path / "i"))
    for query in ("red fish", "fish", "absent", "RED, one", "  "):
        scan = {(r.id, r.score) for r in I.search(df, "id", "t", query, limit=None).collect()}
        assert {(r.id, r.score) for r in I.search_index(spark, str(tmp_path / "i"), query).collect()} == scan, query
    plan = I.search_index(spark, str(tmp_path / "i"), "red")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [red])" in plan or "EqualTo(term,red)" in plan
    I.build_index(df.limit(0), "id", "t", str(tmp_path / "e"))
    assert I.search_index(spark, str(tmp_path / "e"), "red").collect() == []


def test_trained_profiles(spark):
    """Trained on one half of the labelled documents, profiles tell the language of the other half; wrong labels are in the minority."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").filter("length(text) >= 200")
    profiles = L.train_profiles(docs.filter("doc_id % 2 = 0"), "text", "lang")
    held = [(r.text, r.lang.strip().lower()[:2]) for r in docs.filter("doc_id % 2 = 1 AND lang IS NOT NULL").collect()]
    right = sum(profiles.detect(t)[0] == c for t, c in held)
    assert len(profiles.known) >= 7 and right >= 0.85 * len(held)
    assert sum(L.detect(t)[0] == c for t, c in held) <= right
    assert all(len(x) <= L.PROFILE_SIZE for x in profiles.known.values())
    page = spark.createDataFrame([(1, "u", "<p>" + "Der schnelle Fluss l\u00e4uft unter der Br\u00fccke. " * 6), (2, "u", None)], "page_id int, url string, html string")
    assert {r.page_id: r.language for r in C.extract(page, ["language"], profiles=profiles).collect()} == {1: "de", 2: None}


def test_profiles_of_any_language(spark):
    """Languages without a list of words, with three-letter codes; nulls, short texts and an empty table."""
    own = {"eus": "etxe handia mendian dago eta ibaia zubi azpitik igarotzen da egunero", "cym": "mae'r afon yn rhedeg o dan y bont ac mae'r bobl yn gwylio'r cychod"}
    df = spark.createDataFrame([(t, c if k % 2 else c.upper() + "-x") for k in range(6) for c, t in own.items()] + [(None, "eus"), ("text", None), ("", "cym")], "t string, l string")
    profiles = L.train_profiles(df, "t", "l")
    assert {c: profiles.detect(t + " " + t)[0] for c, t in own.items()} == {c: c for c in own}
    assert profiles.detect("kort") == (None, 0.0) and profiles.detect(None) == (None, 0.0) and profiles.detect("12345 " * 20) == (None, 0.0)
    assert L.train_profiles(df.limit(0), "t", "l").detect("x" * 100) == (None, 0.0)
