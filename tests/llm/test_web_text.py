from skeinwork.functions.dom import parse
from skeinwork.llm import main_content as M
from skeinwork.llm import queries_c as C
from skeinwork.llm import residue as R
from skeinwork.llm import site_lines as L

PROSE = "The harbour was quiet in the early morning and only a few boats had gone out to the deeper water beyond the lights, where the fish were said to be."
PAGE = f"""<html><head><title>x</title></head><body><noscript>Enable JavaScript</noscript><div class="q1"><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></div>
<div class="q2"><h1>Harbour</h1><p>{PROSE}</p><ul><li>One {PROSE}<li>Two</ul><table><tr><td>a</td><td>long cell</td></tr><tr><td>bb</td><td>c</td></tr></table>
<pre>x = 1
  y</pre><p style="display:none">hidden</p><p>Shared prompt</p></div><div class="q3"><p>Contact | Imprint</p><p>We use small files</p></div></body></html>"""


def test_main_text():
    text = M.main_text(PAGE)
    assert text.startswith("Harbour\n\n" + PROSE) and "Home" not in text and "Imprint" not in text and "hidden" not in text and "JavaScript" not in text
    assert f"- One {PROSE}\n- Two" in text and "a   long cell\nbb  c" in text and "x = 1\n  y" in text
    assert M.main_text(None) is None and M.main_text("") is None and M.main_text("<script>x</script>") is None


def test_captions_and_hidden_cells():
    table = "<table><caption>Catch of <b>May</b></caption><thead><tr hidden><th>no<th>no</tr><tr><th>Fish<th style='display:none'>secret<th>Tons</tr></thead>stray<tbody><tr><td>Cod<td hidden>x<td>12<span hidden>!</span></tr><tr style='visibility: hidden'><td>gone</tr></tbody></table>"
    page = f"<body><article><h1>T</h1><p>{PROSE}</p>{table}<p>After</p></article></body>"
    text = M.main_text(page)
    head, rows = text.split("Fish")
    assert "Catch of May\n\n" in head and "stray" in head and rows == "  Tons\nCod   12\n\nAfter"
    assert not any(x in text.replace(PROSE, "") for x in ("no", "secret", "x", "gone", "!"))
    assert M.main_text(f"<article><p>{PROSE}</p><table><caption>Only a caption</caption></table></article>") == f"{PROSE}\n\nOnly a caption"


def test_layouts():
    wraps = ["<main><article>{}</article></main>", "<table><tr><td>nav</td></tr><tr><td width=180>side text</td><td>{}</td></tr></table>", "<div id=app><div role=main>{}</div></div>", "<DIV CLASS=body>{}</DIV><HR>"]
    for w in wraps:
        page = "<body><header><a href=/>Home</a></header>" + w.format(f"<h1>T</h1><p>{PROSE}<p>{PROSE}") + "<footer><p>Imprint and other things of little interest to anyone</p></footer></body>"
        text = M.main_text(page)
        assert text == f"T\n\n{PROSE}\n\n{PROSE}", w


def test_foreign_lines(spark):
    pages = spark.createDataFrame([("u", 1, None), ("u", 2, PAGE), ("u", 3, "<p>other"), (None, 4, PAGE)], "url string, page_id long, html string")
    content = f"Home · News\n{PROSE}\n\nHome\n- Two\nShared prompt\nWe  use small files\nunknown line"
    docs = spark.createDataFrame([(2, "d", "u", "ignored"), (1, "d", "u", content), (3, "n", "u", None), (4, "m", "no page", "Home"), (5, "o", None, "Home")], "rec_id long, uid string, url string, content string")
    assert sorted((r.uid, r.line_no) for r in M.foreign_lines(docs, M.page_sides(pages)).collect()) == [("d", 0), ("d", 3), ("d", 6)]
    assert M.foreign_lines(docs.limit(0), M.page_sides(pages.limit(0))).collect() == []


def test_renderer_survives_anything():
    for page in ("<", "<td>", "<table><table><li>", "</p></p>", "<p" * 50, "\x00<b>\x00", "<select><option>a", "<pre>\n\n</pre>"):
        M.main_text(page)
        R.lines_of_page(page)
    assert parse("<pre>a").text() == "a"


# --- residue --------------------------------------------------------------------------------------------------------


def test_kinds():
    kinds = {
        "Internal server error. Please try again in a few minutes.": R.LINE,
        "{{ page.title }} by __AUTHOR_NAME__": R.SLOT,
        "In short, {product_name} counts {0} of {1} results for {2}.": R.SLOT,
        f"{PROSE} It was signed {{name}}.": R.LINE,
        "Norwick - ref 1ab2": R.LABEL,
        "Error 404": R.LABEL,
        "It failed.": R.LINE,
        PROSE: R.LINE,
        "x" * 100_000: R.LABEL,
    }
    assert {k: R.kind_of(k) for k in kinds} == kinds


def test_masks():
    assert R.mask("Norwick: Line 12 of /srv/a.php, request ab12 \u00a0 'x y'") == "line <n> of <path>, request <id> <quoted>"
    assert R.mask("Lorem ipsum dolor sit amet consectetur adipisci elit sed") == "<filler>"
    assert {R.mask(x) for x in ("asdf asdf asdf asdf", "foo bar foo bar foo bar", "a b c a b c a b c", "xx xx xx xx xx xx xx.")} == {"<repeated>"}
    assert R.mask("It was as it was, and so it was.") == "it was as it was, and so it was." and R.mask("") == ""


def test_lines_that_name_themselves():
    for line in ("404 - Page not found", "Bitte schalten Sie JavaScript ein, um diese Seite zu sehen.", "Subscribe to read the whole story.", "Your session on this site expired an hour ago.", "The server answered with status 503 again.", "Exit with code 404 after the call.", "Ocorreu um erro.", "Er ging iets mis (fout).", "asdf " * 9):
        assert R.names_itself(line, R.mask(line)), line
    for line in ("Every status 99 counts as one here.", "The encoder of the ferrous wheel is here now.", "Sessions are over and nothing else remains.", PROSE):
        assert not R.names_itself(line, R.mask(line)), line


def test_prefix_tree():
    tree = R.PrefixTree()
    a = tree.add(R.mask("Gone: upstream timed out (120 ms) while reading, request ab12"))
    b = tree.add(R.mask("upstream timed out (7 ms) while reading, request zz9"))
    c = tree.add("upstream server gave no answer at all today")
    assert a is b and c is not a
    d = tree.add("solve the puzzle to go on ref abc")
    assert tree.add("solve the puzzle to go on ref xyz") is d and d[-1] == "<*>"
    assert tree.find("solve the puzzle to go on ref qqq") is d and tree.find("solve the puzzle at once or go home") is None and tree.find("") is None


def test_prefix_tree_takes_many_lines_in_one_leaf():
    tree = R.PrefixTree()
    lines = [f"the same {' '.join(chr(97 + (k >> 3 * j) % 8) + chr(97 + j) for j in range(6))}" for k in range(20_000)]
    for line in lines:
        tree.add(line)
    assert len(tree.leaves) == 1 and all(tree.find(x) is not None for x in lines[::997])


def residue(spark, docs, pages=()):
    """Ids of the residue among records (id, url, content, title) and pages (id, url, status, html, type)."""
    a = spark.createDataFrame([(*d, "x") for d in docs], "rec long, url string, content string, title string, masked string")
    b = spark.createDataFrame(list(pages), "page long, url string, status int, html string, kind string")
    lines = R.content_lines(a, "rec", "url", "content", "title", "t").unionByName(R.page_residue_lines(b, "page", "url", "status", "html", "kind", "p"))
    return {(r.tbl, r.id) for r in R.residue_rows(lines).collect()}


def test_residue_rows(spark):
    message, quoted = "The page you requested could not be found.", "A good error page helps the reader to go on."
    rows = [(1, message, None), (2, f"{PROSE} {PROSE}\n{message}", None), (3, None, None), (4, "", None), (5, "{{body}}\nNorwick", None), (6, "Just a title", "Just a title"), (7, "Coming soon. We are still building this page.\nNorwick", None)]
    rows += [(20 + i, f"{PROSE} {PROSE} {i}\n{quoted}", None) for i in range(4)] + [(30, quoted, None), (31, "asdf " * 20, None), (32, f"A short real sentence.\n{message}", None), (33, "  \n ", None), (34, "Norwick", None)]
    rows += [(100 + i, message, None) for i in range(50)]
    found = residue(spark, [(i, None, c, t) for i, c, t in rows])
    assert found == {("t", i) for i in (1, 5, 7, 31, *range(100, 150))}  # 30 quotes what stands in articles elsewhere
    assert residue(spark, []) == set()


def test_notices_without_a_known_phrase(spark):
    """Unseen notices are mined from the corpus: one by the status of its pages, one (over the old limit of 30 words) by its company."""
    failed, long_one = "Whoops, that link is dead.", "Dear guest, " + " ".join("w" + chr(97 + i % 26) * (1 + i // 26) for i in range(40)) + " we are sorry."
    assert not any(R.names_itself(x, R.mask(x)) for x in (failed, long_one))
    shell = "<html><body><nav><a href=/>Home</a></nav><main><span>{}</span></main></body></html>"
    pages = [(i, f"http://h{i % 4}.test/p{i}", 404 if i < 4 else 200, shell.format(failed), "text/html") for i in range(8)]
    docs = [(i, f"http://h{i % 4}.test/d{i}", f"{long_one}\nSite - ref a{i}", None) for i in range(6)]
    # the lines of an article copied to many addresses keep each other's company, and its pages do not fail
    article = "\n".join(f"{x} {PROSE}" for x in ("First", "Then", "Later"))
    docs += [(50 + i, f"http://h{i % 4}.test/copy{i}", article, None) for i in range(9)]
    docs += [(90, "http://h9.test/q", f"{PROSE}\n{long_one}", None)]
    assert residue(spark, docs, pages) == {("p", i) for i in range(8)} | {("t", i) for i in range(6)}


def test_rare_lines_take_the_verdict_of_their_template(spark):
    line = "our puzzle waits until the guest with ticket {} comes back"
    docs = [(i, f"http://h{i % 4}.test/d{i}", line.format("aa"), None) for i in range(6)] + [(7, "http://z.test/", line.format("bcd"), None)]
    assert residue(spark, docs) == {("t", i) for i in (0, 1, 2, 3, 4, 5, 7)}


def test_residue_pages(spark):
    shell = "<html><body><nav><a href=/>Home</a></nav><main><h1>{}</h1>{}</main><footer>Imprint of the whole company and its parts</footer></body></html>"
    rows = [(1, shell.format("Norwick", "<p>Access denied. You do not have permission to view this resource."), "text/html"), (2, shell.format("T", f"<p>{PROSE}"), "text/html"), (3, "{\"error\": 1}", "application/json"), (4, "", "text/html"), (5, None, None), (6, "<html><body><noscript>Please enable JavaScript.</noscript><div id=app></div></body></html>", None)]
    rows += [(7, "<span>404 Not Found</span>", None), (8, "%PDF-1.4 not found", None)]
    assert residue(spark, [], [(i, None, None, h, k) for i, h, k in rows]) == {("p", 1), ("p", 6), ("p", 7)}


def test_records_are_judged_as_in_p5_found(spark, tmp_path):
    message = "Access denied. You do not have permission to view this resource."
    docs = [(1, "a", "u1", message, None), (2, "b", "u2", PROSE, None), (3, "c", "u3", "{{body}}", None)]
    pages = [(k, f"v{k}", 200, f"<html><body><main><p>{PROSE}</p><p>{message}</p></main></body></html>", "text/html") for k in range(3)]
    spark.createDataFrame(docs, "rec_id long, uid string, url string, content string, title string").write.parquet(f"{tmp_path}/crawl_documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, status int, html string, content_type string").write.parquet(f"{tmp_path}/raw_pages.parquet")
    found = {(r.tbl, r.id) for r in C.p5_found(spark, str(tmp_path)).collect()}
    assert found == {("crawl_documents", 3)}  # one of the message's four occurrences stands alone
    assert {r.rec_id for r in C.record_residue(spark, str(tmp_path)).collect()} == {3}
    assert {r.rec_id for r in C.p5_kept(spark, str(tmp_path)).collect()} == {1, 2}


# --- site lines -----------------------------------------------------------------------------------------------------

DOCS = "rec_id long, uid string, host string, content string, lines_removed int"


def site(spark):
    rows = [(i, f"d{i % 40}", "hot", f"Unique line number {'x' * (i % 40)}\nAll rights  reserved {2000 + i}\nBack to top\n\nend", 0) for i in range(60)]
    rows += [(100 + i, f"e{i}", "small", f"Only {chr(97 + i)}\nshared", 0) for i in range(4)]
    rows += [(200, "n", None, "shared", 0), (201, "z", "hot", None, 0), (202, "y", "hot", "", 0)]
    return spark.createDataFrame(rows, DOCS).repartition(4)


def test_boilerplate(spark):
    got = {(r.host, r.line): (r.docs, r.block) for r in L.boilerplate_lines(site(spark), "host", "uid", "content", "rec_id").collect()}
    assert set(got) == {("hot", "all rights reserved #"), ("hot", "back to top"), ("hot", "end")}
    assert {v[0] for v in got.values()} == {40} and len({v[1] for v in got.values()}) == 1
    assert L.boilerplate_lines(site(spark).limit(0), "host", "uid", "content", "rec_id").collect() == []


def test_removal(spark):
    rows = {r.rec_id: r for r in L.remove_boilerplate(site(spark), "host", "uid", "content", "rec_id").collect()}
    assert len(rows) == 67
    assert rows[3].content == "Unique line number xxx\n" and rows[3].lines_removed == 3 and rows[3].blocks_removed == 1
    assert rows[101].content == "Only b\nshared" and rows[200].content == "shared" and rows[201].content is None and rows[202].content == ""


def test_blocks_are_the_unit_of_removal(spark):
    """Two blocks of a host, and a line that repeats without a neighbour; a run of a block's lines is one occurrence."""
    text = "share me\nprint me\n\nbody {0}\nalone\nmore {0}\nlegal one\nlegal two"
    rows = [(i, f"d{i}", "h", text.format("x" * (i + 1)), 0) for i in range(9)] + [(20, "z", "h", "legal two\nown text\nlegal one\nlegal two\nshare me", 0)]
    df = spark.createDataFrame(rows, DOCS)
    lines = {r.line: r.block for r in L.boilerplate_lines(df, "host", "uid", "content", "rec_id").collect()}
    assert set(lines) == {"share me", "print me", "alone", "legal one", "legal two"} and len(set(lines.values())) == 3
    assert lines["share me"] == lines["print me"] and lines["legal one"] == lines["legal two"]
    out = {r.rec_id: (r.content, r.lines_removed, r.blocks_removed) for r in L.remove_boilerplate(df, "host", "uid", "content", "rec_id").collect()}
    assert out[0] == ("\nbody x\nmore x", 5, 3) and out[20] == ("own text", 4, 3)


def test_many_lines_take_the_join(spark, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_NODES", 0)
    assert len(L.boilerplate_lines(site(spark), "host", "uid", "content", "rec_id").collect()) == 3
    test_removal(spark)
    test_blocks_are_the_unit_of_removal(spark)


def test_thresholds_count_documents(spark):
    rows = [(i, f"d{i}", "h", "same\nsame" if i < 5 else f"other {chr(65 + i)}", 0) for i in range(50)]
    df = spark.createDataFrame(rows, DOCS)
    assert [r.line for r in L.boilerplate_lines(df, "host", "uid", "content", "rec_id").collect()] == ["same"]
    more = df.union(spark.createDataFrame([(99, "more", "h", "more", 0)], DOCS))
    assert L.boilerplate_lines(more, "host", "uid", "content", "rec_id").collect() == []  # 5 of 51 is under a tenth
