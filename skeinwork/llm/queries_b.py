"""Queries of problems 3, 4, 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinwork.functions.hosts import host_of
from skeinwork.llm.canonical import HYPHENS, INVISIBLE, LOOKALIKES, SPACES, canonical_text, lookalike_pairs
from skeinwork.llm.encode import decode_ids, encode_corpus, token_counts
from skeinwork.llm.packing import pack_items
from skeinwork.llm.site_lines import boilerplate_lines, remove_boilerplate
from skeinwork.llm.split import split_texts
from skeinwork.operators.dedup import drop_repeats
from skeinwork.session import cut_lineage, table


def _limit(spark: SparkSession, sf_dir: str, name: str) -> tuple[int, int]:
    row = table(spark, sf_dir, "size_limits").filter(F.col("limit_name") == name).first()
    return row.max_size, row.overlap


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid, field, text of every content and markdown, one delivery (all carry the same text) per document."""
    docs = table(spark, sf_dir, "crawl_documents").select("rec_id", "uid", "content", "markdown")
    own = drop_repeats(docs, ["uid"], "rec_id")
    return own.select("uid", F.expr("stack(2, 'content', content, 'markdown', markdown) AS (field, text)"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, overlap = _limit(spark, sf_dir, "split")
    return split_texts(_fields(spark, sf_dir), "text", size, overlap)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that came out in more than one piece."""
    docs = table(spark, sf_dir, "crawl_documents").select("uid", F.expr("stack(2, 'content', content, 'markdown', markdown) AS (field, text)"))
    size, overlap = _limit(spark, sf_dir, "split")
    return split_texts(docs, "text", size, overlap).filter(F.col("piece_no") == 1).select("uid", "field").distinct()


def p3_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the pieces of p3_pieces: joined without the overlaps they are the text; none is too long; all overlap as specified."""
    size, overlap = _limit(spark, sf_dir, "split")
    own = Window.partitionBy("uid", "field").orderBy("piece_no")
    late = F.col("piece_no") > 0
    pieces = p3_pieces(spark, sf_dir).withColumn("before", F.lag("piece_text").over(own))
    same = F.expr(f"right(before, {overlap}) = left(piece_text, {overlap})") if overlap else F.lit(True)
    added = F.when(late, F.expr(f"substring(piece_text, {overlap + 1})")).otherwise(F.col("piece_text"))
    sums = pieces.groupBy("uid", "field").agg(
        F.sort_array(F.collect_list(F.struct("piece_no", added.alias("text")))).alias("parts"),
        F.max((F.length("piece_text") > size).cast("int")).alias("too_long"),
        F.sum(F.when(late & ~same, 1).otherwise(0)).alias("apart"),
        F.max(F.col("piece_no")).alias("last"),
    )
    return sums.select("uid", "field", F.md5(F.array_join(F.col("parts.text"), "")).alias("digest"), "too_long", "apart", (F.col("last") > 0).cast("int").alias("cut"))


def _hosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "crawl_documents").select(host_of("url").alias("host"), "uid", "rec_id", "content")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate_lines(_hosted(spark, sf_dir), "host", "uid", "content", "rec_id").select(F.col("host").alias("domain"), "line")


def p4_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = boilerplate_lines(_hosted(spark, sf_dir), "host", "uid", "content", "rec_id")
    return lines.groupBy(F.col("host").alias("domain"), "block").agg(F.count("*").alias("n_lines"), F.max("docs").alias("docs"), F.sort_array(F.collect_list("line")).alias("lines"))


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_boilerplate(_hosted(spark, sf_dir), "host", "uid", "content", "rec_id")
    return rows.select("rec_id", "uid", F.col("host").alias("domain"), "content", "lines_removed", "blocks_removed")


def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_clean(spark, sf_dir).select("rec_id", "content", "lines_removed")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "ids", "byte_bpe_50k")


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of what each document's ids decode to."""
    return decode_ids(p8_ids(spark, sf_dir), "ids", "text").select("doc_id", F.md5("text").alias("digest"))


def p9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p9_packed: every document is there, no container is over its size, and only larger texts are split."""
    size, _ = _limit(spark, sf_dir, "pack")
    packed = cut_lineage(p9_packed(spark, sf_dir))  # read twice
    full = packed.filter("container_id IS NOT NULL").groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.coalesce(F.sum((F.col("n") > size).cast("int")), F.lit(0)).alias("overfull"))
    each = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("pieces"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"))
    split = each.agg(F.count("*").alias("documents"), F.sum((F.col("pieces") != F.greatest(F.lit(1), F.ceil(F.col("n") / size))).cast("int")).alias("needless"), F.sum((F.col("end") != F.col("n")).cast("int")).alias("gaps"))
    return split.select("documents", F.lit(1).alias("k"), F.coalesce("needless", F.lit(0)).alias("needless"), F.coalesce("gaps", F.lit(0)).alias("gaps")).join(full.withColumn("k", F.lit(1)), "k").drop("k")


def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, _ = _limit(spark, sf_dir, "pack")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = token_counts(docs, "text").select("doc_id", "n_tokens")
    packed = pack_items(sized, "doc_id", "n_tokens", size, n_items=docs.count())
    return packed.select("container_id", "doc_id", "piece_no", F.col("start").alias("start_token"), F.col("size").alias("n_tokens"))


def p10_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return canonical_text(docs, "text", "canonical").select("doc_id", "canonical")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = lookalike_pairs(docs, "doc_id", "text")
    return pairs.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def _form_sql() -> str:
    """The canonical form in plain SQL, one string function after another (for the characters of one code point each)."""
    gone = "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in [*INVISIBLE, (0, 8), (11, 31), (0x7F, 0x9F)])
    spaces = "".join(chr(c) for lo, hi in SPACES for c in range(lo, hi + 1))
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    source = wide + spaces + "".join(map(chr, HYPHENS)) + "".join(LOOKALIKES) + "\u212a\u212b"
    target = "".join(chr(ord(c) - 0xFEE0) for c in wide) + " " * len(spaces) + "-" * len(HYPHENS) + "".join(LOOKALIKES.values()) + "K\u00c5"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    form = f"regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[{gone}]', '', 'g')"
    form = f"translate({form}, {quoted(source)}, {quoted(target)})"
    for a, b in (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\u0451", "\u00eb"), ("\u0401", "\u00cb")):
        form = f"replace({form}, '{a}', '{b}')"
    return f"nfc_normalize({form})"


QUERIES = {f.__name__: f for f in (p3_pieces, p3_found, p3_rejoined, p4_found, p4_blocks, p4_clean, p4_cleaned, p8_ids, p8_roundtrip, p9_packed, p9_rules, p10_text, p10_found)}
SQL = {
    "p10_text": f"SELECT doc_id, {_form_sql()} AS canonical FROM documents",
    "p10_found": f"""WITH c AS MATERIALIZED (SELECT doc_id, text, {_form_sql()} AS form FROM documents)
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM c a JOIN c b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text WHERE regexp_matches(a.form, '[^\\s]')""",
    "p3_found": """
SELECT DISTINCT uid, field FROM (
  SELECT uid, 'content' AS field, length(content) AS n FROM crawl_documents UNION ALL
  SELECT uid, 'markdown', length(markdown) FROM crawl_documents)
WHERE n > (SELECT max_size FROM size_limits WHERE limit_name = 'split')""",
    "p3_rejoined": """
WITH d AS (SELECT uid, min_by(content, rec_id) AS content, min_by(markdown, rec_id) AS markdown FROM crawl_documents GROUP BY uid),
t AS (SELECT uid, 'content' AS field, content AS text FROM d UNION ALL SELECT uid, 'markdown', markdown FROM d)
SELECT uid, field, md5(text) AS digest, 0 AS too_long, 0 AS apart,
  CASE WHEN length(text) > (SELECT max_size FROM size_limits WHERE limit_name = 'split') THEN 1 ELSE 0 END AS cut FROM t WHERE length(text) > 0""",
    "p8_roundtrip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p9_rules": "SELECT count(*) AS documents, 0 AS overfull, 0 AS needless, 0 AS gaps FROM documents",
    "p4_cleaned": r"""
WITH d AS (SELECT DISTINCT uid, content, rec_id, nullif(regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(regexp_replace(trim(url), '^([a-zA-Z][a-zA-Z0-9+.\-]*:)?//', ''), '^[^/?#\\]*'), '^.*@', '')), ':\d*$', ''), '^www\.', ''), '') AS domain FROM crawl_documents),
n AS (SELECT domain, count(DISTINCT uid) AS total FROM d WHERE content IS NOT NULL GROUP BY domain),
x AS MATERIALIZED (SELECT domain, uid, rec_id, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS no FROM d WHERE content IS NOT NULL),
l AS MATERIALIZED (SELECT *, trim(regexp_replace(regexp_replace(lower(raw), '\d+', '#', 'g'), '\s+', ' ', 'g')) AS line FROM x),
f AS (SELECT l.domain, l.line FROM l JOIN n ON l.domain = n.domain WHERE l.line <> '' GROUP BY l.domain, l.line, n.total HAVING count(DISTINCT l.uid) >= 5 AND count(DISTINCT l.uid) >= 0.1 * n.total),
c AS (SELECT l.rec_id, string_agg(CASE WHEN f.line IS NULL THEN l.raw END, chr(10) ORDER BY l.no) AS content, count(f.line)::INT AS lines_removed FROM l LEFT JOIN f ON l.domain = f.domain AND l.line = f.line GROUP BY l.rec_id)
SELECT d.rec_id, CASE WHEN d.content IS NOT NULL THEN coalesce(c.content, '') END AS content, coalesce(c.lines_removed, 0)::INT AS lines_removed FROM d LEFT JOIN c USING (rec_id)""",
    "p4_found": r"""
WITH d AS (SELECT DISTINCT uid, content, nullif(regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(regexp_replace(trim(url), '^([a-zA-Z][a-zA-Z0-9+.\-]*:)?//', ''), '^[^/?#\\]*'), '^.*@', '')), ':\d*$', ''), '^www\.', ''), '') AS domain
           FROM crawl_documents WHERE content IS NOT NULL),
n AS (SELECT domain, count(DISTINCT uid) AS total FROM d GROUP BY domain),
l AS (SELECT domain, uid, trim(regexp_replace(regexp_replace(lower(unnest(string_split(content, chr(10)))), '\d+', '#', 'g'), '\s+', ' ', 'g')) AS line FROM d)
SELECT l.domain AS domain, l.line AS line FROM l JOIN n ON l.domain = n.domain WHERE l.line <> ''
GROUP BY l.domain, l.line, n.total HAVING count(DISTINCT l.uid) >= 5 AND count(DISTINCT l.uid) >= 0.1 * n.total""",
}
