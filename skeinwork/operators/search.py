"""Full-text search over documents: an inverted index as a table, BM25 scores, one hit per parent document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K1, B = 1.2, 0.75


def terms(text: Column | str) -> Column:
    """Lower-case runs of letters and digits."""
    t = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _times(term: str) -> Column:
    return F.size(F.filter("__w", lambda w: w == F.lit(term)))


def index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, term, tf, size`` of every term of every document; null texts have none."""
    own = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), terms(text_col).alias("w"))
    each = own.select("id", F.size("w").alias("size"), F.explode("w").alias("term"))
    return each.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("size").alias("size"))


def build_index(docs: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """Write the index of docs: ``path/terms``, in ranges of the term so that a query reads few row groups, and ``path/stats``.

    A term's rows are spread over several ranges when it is frequent.
    """
    index(docs, id_col, text_col).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).repartitionByRange("term", "salt").sortWithinPartitions("term").drop("salt").write.mode("overwrite").parquet(f"{path}/terms")
    own = docs.filter(F.col(text_col).isNotNull()).select(F.size(terms(text_col)).alias("size"))
    own.agg(F.count("*").alias("n"), F.coalesce(F.avg("size"), F.lit(0.0)).alias("mean")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def search_index(spark: SparkSession, path: str, query: str) -> DataFrame:
    """``id, score`` of every document with a term of the query, by the index at path: the filter on terms reaches the scan, texts
    are not read. Scores are those of ``search``; a query without terms has no hits."""
    wanted = list(dict.fromkeys(_words(query)))
    if not wanted:
        return spark.read.parquet(f"{path}/terms").select("id", F.lit(0.0).alias("score")).limit(0)
    hits = spark.read.parquet(f"{path}/terms").filter(F.col("term").isin(wanted))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    stats = spark.read.parquet(f"{path}/stats").first()  # one row
    weighed = hits.join(F.broadcast(df), "term")  # a row per word of the query
    idf = F.log(1 + (F.lit(float(stats.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(stats.mean or 1.0)))
    return weighed.groupBy("id").agg(F.round(F.sum(part), 6).alias("score")).filter("score > 0")


def map_search(pages: DataFrame, term: str | None, limit: int, order: str) -> DataFrame:
    """Pages (url, title, description) that have the term, whatever its case, in one of these: those with it in their address first, else
    in the order of a unique column; without a term all pages in that order. Null titles and descriptions have no term."""
    if not term:
        return pages.orderBy(order).limit(limit)
    has = lambda c: F.coalesce(F.lower(c).contains(term.lower()), F.lit(False))
    return pages.filter(has("url") | has("title") | has("description")).orderBy(F.when(has("url"), 0).otherwise(1), order).limit(limit)


def index_settings(features: set[str], searchable: list[str], filterable: list[str], sortable: list[str], custom: list[str] = ()) -> dict:
    """The columns of an index that are searched, filtered and sorted by, and the one whose values come out once, for the features in use."""
    texts = [f for f in ("markdown", "ai_summary", "ai_extraction") if f in features]
    fields = [f"custom.{c}" for c in custom]
    blocks = "block_split" in features
    return {
        "searchable": [*searchable, *texts, *fields, *(("h4", "h5", "h6") if blocks else ())],
        "filterable": [*filterable, *(("schema",) if "schema" in features else ()), *fields, *(("parent_document_id", "page_block", "anchor") if blocks else ())],
        "sortable": [*sortable, *(("page_block",) if blocks else ())],
        "distinct": "parent_document_id" if blocks else None,
    }


def _words(query: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in query.lower()).split()


def search(docs: DataFrame, id_col: str, text_col: str, query: str, limit: int | None = 20, offset: int = 0, where: Column | None = None, distinct: str | None = None) -> DataFrame:
    """``id, score`` of the documents with a term of the query, best first, ties by id; with ``distinct`` the best of each of its values.

    Only the query's terms are exploded: term counts are taken within each row, so what is shuffled is one row per hit, not per
    word. Statistics are those of all documents, whatever ``where`` admits (a job counts them while the query is built). limit None
    gives every hit. This reads all texts; ``build_index`` and ``search_index`` answer many queries over one table.
    """
    wanted = list(dict.fromkeys(_words(query)))
    rows = docs.filter(F.col(text_col).isNotNull()).withColumn("__w", terms(text_col))
    counts = {t: _times(t) for t in wanted}
    rows = rows.select(*docs.columns, F.size("__w").alias("__size"), *[c.alias(f"__tf{k}") for k, c in enumerate(counts.values())]) if wanted else rows.withColumn("__size", F.size("__w"))
    stats = rows.agg(F.count("*").alias("n"), F.avg("__size").alias("mean"), *[F.count_if(F.col(f"__tf{k}") > 0).alias(f"df{k}") for k in range(len(wanted))]).first()
    score: Column = F.lit(0.0)
    for k in range(len(wanted)):
        idf = F.log(F.lit(1 + (stats.n - stats[f"df{k}"] + 0.5) / (stats[f"df{k}"] + 0.5)))
        tf = F.col(f"__tf{k}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("__size") / F.lit(stats.mean or 1.0)))
    hits = rows.withColumn("score", F.round(score, 6)).filter("score > 0")
    if where is not None:
        hits = hits.filter(where)
    if distinct is not None:
        best = Window.partitionBy(F.coalesce(F.col(distinct).cast("string"), F.concat(F.lit("\u0000"), F.col(id_col).cast("string")))).orderBy(F.desc("score"), id_col)
        hits = hits.withColumn("__rank", F.row_number().over(best)).filter("__rank = 1")
    out = hits.select(F.col(id_col).alias("id"), "score").orderBy(F.desc("score"), "id")
    return out if limit is None else out.offset(offset).limit(limit)
