"""Queries over sketches of documents, and their SQL where it can be expressed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.functions.sketches import minhash, simhash
from skeinwork.operators import similarity as S
from skeinwork.session import cut_lineage, table


def _hashed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", simhash("text", kind).alias("h"))


def simhash_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir, "md5hex")


def simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.simhash_filter(_hashed(spark, sf_dir, "sip13"), "doc_id", "h", 3)


def simhash_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.simhash_clusters(_hashed(spark, sf_dir, "xxhash64"), "doc_id", "h", 3)


def _signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and signature, written once: signatures cost more than all that is done with them."""
    return cut_lineage(table(spark, sf_dir, "documents").select("doc_id", minhash("text").alias("sig")))


def minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.minhash_links(_signed(spark, sf_dir), "doc_id", "sig")


def minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.minhash_classes(_signed(spark, sf_dir), "doc_id", "sig")


def minhash_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.minhash_filter(_signed(spark, sf_dir), "doc_id", "sig")


QUERIES = {f.__name__: f for f in (simhash_md5, simhash_near_duplicates, simhash_clusters, minhash_near_duplicates, minhash_classes, minhash_kept)}
SQL = {
    "simhash_md5": r"""WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}\s\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{00A0}\x{0085}\x1C-\x1F]', '', 'g'), '[\s\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{00A0}\x{0085}\x1C-\x1F]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) ELSE w END) AS t FROM w),
h AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 16))::UBIGINT AS h FROM s),
b AS (SELECT doc_id, bit, sum(CASE WHEN (h >> bit) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM h, (SELECT unnest(range(0, 64))::UBIGINT AS bit) GROUP BY 1, 2),
r AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN (CASE WHEN bit = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << bit::INT) END) ELSE 0 END)::BIGINT AS h FROM b GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(r.h, 0) END AS h FROM documents d LEFT JOIN r USING (doc_id)""",
}
