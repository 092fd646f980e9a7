"""Lines repeated across one site's documents, as blocks of a weighted line graph.

Nodes are (host, normalised line) weighted by the number of documents of the host that carry the line; edges join
lines that follow each other, weighted alike. Nodes and edges of high support are kept, and the connected
components of what is left are the host's boilerplate blocks (a line without a kept edge is a block of its own). An occurrence of
a block is a run of a text's lines that belong to it, blank lines aside; every occurrence is deleted.

Counts are exact and over all rows: documents delivered more than once are counted once, each task sums its own rows
before anything is shuffled, and lines travel as 64-bit hashes until they are known to be frequent. A host has at
most 1 / MIN_SHARE times its lines per document of kept lines, however many rows it has, so a host's
graph is small and its components are found in one task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinwork.operators.dedup import drop_repeats
from skeinwork.session import cut_lineage

MIN_DOCS, MIN_SHARE = 5, 0.1
#: Kept lines are handed to the tasks as a set of hashes only up to so many (counted first).
BROADCAST_NODES = 200_000

_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")


def normal_line(line: str) -> str:
    """Lower-cased, runs of digits as #, runs of white space as one space, trimmed."""
    return _SPACE.sub(" ", _DIGITS.sub("#", line.lower())).strip()


def _hash(host: str, line: str) -> int:
    return xxhash.xxh64_intdigest(f"{host}\n{line}") - (1 << 63)


def _once(docs: DataFrame, host_col: str, doc_col: str, text_col: str, rec_col: str) -> DataFrame:
    """host, doc, text of one delivery per document (that of the least rec_col), with non-null text and host."""
    own = docs.filter(F.col(text_col).isNotNull() & F.col(host_col).isNotNull())
    own = own.select(F.col(host_col).alias("host"), F.col(doc_col).alias("doc"), F.col(text_col).alias("text"), F.col(rec_col).alias("rec"))
    return drop_repeats(own, ["doc", "host"], "rec")


_COUNTS = "host string, kind int, node long, after long, n long"
_HOST, _NODE, _EDGE = 0, 1, 2


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per batch: documents per host, per line of a host and per pair of neighbouring lines (unused columns are 0)."""
    for pdf in batches:
        counts: dict[tuple, int] = {}
        for host, text in zip(pdf["host"], pdf["text"]):
            lines = [_hash(host, x) for x in map(normal_line, text.split("\n")) if x]
            for key in {(host, _HOST, 0, 0), *((host, _NODE, x, 0) for x in lines), *((host, _EDGE, x, y) for x, y in zip(lines, lines[1:]))}:
                counts[key] = counts.get(key, 0) + 1
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["host", "kind", "node", "after", "n"])


def line_supports(docs: DataFrame, host_col: str, doc_col: str, text_col: str, rec_col: str) -> tuple[DataFrame, DataFrame]:
    """Kept nodes (``host, node, docs``) and kept edges (``host, node, after, docs``) of the line graph."""
    counted = _once(docs, host_col, doc_col, text_col, rec_col).select("host", "text").mapInPandas(_count, _COUNTS)
    sums = counted.groupBy("host", "kind", "node", "after").agg(F.sum("n").alias("docs"))
    frequent = sums.filter((F.col("kind") == _HOST) | (F.col("docs") >= MIN_DOCS))
    # one row per host is joined to its frequent lines; lines are spread, hosts are not collected
    hosts = frequent.filter(F.col("kind") == _HOST).select("host", F.col("docs").alias("host_docs"))
    kept = frequent.filter(F.col("kind") != _HOST).join(hosts, "host").filter(F.col("docs") >= MIN_SHARE * F.col("host_docs"))
    kept = cut_lineage(kept.select("host", "kind", "node", "after", "docs"))  # small, and used twice
    nodes = kept.filter(F.col("kind") == _NODE).select("host", "node", "docs")
    return nodes, kept.filter(F.col("kind") == _EDGE).select("host", "node", "after", "docs")


def _components(pdf: pd.DataFrame) -> pd.DataFrame:
    """block (the least node of its component) of each node of one host."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(pdf["node"].tolist(), pdf["after"].tolist()):
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    nodes = pdf[pdf["node"] == pdf["after"]][["host", "node", "docs"]].drop_duplicates().reset_index(drop=True)
    nodes["block"] = [find(int(x)) for x in nodes["node"]]
    return nodes


def _shared_nodes(blocks: DataFrame):
    """The block of each node hash (which holds the host), broadcast, or None if there are more than BROADCAST_NODES."""
    if blocks.count() > BROADCAST_NODES:
        return None
    return blocks.sparkSession.sparkContext.broadcast({r.node: r.block for r in blocks.select("node", "block").toLocalIterator()})


def boilerplate_blocks(docs: DataFrame, host_col: str, doc_col: str, text_col: str, rec_col: str) -> DataFrame:
    """``host, node, docs, block``: the kept lines (as hashes) and the component of the line graph each belongs to."""
    nodes, edges = line_supports(docs, host_col, doc_col, text_col, rec_col)
    graph = nodes.withColumn("after", F.col("node")).unionByName(edges.filter(F.col("node") != F.col("after")))
    return cut_lineage(graph.groupBy("host").applyInPandas(_components, "host string, node long, docs long, block long"))


def boilerplate_lines(docs: DataFrame, host_col: str, doc_col: str, text_col: str, rec_col: str) -> DataFrame:
    """``host, line, docs, block``: the lines of every block of a host.

    A line counts once per document; blank lines, null texts and null hosts do not count. An empty table gives no rows.
    """
    blocks = boilerplate_blocks(docs, host_col, doc_col, text_col, rec_col)
    own = docs.filter(F.col(text_col).isNotNull() & F.col(host_col).isNotNull()).select(F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    wanted = _shared_nodes(blocks)

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = wanted.value if wanted is not None else None
        for pdf in batches:
            found = {(h, x) for h, t in zip(pdf["host"], pdf["text"]) for x in map(normal_line, t.split("\n")) if x}
            rows = [(h, n, x) for h, x in found if (n := _hash(h, x)) is not None and (known is None or n in known)]
            yield pd.DataFrame(rows, columns=["host", "node", "line"])

    spelled = own.mapInPandas(spell, "host string, node long, line string")
    named = spelled.join(blocks, ["host", "node"]).groupBy("host", "node").agg(F.min("line").alias("line"), F.first("docs").alias("docs"), F.first("block").alias("block"))
    return named.select("host", "line", "docs", "block")


def remove_boilerplate(docs: DataFrame, host_col: str, doc_col: str, text_col: str, rec_col: str) -> DataFrame:
    """docs with text_col freed of the occurrences of its host's blocks, and ``lines_removed, blocks_removed`` (occurrences).

    Lines left keep their text and order; null texts stay null, and rows with a null host keep their text (0 removed).
    Columns of docs with the names of the result are replaced. With more than BROADCAST_NODES kept lines, rec_col must be unique.
    """
    blocks = boilerplate_blocks(docs, host_col, doc_col, text_col, rec_col)
    rows = docs.drop("lines_removed", "blocks_removed")
    names, at = rows.columns, rows.columns.index(text_col)
    schema = T.StructType([*rows.schema.fields, T.StructField("lines_removed", T.IntegerType()), T.StructField("blocks_removed", T.IntegerType())])
    shared = _shared_nodes(blocks)
    if shared is None:  # too many for every task: the lines of all rows meet them by join, spread by line
        rows = rows.join(_hits(docs, blocks, host_col, text_col, rec_col), F.col(rec_col) == F.col("__rec"), "left").drop("__rec")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, removed, runs = [], [], []
            hosts, found = b.column(host_col).to_pylist(), b.column(text_col).to_pylist()
            carried = None if shared is not None else b.column("__hits")
            for k, (h, t) in enumerate(zip(hosts, found)):
                left, gone, last = [], [], None
                hits = None if carried is None else {x["no"]: x["block"] for x in carried[k].as_py() or ()}
                for no, x in enumerate(t.split("\n") if t is not None and h is not None else ()):
                    y = normal_line(x)
                    block = None if not y else shared.value.get(_hash(h, y)) if hits is None else hits.get(no)
                    if block is None:
                        left.append(x)
                        last = None if y else last  # blank lines do not part an occurrence
                    else:
                        gone.append(block != last)
                        last = block
                texts.append("\n".join(left) if gone else t)
                removed.append(len(gone))
                runs.append(sum(gone))
            cols = [b.column(c) for c in names]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(removed, pa.int32()), pa.array(runs, pa.int32())], names=[*names, "lines_removed", "blocks_removed"])

    return rows.mapInArrow(clean, schema)


def _hits(docs: DataFrame, blocks: DataFrame, host_col: str, text_col: str, rec_col: str) -> DataFrame:
    """``__rec, __hits``: per row the numbers of its lines that belong to a block, with the block."""

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r, no, _hash(h, y)) for r, h, t in zip(pdf["rec"], pdf["host"], pdf["text"]) for no, x in enumerate(t.split("\n")) if (y := normal_line(x))]
            yield pd.DataFrame(rows, columns=["__rec", "no", "node"])

    own = docs.filter(F.col(text_col).isNotNull() & F.col(host_col).isNotNull()).select(F.col(rec_col).alias("rec"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    kind = docs.schema[rec_col].dataType.simpleString()
    met = own.mapInPandas(hashes, f"__rec {kind}, no int, node long").join(blocks.select("node", "block"), "node")
    return met.groupBy("__rec").agg(F.collect_list(F.struct("no", "block")).alias("__hits"))
