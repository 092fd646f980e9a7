"""Records that hold an error message, an unfilled template, filler or a notice instead of content.

Every line of a record's main text is masked (numbers, ids, paths, quoted words, runs of filler) and counted over the whole corpus.
A line is known if at least LEAST addresses carry it or if it names itself (PHRASES); only records all of whose lines may be
known stay open, the others have running text. The known lines of open records are mined with a prefix tree of fixed depth
(number of tokens, first tokens, then likeness within the leaf); rare lines of open records that are like a template take it.

Each template gets one verdict. It is residue if at least half of its addresses hold nothing but residue (a fixed point, reached by
taking templates away) and one of these holds:

* it names itself: it has a phrase of PHRASES or is nothing but filler;
* its pages failed: at least FAILED_PAGES of its pages, and FAILED_SHARE of them, came with a status of 400 or more;
* it keeps no company: it stands on at least SPREAD_PAGES addresses of SPREAD_HOSTS hosts, and neither the line before, nor the line after,
  nor the longest other line of its records is the same in more than COMPANY_SHARE of them. (The lines of a copied article
  keep the company of the others.)

Verdicts go back to the lines. A record is residue if all its lines are residue, unresolved slots, labels (a site's name, a
reference number) or headings, and at least one is residue or a slot. Slots are found line by line.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.functions.dom import parse
from skeinwork.llm.main_content import Block, Node, blocks_of, main_element, page_lines, within
from skeinwork.session import cut_lineage

#: Addresses that make a line known.
LEAST = 3
#: Depth of the prefix tree below the number of tokens, and the share of equal tokens that joins a line to a template.
DEPTH, LIKENESS = 2, 0.6
RESIDUE_SHARE = 0.5
FAILED_PAGES, FAILED_SHARE = 3, 0.15
SPREAD_PAGES, SPREAD_HOSTS, COMPANY_SHARE = 5, 3, 0.5
#: Words beside each slot of a line that is an unfilled template.
WORDS_PER_SLOT = 8

# fixed values: phrases by which a verdict on a template may be made at once (English, German, French, Spanish, Italian, Portuguese, Dutch, Russian), lower case
PHRASES = """
not found|could not be found|no longer available|no longer exists|access denied|forbidden|permission to view|not authorized|not authorised|javascript|script|temporarily unavailable|service unavailable
server error|too many requests|went wrong|coming soon|subscribe to read|under construction|still building|checking your browser|loading|active content|content goes here|your text|replace this text|placeholder|sample heading|sample paragraph|sample text|sample caption
traceback|fatal error|exception|error|upstream|unusual traffic|you are human|captcha|has expired|sign in to|log in to|no route|database|ray id|http status|maintenance|try again|please wait
introuvable|n'existe pas|n’existe pas|n'existe plus|n’existe plus|accès refusé|accès interdit|indisponible|erreur|bientôt disponible|en construction|activer|activez|votre texte|réessayer|veuillez
nicht gefunden|gibt es nicht|nicht verfügbar|schiefgelaufen|zugriff|verweigert|skripte|demnächst|im aufbau|ihr text|fehler|wartung|einschalten|aktivieren|bitte warten
no encontrad|no existe|no disponible|ha fallado|acceso denegado|guiones|active |habilít|muy pronto|en construcción|su texto|mantenimiento|espere
non trovat|accesso negato|non disponibile|errore|abilita|attiva |manutenzione|prossimamente|il tuo testo|in costruzione|riprova
não encontrad|acesso negado|indisponível| erro | erro:|ative |habilite|manutenção|em breve|seu texto|em construção
niet gevonden|toegang geweigerd|niet beschikbaar| fout | fout:|schakel |onderhoud|binnenkort|uw tekst|in aanbouw|opnieuw
не найден|доступ запрещ|недоступ|ошибка|включите|обслуживани|скоро |ваш текст|в разработке|повторите
"""
# fixed values: forms of unresolved slots
_SLOTS = r"""\{\{.*?\}\}|\{%.*?%\}|<%.*?%>|\$\{[^}]*\}|#\{[^}]*\}|\{[\w.]+\}|\{\d+\}|%\(\w+\)[sd]|%%\w+%%|\[\[\w+\]\]|__[A-Z][A-Z0-9_]*__|@Model\.\w+|\$[a-z_]+\$|\[object Object\]|\bNaN\b|\bundefined\b|\[insert [\w ]+\]|TODO:|TODO\b|<!--.*?-->|\bTBD\b"""
# fixed values: the vocabulary of the usual filler text
_FILLER = frozenset("lorem ipsum dolor sit amet consectetur adipisci adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris laborum nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est".split())

SLOTS = re.compile(_SLOTS)
_SLOT_SIGNS = ("{", "%", "<", "$", "[", "@", "__", "NaN", "undefined", "TODO", "TBD")
_WORD = re.compile(r"[^\W_]+")
_STATUS = re.compile(r"^[45]\d\d\b")
# fixed values: forms of messages that are no fixed phrases, and a sign that a line may have one
_FORMS = re.compile(r"\b(?:status|code)\s+[45]\d\d\b|\bsession\b.*\bexpired|\berro\b|\bfout\b")
_FORM_SIGNS = ("status", "code", "session", "erro", "fout")


def _searcher():
    """A function that tells whether a lower-case line, with a space on each side, has one of the phrases."""
    words = [x for line in PHRASES.strip().split("\n") for x in line.split("|")]
    try:
        import ahocorasick
    except ImportError:
        return re.compile("|".join(map(re.escape, words))).search
    automaton = ahocorasick.Automaton()
    for w in words:
        automaton.add_word(w, w)
    automaton.make_automaton()
    return lambda line: next(automaton.iter(line), None)


_says = _searcher()
_REF = re.compile(r"\s-\s*ref\s+\S+$", re.I)
_NAMED = re.compile(r"^[^\W\d_]\w*:\s+(?=[^\W_])")
_PATH = re.compile(r"https?://\S+|(?<!\w)/[\w./\-]+")
_FILE = re.compile(r"\b[\w\-]+\.(?:\w{2,4})\b(?=[,\s:]|$)")
_QUOTED = re.compile(r"'[^']*'|\"[^\"]*\"")
_ID = re.compile(r"\b(?=\w*\d)(?=\w*[a-z])\w+\b")
_DIGITS = re.compile(r"\d+")
_FILLED, _REPEATED = "<filler>", "<repeated>"
_FOUR = re.compile(r"[\W_]*(?:[^\W_]+[\W_]+){3}[^\W_]")

LINE, SLOT, LABEL, HEADING = range(4)


def mask(line: str) -> str:
    """A line without what varies: a leading site name, letter case, paths, files, quoted words, ids, numbers and filler."""
    line = _NAMED.sub("", line.strip()).lower()
    if "/" in line:
        line = _PATH.sub("<path>", line)
    if "." in line[:-1]:
        line = _FILE.sub("<file>", line)
    if "'" in line or '"' in line:
        line = _QUOTED.sub("<quoted>", line)
    if _DIGITS.search(line):
        line = _DIGITS.sub("<n>", _ID.sub("<id>", line))
    parts = line.split()
    if len(parts) >= 4:
        for p in (1, 2, 3):
            if len(parts) >= 2 * p + 2 and parts[0] == parts[p] and parts[p:] == parts[:-p]:
                return _REPEATED
        distinct = set(parts)
        few = max(2, len(parts) // 5)
        if len(parts) >= 6 and len(distinct) <= 3 * few and len({x.strip(".,;:!?") for x in parts}) <= few:
            return _REPEATED
        if len(distinct & _FILLER) >= 2 and sum(x.strip(".,;:!?") in _FILLER for x in parts) >= 0.7 * len(parts):
            return _FILLED
    return " ".join(parts)


def names_itself(line: str, masked: str) -> bool:
    """Whether a line is filler or has a phrase or form of messages."""
    low = line.strip().lower()
    return masked in (_FILLED, _REPEATED) or bool(_STATUS.match(low) or _says(f" {low} ") or any(x in low for x in _FORM_SIGNS) and _FORMS.search(low))


def kind_of(line: str) -> int:
    """SLOT: little but unresolved slots; LABEL: up to three words that are no sentence, or a reference; else LINE."""
    if any(x in line for x in _SLOT_SIGNS) and (slots := len(SLOTS.findall(line))):
        return SLOT if len(_WORD.findall(SLOTS.sub(" ", line))) <= WORDS_PER_SLOT * slots else LINE
    if not _FOUR.match(line) and not line.rstrip().endswith((".", "!", "?", "…")) or _REF.search(line):
        return LABEL
    return LINE


def leaf_of(tokens: list[str]) -> tuple:
    """The path to a line's leaf: number of tokens, first DEPTH tokens (<*> for masked ones)."""
    return (len(tokens), *("<*>" if "<" in t or _DIGITS.search(t) else t for t in tokens[:DEPTH]))


class PrefixTree:
    """Templates of masked lines: number of tokens, then DEPTH tokens, then the most alike template of the leaf.

    Templates of a leaf are found through their tokens, so that adding a line does not walk the whole leaf.
    """

    def __init__(self, likeness: float = LIKENESS):
        self.likeness = likeness
        self.leaves: dict[tuple, list[list[str]]] = {}
        self.holders: dict[tuple, dict[tuple[int, str], list[int]]] = {}

    def _best(self, leaf: tuple, tokens: list[str]) -> int | None:
        holders = self.holders.get(leaf, {})
        same = Counter(k for at in enumerate(tokens) for k in holders.get(at, ()))
        best = min(same, key=lambda k: (-same[k], k), default=None)
        return best if best is not None and same[best] >= self.likeness * len(tokens) else None

    def find(self, masked: str) -> list[str] | None:
        """The template most like a line (of equals the first), if enough of their tokens are equal."""
        tokens = masked.split()
        leaf = leaf_of(tokens)
        best = self._best(leaf, tokens)
        return None if best is None else self.leaves[leaf][best]

    def add(self, masked: str) -> list[str]:
        """The template of a line: its tokens, <*> where its lines differ (changed in place by later lines)."""
        tokens = masked.split()
        leaf = leaf_of(tokens)
        own, holders = self.leaves.setdefault(leaf, []), self.holders.setdefault(leaf, {})
        best = self._best(leaf, tokens)
        if best is None:
            for at in enumerate(tokens):
                holders.setdefault(at, []).append(len(own))
            own.append(list(tokens))
            return own[-1]
        template = own[best]
        for k, t in enumerate(tokens):
            if template[k] not in (t, "<*>"):
                holders[(k, template[k])].remove(best)
                template[k] = "<*>"
        return template


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def leaf_key(masked: str) -> int:
    """The leaf of a line's tokens, as a hash."""
    return _hash(repr(leaf_of(masked.split())))


@functools.lru_cache(maxsize=1 << 14)
def _marks(line: str) -> tuple[str, bool, int, int]:
    """Masked text, whether it names itself, key and leaf of a line."""
    masked = mask(line)
    return masked, names_itself(line, masked), _hash(masked), leaf_key(masked)


def lines_of_content(content: str | None, title: str | None) -> list[tuple[int, str]]:
    """(kind, line) of each non-blank line; a line equal to the title is a heading."""
    out = []
    for line in (content or "").splitlines():
        line = line.strip().lstrip("-*• ").strip()
        if line:
            kind = kind_of(line)
            out.append((HEADING if kind == LINE and title and line == title.strip() else kind, line))
    return out


def lines_of_page(page: str | None) -> list[tuple[int, str]]:
    """(kind, line) of the blocks of a page's main body; of a page without visible text, those of its noscript notices."""
    if not page:
        return []
    root = parse(page)
    blocks = blocks_of(root)
    return _lines_of(root, blocks, main_element(blocks))


def _lines_of(root: Node, blocks: list[Block], main: Node | None) -> list[tuple[int, str]]:
    if main is None:
        notices = [n.text().strip() for n in root.find_all("noscript")]
        return [(kind_of(x), x) for x in notices if x]
    out = []
    for b in blocks:
        if within(b.node, main):
            for line in filter(str.strip, b.text.split("\n")):
                kind = kind_of(line)
                out.append((HEADING if kind == LINE and b.node.tag in ("h1", "h2", "h3", "h4", "h5", "h6") else kind, line))
    return out


_SUMMARY = pa.schema(
    [
        ("id", pa.int64()), ("src", pa.int64()), ("host", pa.int64()), ("failed", pa.bool_()),
        ("keys", pa.list_(pa.int64())), ("leaves", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int8())), ("named", pa.list_(pa.bool_())),
        ("texts", pa.list_(pa.string())), ("top_key", pa.int64()), ("top_leaf", pa.int64()),
    ]
)
_LINES = "id long, src long, host long, failed boolean, keys array<long>, leaves array<long>, kinds array<byte>, named array<boolean>, texts array<string>, top_key long, top_leaf long"


def _summary(batch: pa.RecordBatch, found: list[list[tuple[int, str]]], every: bool = False) -> pa.RecordBatch:
    """One row per record with any line (with ``every``: per record). top: its longest line that must be known for the record to be open; null if none must."""
    rows = []
    own = zip(batch.column("id").to_pylist(), batch.column("src").to_pylist(), batch.column("host").to_pylist(), batch.column("failed").to_pylist())
    for (i, src, host, failed), lines in zip(own, found):
        if not lines:
            if every:
                rows.append((i, src, host, failed, (), (), (), (), (), None, None))
            continue
        texts, named, keys, leaves = zip(*(("", False, 0, 0) if k == SLOT else _marks(x) for k, x in lines))
        needed = [(len(m), n) for n, ((k, _), m) in enumerate(zip(lines, texts)) if k == LINE and not named[n]]
        top = max(needed)[1] if needed else None
        rows.append((i, src, host, failed, keys, leaves, [k for k, _ in lines], named, texts, *((None, None) if top is None else (keys[top], leaves[top]))))
    columns = list(zip(*rows)) if rows else [()] * len(_SUMMARY)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SUMMARY.types)], schema=_SUMMARY)


def _addressed(df: DataFrame, tbl: str, id_col: str, url_col: str, failed, *others) -> DataFrame:
    """id; src and host as hashes of the address (a row without address is its own); whether its fetch failed."""
    url = F.lower(url_col)
    src = F.when(url.isNull(), F.xxhash64(F.lit(tbl), id_col)).otherwise(F.xxhash64(url))
    host = F.xxhash64(F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1))
    return df.select(F.col(id_col).cast("long").alias("id"), src.alias("src"), host.alias("host"), failed.alias("failed"), *others)


def content_lines(docs: DataFrame, id_col: str, url_col: str, content_col: str, title_col: str, tbl: str) -> DataFrame:
    """Line summary of records; null and empty contents give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield _summary(part, [lines_of_content(c, t) for c, t in zip(part.column("content").to_pylist(), part.column("title").to_pylist())])

    own = docs.filter(F.length(content_col) > 0)
    own = _addressed(own, tbl, id_col, url_col, F.lit(None).cast("boolean"), F.col(content_col).alias("content"), F.col(title_col).alias("title"))
    return own.mapInArrow(run, _LINES).select(F.lit(tbl).alias("tbl"), "*")


def page_residue_lines(pages: DataFrame, id_col: str, url_col: str, status_col: str, html_col: str, type_col: str, tbl: str) -> DataFrame:
    """Line summary of pages; files that are not HTML (by their type, or without any tag), null and empty pages give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                yield _summary(part, [lines_of_page(h) for h in part.column("html").to_pylist()])

    own = pages.filter(_is_html(html_col, type_col))
    own = _addressed(own, tbl, id_col, url_col, F.col(status_col) >= 400, F.col(html_col).alias("html"))
    return own.mapInArrow(run, _LINES).select(F.lit(tbl).alias("tbl"), "*")


def _is_html(html_col: str, type_col: str):
    return F.coalesce((F.col(type_col).isNull() | F.lower(type_col).rlike("html")) & F.col(html_col).rlike(r"<\s*[!/]?[A-Za-z]"), F.lit(False))


def pages_read_once(pages: DataFrame, id_col: str, url_col: str, status_col: str, html_col: str, type_col: str, tbl: str) -> DataFrame:
    """The rows of ``page_residue_lines`` with ``url, outside`` (as of ``page_sides``) beside them, from one reading of every page with html."""
    schema = pa.schema([*_SUMMARY, ("url", pa.string()), ("outside", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found, outside = [], []
                for h, is_html in zip(part.column("html").to_pylist(), part.column("is_html").to_pylist()):
                    root = parse(h)
                    blocks = blocks_of(root)
                    main = main_element(blocks)
                    found.append(_lines_of(root, blocks, main) if is_html else [])
                    outside.append(list(page_lines(blocks, main)[1]))
                rows = _summary(part, found, True)
                yield pa.RecordBatch.from_arrays([*rows.columns, part.column("url").cast(pa.string()), pa.array(outside, pa.list_(pa.int64()))], schema=schema)

    own = _addressed(pages.filter(F.length(html_col) > 0), tbl, id_col, url_col, F.col(status_col) >= 400, F.col(html_col).alias("html"), F.col(url_col).alias("url"), _is_html(html_col, type_col).alias("is_html"))
    return own.mapInArrow(run, _LINES + ", url string, outside array<long>").select(F.lit(tbl).alias("tbl"), "*")


def _exploded(rows: DataFrame, *names: str) -> DataFrame:
    """tbl, id and one row per line with the elements of the named arrays (without their plural)."""
    single = {"keys": "key", "leaves": "leaf", "kinds": "kind", "named": "named", "texts": "text"}
    kept = [c for c in ("tbl", "id", "src", "host", "failed") if c in rows.columns]
    each = rows.select(*kept, F.posexplode(F.arrays_zip(*names)).alias("pos", "x"))
    return each.select(*kept, "pos", *[F.col(f"x.{n}").alias(single[n]) for n in names])


def _must_be_known(rows: DataFrame) -> DataFrame:
    return _exploded(rows, "keys", "leaves", "kinds", "named").filter((F.col("kind") == LINE) & ~F.col("named")).select("tbl", "id", "key", "leaf")


def open_records(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of lines all of whose lines are known, or rare but in the leaf of a known line of an open record.

    A record is looked up by its longest line first, so that most are closed by one row each.
    """
    narrow = lines.drop("texts")
    often = counts.filter(F.col("n") >= LEAST).select("key")
    first = narrow.filter(F.col("top_key").isNull()).unionByName(narrow.join(often.withColumnRenamed("key", "top_key"), "top_key", "left_semi").select(narrow.columns))
    first = cut_lineage(first)
    rare = cut_lineage(_must_be_known(first).join(often, "key", "left_anti").select("tbl", "id", "leaf").distinct())
    known = first.join(rare.select("tbl", "id"), ["tbl", "id"], "left_anti")
    leaves = cut_lineage(_exploded(known, "leaves").select("leaf").distinct())
    later = narrow.join(leaves.withColumnRenamed("leaf", "top_leaf"), "top_leaf", "left_semi").select(narrow.columns)
    late = _must_be_known(later).join(often, "key", "left_anti").select("tbl", "id", "leaf").distinct()
    loose = rare.unionByName(late)
    like = loose.select("tbl", "id").distinct().join(loose.join(leaves, "leaf", "left_anti").select("tbl", "id"), ["tbl", "id"], "left_anti")
    wanted = known.select("tbl", "id").unionByName(like).distinct()
    return lines.join(wanted, ["tbl", "id"], "left_semi").select(lines.columns)


def mined_templates(each: DataFrame, counts: DataFrame) -> DataFrame:
    """``key, template, says, firm, n`` of the lines of open records; lines that fit no template have none.

    says: the template names itself; firm: at least two words of it, and three quarters of it, are the same in all its lines.
    A leaf holds each distinct masked line once.
    """
    words = each.filter(F.col("kind") != SLOT).groupBy("key").agg(F.first("leaf").alias("leaf"), F.min("text").alias("text"), F.max("named").alias("named"))
    words = words.join(counts, "key", "left").withColumn("n", F.coalesce("n", F.lit(1)))

    def mine(pdf: pd.DataFrame) -> Iterator[tuple]:
        tree = PrefixTree()
        pdf = pdf.sort_values(["n", "text"], ascending=[False, True])
        lines = list(zip(pdf["key"], pdf["text"], pdf["n"], pdf["named"]))
        found = {k: tree.add(t) for k, t, n, named in lines if n >= LEAST or named}
        found |= {k: m for k, t, _, _ in lines if k not in found and (m := tree.find(t)) is not None}
        voices: dict[int, list[bool]] = {}
        for k, _, _, named in lines:
            if k in found:
                voices.setdefault(id(found[k]), []).append(named)
        for k, _, n, _ in lines:
            if k in found:
                own = found[k]
                fixed = [t for t in own if t != "<*>"]
                firm = len(fixed) >= 0.75 * len(own) and sum(any(c.isalpha() for c in t) for t in fixed) >= 2
                said = 2 * sum(voices[id(own)]) >= len(voices[id(own)])
                yield k, _hash(f"{leaf_of(own)} {' '.join(own)}"), said, firm, n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Leaf by leaf of a partition that is sorted by leaf."""
        kept: list[pd.DataFrame] = []
        for pdf in batches:
            starts = [0, *(pdf["leaf"].to_numpy()[1:] != pdf["leaf"].to_numpy()[:-1]).nonzero()[0] + 1, len(pdf)]
            rows: list[tuple] = []
            for a, b in zip(starts, starts[1:]):
                if kept and (a or kept[0]["leaf"].iloc[0] != pdf["leaf"].iloc[a]):
                    rows += mine(pd.concat(kept))
                    kept = []
                kept.append(pdf.iloc[a:b])
            yield pd.DataFrame(rows, columns=_TEMPLATES)
        if kept:
            yield pd.DataFrame(list(mine(pd.concat(kept))), columns=_TEMPLATES)

    parts = int(each.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return words.repartition(parts, "leaf").sortWithinPartitions("leaf").mapInPandas(run, "key long, template long, says boolean, firm boolean, n long")


_TEMPLATES = ["key", "template", "says", "firm", "n"]


def template_verdicts(each: DataFrame, templates: DataFrame) -> DataFrame:
    """``template, all`` of those that may be residue, by the lines (with their template) of the open records.

    all: the addresses with a line of the template, each counted once per different line.
    """
    placed = each.withColumn("size", F.length("text")).withColumn("said", F.when(F.col("kind") == LINE, F.col("template")))
    here, around = Window.partitionBy("tbl", "id").orderBy("pos"), Window.partitionBy("tbl", "id")
    placed = placed.withColumn("before", F.lag("said").over(here)).withColumn("after", F.lead("said").over(here))
    placed = placed.withColumn("longest", F.max(F.when(F.col("said").isNotNull(), F.struct("size", "said"))).over(around)["said"])
    placed = placed.withColumn("second", F.max(F.when(F.col("said") != F.col("longest"), F.struct("size", "said"))).over(around)["said"])
    placed = placed.filter(F.col("template").isNotNull()).withColumn("other", F.when(F.col("template") == F.col("longest"), F.col("second")).otherwise(F.col("longest")))
    once = placed.groupBy("tbl", "id", "template").agg(*[F.min_by(c, "pos").alias(c) for c in ("src", "host", "failed", "before", "after", "other")])
    once = cut_lineage(once)

    total = templates.groupBy("template").agg(F.sum("n").alias("all"), F.max("says").alias("says"), F.max("firm").alias("firm"))
    pages = once.groupBy("template", "src").agg(F.max("failed").alias("failed"), F.count("*").alias("records"))
    pages = pages.groupBy("template").agg(F.count("*").alias("srcs"), F.sum("records").alias("records"), F.count("failed").alias("pages"), F.sum(F.col("failed").cast("int")).alias("failed"))
    hosts = once.groupBy("template", "host").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count("*").alias("hosts"))
    mates = once.select("template", F.explode(F.map_from_arrays(F.array(F.lit(0), F.lit(1), F.lit(2)), F.array("before", "after", "other"))).alias("side", "mate"))
    mates = mates.filter(F.col("mate").isNotNull() & (F.col("mate") != F.col("template"))).groupBy("template", "side", "mate").agg(F.count("*").alias("met"))
    mates = mates.groupBy("template").agg(F.max("met").alias("met"))
    known = total.join(pages, "template").join(hosts, "template").join(mates, "template", "left")
    failed = (F.col("failed") >= FAILED_PAGES) & (F.col("failed") >= FAILED_SHARE * F.col("pages"))
    spread = F.col("firm") & (F.col("srcs") >= SPREAD_PAGES) & (F.col("hosts") >= SPREAD_HOSTS) & (F.coalesce("met", F.lit(0)) <= COMPANY_SHARE * F.col("records"))
    return known.filter(F.col("says") | F.coalesce(failed, F.lit(False)) | spread).select("template", "all")


def _judged(each: DataFrame, bad: DataFrame) -> DataFrame:
    """each with ``bad``, and without the records that have a line that is not."""
    marked = each.join(bad.select("template").withColumn("bad", F.lit(True)), "template", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    content = marked.filter((F.col("kind") == LINE) & ~F.col("bad")).select("tbl", "id").distinct()
    return marked.join(content, ["tbl", "id"], "left_anti")


def residue_rows(lines: DataFrame, written: bool = False) -> DataFrame:
    """``tbl, id`` of the residue rows among the line summaries (of ``content_lines`` and ``page_residue_lines``).

    Counts are taken over all rows; lines travel as hashes, and texts only of open records. Spark jobs run while the
    query is built: the summaries (unless they are ``written`` already) and the open records are written to the shared folder. An
    empty table gives no rows.
    """
    lines = lines.filter(F.size("keys") > 0)
    lines = lines if written else cut_lineage(lines)
    told = lines.select("src", F.explode(F.array_distinct("keys")).alias("key")).filter(F.col("key") != 0)
    counts = cut_lineage(told.groupBy("key", "src").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1))
    rows = cut_lineage(open_records(lines, counts))
    each = _exploded(rows, "keys", "leaves", "kinds", "named", "texts")
    templates = cut_lineage(mined_templates(each, counts))
    each = cut_lineage(each.join(templates.select("key", "template"), "key", "left"))
    unknown = each.filter((F.col("kind") == LINE) & F.col("template").isNull()).select("tbl", "id").distinct()
    each = each.join(unknown, ["tbl", "id"], "left_anti")
    bad = cut_lineage(template_verdicts(each, templates))
    left, before = bad.count(), -1
    while left != before:  # every round but the last takes templates away
        alone = _judged(each, bad).filter("bad").groupBy("template", "key", "src").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count("*").alias("alone"))
        bad = cut_lineage(bad.join(alone, "template").filter(F.col("alone") >= RESIDUE_SHARE * F.col("all")).select("template", "all"))
        left, before = bad.count(), left
    sign = (F.col("kind") == SLOT) | F.col("bad") & ((F.col("kind") != LABEL) | F.col("named"))
    return _judged(each, bad).groupBy("tbl", "id").agg(F.max(sign).alias("sign")).filter("sign").select("tbl", "id")
