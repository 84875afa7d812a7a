"""Text blocks and metadata out of citation and article XML, and of loose HTML.

Markup needs an ordered walk of mixed content, which the relational readers
lose, so fragments are walked in Python, one record at a time, in Arrow batches.
"""

from __future__ import annotations

import html
import itertools
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T

#: Elements whose contents don't count (fixed values).
IGNORED = ("table", "table-wrap", "xref", "disp-formula", "inline-formula", "ref-list", "bio", "ack", "graphic", "media", "tex-math", "mml:math", "object-id", "ext-link")
#: Elements that start a new block (fixed values).
SEPARATING = ("title", "p", "sec", "break", "def-item", "list-item", "caption")
#: Loose HTML: elements without text, and void elements (fixed values).
HTML_IGNORED = ("script", "style", "nav", "head", *IGNORED)
#: Records that a task turns into rows at once.
RECORDS = 128
HTML_VOID = ("br", "hr", "img", "meta", "link", "input")
HTML_SEPARATING = ("title", "p", "div", "h1", "h2", "h3", "li", "article", "br", "section")


class Blocks:
    """Collects pieces of text into blocks; pieces are joined by a blank and stripped."""

    def __init__(self):
        self.done: list[str] = []
        self.now = ""

    def add(self, piece: str | None) -> None:
        self.now = f"{self.now} {piece or ''}".strip()

    def cut(self) -> None:
        if self.now:
            self.done.append(self.now)
        self.now = ""

    def result(self) -> list[str]:
        self.cut()
        return [b.replace("\n", " ") for b in self.done]


def _walk(element, into: Blocks) -> None:
    """Head, children and tail of an element; no recursion, so depth doesn't matter."""
    todo: list = [("open", element)]
    while todo:
        what, node = todo.pop()
        if what == "tail":
            into.add(node.tail)
            continue
        if node.tag in IGNORED:
            into.add((node.tail or "").strip())
            continue
        if node.tag in SEPARATING:
            into.cut()
        into.add(node.text)
        todo.append(("tail", node))
        todo.extend(("open", child) for child in reversed(list(node)))


def blocks_of(elements: list) -> list[str]:
    """Blocks of elements; each element ends a block."""
    into = Blocks()
    for element in elements:
        _walk(element, into)
        into.cut()
    return into.result()


class _Loose(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.hidden = Blocks(), []

    def handle_starttag(self, tag, attrs):
        if tag in HTML_IGNORED:
            self.hidden.append(tag)
        elif tag in HTML_SEPARATING:
            self.blocks.cut()

    def handle_endtag(self, tag):
        if self.hidden and tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        elif tag in HTML_SEPARATING:
            self.blocks.cut()

    def handle_data(self, data):
        if not self.hidden:
            self.blocks.add(data.strip())


def html_blocks(source: str | None) -> list[str]:
    """Visible text blocks of HTML that need not be well-formed."""
    parser = _Loose()
    parser.feed(source or "")
    parser.close()
    return parser.blocks.result()


def html_to_blocks(df: DataFrame, column: str, into: str = "blocks") -> DataFrame:
    @F.pandas_udf("array<string>")
    def blocks(source: pd.Series) -> pd.Series:
        return source.map(html_blocks)

    return df.withColumn(into, blocks(F.col(column)))


def _ids(article) -> dict[str, str]:
    """The last id of each kind, and the year of the first date."""
    found = {"pmid": "", "pmc": "", "doi": ""}
    for a in [*article.findall("./front/article-meta/article-id"), *article.findall("./front-stub/article-id")]:
        if a.text and a.get("pub-id-type") in found:
            found[a.get("pub-id-type")] = a.text.strip().replace("\n", " ")
    dates = [*article.findall("./front/article-meta/pub-date"), *article.findall("./front-stub/pub-date")]
    year = dates[0].find("year") if dates else None
    return found | {"year": (year.text or "").strip().replace("\n", " ") if year is not None else ""}


def _in_front(article, path: str) -> list:
    return [*article.findall(f"./front/article-meta/{path}"), *article.findall(f"./front-stub/{path}")]


def article_documents(article, texts: bool = True) -> Iterator[dict]:
    """The article and its direct sub-articles; those without ids or a year take the parent's.  Without ``texts``, only what describes them."""
    own = _ids(article)
    for part in [article, *article.findall("./sub-article")]:
        ids = own if part is article else _ids(part)
        if not (ids["pmid"] or ids["pmc"] or ids["doi"]):
            ids = ids | {k: own[k] for k in ("pmid", "pmc", "doi")}
        ids = ids | {"year": ids["year"] or own["year"]}
        titles = [blocks_of(_in_front(part, f"title-group/{name}")) for name in ("article-title", "subtitle")] if texts else []
        rest = [blocks_of(_in_front(part, "abstract")), *(blocks_of(part.findall(f"./{name}")) for name in ("body", "back", "floats-group"))] if texts else []
        kind = "MAIN" if part is article else "SUB"
        yield ids | {"kind": kind, "lang": part.get("{http://www.w3.org/XML/1998/namespace}lang", "en"), "type": part.get("article-type", ""), "titles": sum(titles, []), "texts": sum(rest, [])}


def citation_record(citation) -> dict:
    """Ids, year fields, title blocks and abstract blocks of a citation."""
    text = lambda path: next((e.text for e in citation.findall(path)), None)
    date = "./Article/Journal/JournalIssue/PubDate"
    pmid = " ".join(e.text.strip() for e in citation.findall("./PMID") if e.text)
    return {"pmid": pmid, "year": text(f"{date}/Year"), "free_date": text(f"{date}/MedlineDate"), "titles": blocks_of(citation.findall("./Article/ArticleTitle")), "texts": blocks_of(citation.findall("./Article/Abstract/AbstractText"))}


def _finish(titles, texts):
    """Titles without old brackets, then texts; entities decoded, word-less brackets dropped."""
    blocks = F.concat(F.transform(titles, T.strip_title_brackets), texts)
    return T.keep_nonempty(blocks)


def _unescaped(df: DataFrame) -> DataFrame:
    at = df.columns.index("blocks")

    def unescape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, RECORDS):  # a batch may hold thousands of whole texts
                some = batch.slice(first, RECORDS)
                made = [[html.unescape(x) for x in xs] for xs in some.column(at).to_pylist()]
                yield some.set_column(at, some.schema.field(at), pa.array(made, some.schema.field(at).type))

    return df.mapInArrow(unescape, df.schema).withColumn("blocks", F.transform("blocks", T.drop_wordless_brackets))


def _in_pieces(records: Iterator[dict], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Records as batches of about ``RECORDS``; titles and texts are lists."""
    kinds = [pa.list_(pa.string()) if c in ("titles", "texts") else pa.string() for c in columns]
    while some := list(itertools.islice(records, RECORDS)):
        yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in some], kind) for c, kind in zip(columns, kinds)], names=columns)


def _parsed(source: str | bytes):
    """The root element and no error, or None and what is wrong with the source."""
    try:
        return ET.fromstring(source), None
    except ET.ParseError as e:
        return None, str(e)


def read_citations(spark: SparkSession, path) -> DataFrame:
    """Citation files -> documents (``schemas.DOCUMENT``), one row for each citation.

    Files are split at the closing tag, so a large file is many records.  A
    malformed citation is a row with nothing but ``error``.
    """
    close = "</MedlineCitation>"
    columns = ["pmid", "year", "free_date", "titles", "texts", "error"]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for text in batch.column(0):
                value = text.as_py()
                at = value.find("<MedlineCitation>")
                at = value.find("<MedlineCitation ") if at < 0 else at
                if at >= 0:
                    root, error = _parsed(value[at:] + close)
                    yield {"titles": [], "texts": [], "error": error} if error else citation_record(root)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_pieces(records(batches), columns)

    parts = spark.read.text(path, lineSep=close).select("value").mapInArrow(parse, "pmid string, year string, free_date string, titles array<string>, texts array<string>, error string")
    out = parts.select(F.col("pmid").alias("doc_id"), "pmid", F.lit("").alias("pmcid"), F.lit("").alias("doi"), T.simple_year(F.col("year"), F.col("free_date")).alias("pub_year"), "year", "free_date", _finish(F.col("titles"), F.col("texts")).alias("blocks"), "error")
    return _unescaped(out)


def read_articles(spark: SparkSession, path, pattern: str = "*.nxml", texts: bool = True) -> DataFrame:
    """Article files -> documents with ``part`` (MAIN or SUB), ``path`` and ``article_type``.

    Files whose name doesn't fit ``pattern`` are left alone; a malformed one is a
    row with nothing but ``path`` and ``error``.  Without ``texts``, there are no
    ``blocks``, and text isn't walked or decoded: summaries need none.
    """

    columns = ["pmid", "pmc", "doi", "year", "kind", "lang", "type", "titles", "texts", "path", "error"]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for where, content in zip(batch.column(0), batch.column(1)):
                root, error = _parsed(content.as_py())
                articles = [] if error else [root] if root.tag == "article" else root.iter("article")
                found = [{"titles": [], "texts": [], "error": error}] if error else (d for article in articles for d in article_documents(article, texts))
                yield from (d | {"path": where.as_py()} for d in found)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_pieces(records(batches), columns)

    schema = "pmid string, pmc string, doi string, year string, kind string, lang string, type string, titles array<string>, texts array<string>, path string, error string"
    parts = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content").mapInArrow(parse, schema)
    out = parts.select(F.coalesce(F.nullif("pmid", F.lit("")), "pmc").alias("doc_id"), "pmid", F.col("pmc").alias("pmcid"), "doi", F.col("year").try_cast("int").alias("pub_year"), _finish(F.col("titles"), F.col("texts")).alias("blocks"), F.col("kind").alias("part"), "path", F.col("type").alias("article_type"), "lang", "error")
    return _unescaped(out) if texts else out.drop("blocks")


def article_summary(articles: DataFrame) -> DataFrame:
    """Summary rows of English articles that have an id (``schemas.ARTICLE_SUMMARY``)."""
    rows = articles.where((F.col("lang") == "en") & ((F.col("pmid") != "") | (F.col("pmcid") != "")))
    return rows.select("pmid", "pmcid", "article_type", F.col("pub_year").cast("string").alias("pub_year"), "path", "part").select(*schemas.ARTICLE_SUMMARY.names)


def without_excluded(citations: DataFrame, excluded: DataFrame) -> DataFrame:
    """Citations whose pmid isn't in ``excluded``."""
    return citations.join(excluded.select("pmid"), "pmid", "left_anti")
