"""Registered queries of sources and sinks: what is written in a format is read again and equals SQL over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import session
from ..functions import text as T
from ..operators.matrix import ids_of
from ..session import new_folder
from ..sources import markup, tables
from ..streaming import incremental
from .catalogue import query, sql
from .fixtures import SPLIT, Graph, table

#: Rows of a file in the queries that roll files over.
MOST_ROWS = 37
_WORDS = r"[\p{L}\p{N}.,]+"


def _pieces(spark, sf) -> DataFrame:
    """(id, a, b, rest): the first five words of a document, the next five, and all others."""
    words = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_WORDS), F.lit(0)).alias("w"))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    return words.select("id", part(1, 5).alias("a"), part(6, 5).alias("b"), part(11, F.greatest(F.size("w"), F.lit(1))).alias("rest"))


_PARTS = f"SELECT doc_id AS id, array_to_string(w[1:5], ' ') AS a, array_to_string(w[6:10], ' ') AS b, array_to_string(w[11:], ' ') AS rest FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents)"


def _xml(*parts: str | Column) -> Column:
    """Markup with columns of words between; no word needs an escape."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _citations(spark, sf) -> DataFrame:
    """Documents written as citations, a fiftieth of them malformed, and read again."""
    c, key = F.col, F.col("id").cast("string")
    date = F.when(c("id") % 3 == 0, _xml("<MedlineDate>", (1990 + c("id") % 9).cast("string"), " Jan-Feb</MedlineDate>")).otherwise(_xml("<Year>", (2000 + c("id") % 9).cast("string"), "</Year>"))
    broken = F.when(c("id") % 50 == 7, "<broken>").otherwise("")
    value = _xml(
        "<MedlineCitation Status='x'><PMID>", key, "</PMID><Article><Journal><JournalIssue><PubDate>", date, "</PubDate></JournalIssue></Journal><ArticleTitle>[", c("a"), "].</ArticleTitle><Abstract>",
        "<AbstractText>", c("a"), " ( ; ) ", c("b"), " <i>mid &amp;gt; x</i> <xref>no</xref> ", c("rest"), "</AbstractText>", broken, "<AbstractText>", c("b"), "<p>", c("a"), "</p>", c("b"), "</AbstractText></Abstract></Article></MedlineCitation>",
    )
    at = new_folder(spark)
    _pieces(spark, sf).select(value.alias("value")).write.text(at)
    return markup.read_citations(spark, at)


_DROPPED = "regexp_replace({0}, '\\([\\W\\s]*\\)', ' ', 'g')"
_CITATIONS = f"""SELECT id, CAST(CASE WHEN id % 3 = 0 THEN 1990 + id % 9 ELSE 2000 + id % 9 END AS INT) AS year,
  list_filter([a || '.', {_DROPPED.format("rtrim(trim(a || ' ( ; ) ' || b) || ' mid > x ' || rest)")}, b, trim(a || ' ' || b)], lambda x: length(x) > 0) AS blocks FROM ({_PARTS}) WHERE id % 50 <> 7"""


@query(f"SELECT CAST(id AS VARCHAR) AS pmid, year AS pub_year, year AS robust_year, CAST(len(blocks) AS INT) AS n_blocks, md5(array_to_string(blocks, '|')) AS blocks FROM ({_CITATIONS}) WHERE id % 10 <> 3")
def citation_files(spark, sf):
    """Well-formed citations but those excluded: ids, both kinds of years, and text blocks."""
    excluded = table(spark, sf, "documents").where("doc_id % 10 = 3").select(F.col("doc_id").cast("string").alias("pmid"))
    found = markup.without_excluded(_citations(spark, sf).where("error is null"), excluded)
    return found.select("pmid", "pub_year", T.robust_year(F.col("year"), F.col("free_date"), 2024).alias("robust_year"), F.size("blocks").alias("n_blocks"), F.md5(F.array_join("blocks", "|").cast("binary")).alias("blocks"))


@query("SELECT count(*) FILTER (doc_id % 50 = 7) AS malformed, count(*) FILTER (doc_id % 50 <> 7) AS whole FROM documents")
def citation_errors(spark, sf):
    """Malformed citations are rows with an error."""
    return _citations(spark, sf).agg(F.count_if(F.col("error").isNotNull() & F.col("pmid").isNull()).alias("malformed"), F.count_if(F.col("error").isNull()).alias("whole"))


def _articles(spark, sf, texts: bool = True) -> DataFrame:
    """Documents written as articles with a sub-article each, a hundred a file, and read again."""
    c, key = F.col, F.col("id").cast("string")
    an_id = lambda kind, when, text: F.when(when, _xml(f"<article-id pub-id-type='{kind}'>", text, "</article-id>")).otherwise("")
    ids = [an_id("pmid", c("id") % 4 != 1, key), an_id("pmc", c("id") % 4 != 0, F.concat(F.lit("PMC"), key)), an_id("doi", c("id") % 4 == 2, F.concat(F.lit("10.1/"), key))]
    own = F.when(c("id") % 5 == 0, _xml("<article-id pub-id-type='pmid'>s", key, "</article-id><pub-date><year>2015</year></pub-date>")).otherwise("")
    value = _xml(
        "<article xml:lang='", F.when(c("id") % 6 == 0, "fr").otherwise("en"), "' article-type='research'><front><article-meta>", *ids, "<title-group><article-title>", c("a"), "</article-title></title-group><pub-date><year>", (2000 + c("id") % 9).cast("string"), "</year></pub-date>",
        "<abstract><p>", c("a"), " <xref>1</xref> ", c("b"), "</p><p>", c("rest"), "</p></abstract></article-meta></front><body><sec><title>Intro</title><p>", c("b"), "<table>no</table>", c("a"), "</p></sec></body><back><ack>thanks</ack><p>", c("a"), "</p></back>",
        "<sub-article article-type='reply'><front-stub>", own, "<title-group><article-title>Reply</article-title></title-group></front-stub><body><p>", c("b"), "</p></body></sub-article></article>",
    )
    files = _pieces(spark, sf).groupBy(F.floor(c("id") / 100).alias("file")).agg(F.concat(F.lit("<articles>"), F.array_join(F.collect_list(value), ""), F.lit("</articles>")).alias("value"))
    at = new_folder(spark)
    files.select("value").write.option("maxRecordsPerFile", 1).text(at)
    return markup.read_articles(spark, at, "part-*", texts)


_ARTICLES = f"""WITH p AS ({_PARTS}), every AS (
  SELECT CASE WHEN id % 4 <> 1 THEN CAST(id AS VARCHAR) ELSE '' END AS pmid, CASE WHEN id % 4 <> 0 THEN 'PMC' || id ELSE '' END AS pmcid, CASE WHEN id % 4 = 2 THEN '10.1/' || id ELSE '' END AS doi,
         CAST(2000 + id % 9 AS INT) AS pub_year, CASE WHEN id % 6 = 0 THEN 'fr' ELSE 'en' END AS lang, * FROM p),
rows AS (
  SELECT pmid, pmcid, doi, pub_year, 'MAIN' AS part, 'research' AS article_type, lang, [a, trim(a || ' ' || b), rest, 'Intro', trim(b || ' ' || a), a] AS blocks FROM every
  UNION ALL SELECT CASE WHEN id % 5 = 0 THEN 's' || id ELSE pmid END, CASE WHEN id % 5 = 0 THEN '' ELSE pmcid END, CASE WHEN id % 5 = 0 THEN '' ELSE doi END, CASE WHEN id % 5 = 0 THEN 2015 ELSE pub_year END, 'SUB', 'reply', 'en', ['Reply', b] FROM every)
"""


@query(_ARTICLES + "SELECT coalesce(nullif(pmid, ''), pmcid) AS doc_id, pmid, pmcid, doi, pub_year, part, article_type, lang, md5(array_to_string(list_filter(blocks, lambda x: length(x) > 0), '|')) AS blocks FROM rows")
def article_files(spark, sf):
    """Articles and sub-articles: ids and years, inherited where missing, and text blocks."""
    return _articles(spark, sf).select("doc_id", "pmid", "pmcid", "doi", "pub_year", "part", "article_type", "lang", F.md5(F.array_join("blocks", "|").cast("binary")).alias("blocks"))


@query(_ARTICLES + "SELECT pmid, pmcid, article_type, CAST(pub_year AS VARCHAR) AS pub_year, part FROM rows WHERE lang = 'en'")
def article_summaries(spark, sf):
    return markup.article_summary(_articles(spark, sf, texts=False)).drop("path")


def _rolled(rows: str) -> str:
    """SQL of the files that rows (year) fill one after the other."""
    return f"SELECT year, CAST(file AS INT) AS file, least({MOST_ROWS}, n - {MOST_ROWS} * file) AS n FROM (SELECT year, count(*) AS n, unnest(range((count(*) + {MOST_ROWS - 1}) // {MOST_ROWS})) AS file FROM ({rows}) GROUP BY year)"


@query(_ARTICLES + _rolled("SELECT pub_year AS year FROM rows WHERE lang = 'en' AND part = 'MAIN'"))
def article_path_lists(spark, sf):
    """Paths of main articles by year, so many a file."""
    at = new_folder(spark)
    tables.article_lists(markup.article_summary(_articles(spark, sf, texts=False)), at, MOST_ROWS)
    return spark.read.parquet(at).groupBy("year", "file").agg(F.count(F.lit(1)).alias("n"))


@query(_rolled("SELECT CAST(1995 + doc_id % 7 AS INT) AS year FROM documents"))
def rolling_files(spark, sf):
    """Documents by year in files of exactly so many rows, the last of a year excepted."""
    at = new_folder(spark)
    tables.write_rolling(table(spark, sf, "documents").withColumn("year", (1995 + F.col("doc_id") % 7).cast("int")), at, MOST_ROWS)
    return spark.read.parquet(at).groupBy("year", "file").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year FROM orders")
def partition_years(spark, sf):
    """Years that a table's folders name."""
    at = new_folder(spark)
    tables.by_year(table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))).write.partitionBy("year").parquet(at)
    return spark.createDataFrame([(y,) for y in tables.years_of(spark, at)], "year int")


@query("SELECT p_brand AS \"group\", 'n' || p_size AS name, p_type AS type_id, p_name AS type_name FROM part")
def group_files(spark, sf):
    """Semantic groups between bars."""
    at = new_folder(spark)
    table(spark, sf, "part").select(F.concat_ws("|", "p_brand", F.concat(F.lit("n"), "p_size"), "p_type", "p_name").alias("value")).write.text(at)
    return tables.read_semantic_groups(spark, at)


@query("SELECT vec_id AS x, CAST(i AS INT) AS \"column\", CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, range(64) AS r(i) WHERE i < len(embedding)")
def vector_dump(spark, sf):
    rows = tables.dump_vectors(table(spark, sf, "embeddings").select(F.col("vec_id").alias("x"), F.col("embedding").alias("vec")))
    return rows.select("x", "column", F.col("value").cast("double").alias("value"))


@query("SELECT vec_id AS x, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS vec FROM embeddings")
def float_matrix_files(spark, sf):
    """Vectors written as raw rows of a matrix beside their index, and read by position."""
    at = new_folder(spark)
    tables.write_matrix_parts(table(spark, sf, "embeddings").select(F.col("vec_id").alias("x"), F.col("embedding").alias("vec")), at)
    return tables.read_matrix_parts(spark, at).select("x", F.col("vec").cast("array<double>").alias("vec"))


@query(sql("SELECT 'new' AS what, year, x, y, n FROM val UNION ALL SELECT 'occurrence', year, x, NULL, n FROM occ UNION ALL SELECT 'sentences', CAST(year(o_orderdate) AS INT), NULL, NULL, count(*) FROM orders GROUP BY ALL", "val", "occ"))
def streamed_counts(spark, sf):
    """Mentions as a stream of three batches of files, more files for more rows: pairs first seen in the validation year, and counts of concepts and sentences."""
    g = Graph(spark, sf)
    units = g.orders.select(F.col("o_orderkey").alias("unit"), "year")
    mentions = units.join(g.mentions.select("unit", "t"), "unit", "left").select("unit", "year", "t")
    at, out = new_folder(spark), new_folder(spark)
    files = -(-g.rows // (3 * session.ROWS))
    mentions.repartition(3 * files, "unit").write.parquet(at)
    stream = spark.readStream.schema(mentions.schema).option("maxFilesPerTrigger", files).parquet(at)
    incremental.mine_stream(stream, out, new_folder(spark)).awaitTermination()
    incremental.track_stream(spark, out, new_folder(spark)).awaitTermination()
    known = ids_of(incremental.current(spark, out).where(F.col("year") < SPLIT))
    none = F.lit(None).cast("long")
    found = incremental.holdout(spark, out, known, SPLIT).select(F.lit("new").alias("what"), "year", "x", "y", "n")
    found = found.unionByName(incremental.current(spark, out, incremental.CONCEPTS).select(F.lit("occurrence").alias("what"), "year", "x", none.alias("y"), "n"))
    return found.unionByName(incremental.current(spark, out, incremental.UNITS).select(F.lit("sentences").alias("what"), "year", none.alias("x"), none.alias("y"), "n"))
