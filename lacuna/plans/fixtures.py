"""The driver's tables as the library's entities.

A sentence is an order, a concept a part, the year that of the order, a
document a customer's year; vectors and factors come from embeddings, classes
from document labels, word-lists from parts, text from documents and pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dataset, mine
from ..operators.matrix import ids_of
from ..session import dealt, settled

SPLIT = 1998
#: Rows of the sampling queries; scoring queries take every test pair and as many negatives.
SAMPLE = 1000
K = 32
#: Factors trained on the graph.
GRAPH_K = 16
SIGMA = [1.0 / (i + 1) for i in range(K)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Graph:
    """The concept graph of one input folder; each part is a lazy DataFrame.

    ``at_rest`` writes each part when it is first asked for, as queries of
    several stages read them many times.  ``one_split``: nothing but the split at
    ``SPLIT`` is asked for, so pairs are summed for it at once and those of each
    year are not written; test pairs come without their counts.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, at_rest: bool = False, one_split: bool = False):
        self.orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
        items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
        self.rows = rows = items.count()  # from the files' footers
        joined = dealt(items, rows, "l_orderkey").join(dealt(self.orders, rows, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        self.mentions = joined.select(F.col("l_orderkey").alias("unit"), "year", F.col("l_partkey").alias("t"))
        self.by_document = joined.select(F.concat_ws("-", F.col("o_custkey").cast("string"), F.col("year").cast("string")).alias("unit"), "year", F.col("l_partkey").alias("t"))
        self.sentences = mine.unit_counts(self.orders)
        self.at_rest, self.one_split = at_rest or one_split, one_split
        self.done: dict = {}

    @property
    def cooccurrence(self) -> DataFrame:
        return self.once("cooccurrence", 0, lambda: mine.cooccurrences(self.mentions), "year")

    @property
    def occurrence(self) -> DataFrame:
        return self.once("occurrence", 0, lambda: mine.occurrences(self.mentions), "year")

    def once(self, name: str, year: int, make, *partition_by: str) -> DataFrame:
        """A part of the graph; at rest, it is written when first asked for."""
        if not self.at_rest:
            return make()
        if (name, year) not in self.done:
            self.done[name, year] = settled(make(), *partition_by)  # sums come dealt by all their keys, so many tasks write a year
        return self.done[name, year]

    def split_pairs(self) -> DataFrame:
        """(x, y, n, first_year) in order, as sorted ids take the least room."""
        return self.once("pairs", SPLIT, lambda: mine.pairs_of_split(self.mentions, SPLIT).sortWithinPartitions("first_year", "x", "y"), "first_year")

    def known(self, last: int = SPLIT) -> DataFrame:
        if self.one_split:
            return self.split_pairs().where(F.col("first_year") <= SPLIT).select("x", "y", "n")
        return self.once("known", last, lambda: dataset.known_pairs(self.cooccurrence, last))

    def ids(self, last: int = SPLIT) -> DataFrame:
        return self.once("ids", last, lambda: ids_of(self.known(last) if self.at_rest else self.cooccurrence.where(F.col("year") <= last)))

    def counts(self, last: int = SPLIT) -> DataFrame:
        return self.once("counts", last, lambda: dataset.known_occurrences(self.occurrence, self.ids(last), last))

    def sentence_total(self, last: int = SPLIT) -> int:
        return dataset.known_sentences(self.sentences, last).first()["n"]

    def validation(self) -> DataFrame:
        return dataset.holdout(self.cooccurrence, self.ids(SPLIT - 1), SPLIT)

    def testing(self) -> DataFrame:
        if self.one_split:
            return self.once("testing", SPLIT, lambda: dataset.both_accepted(self.split_pairs().where(F.col("first_year") > SPLIT), self.ids()).select(F.col("first_year").alias("year"), "x", "y"))
        return self.once("testing", SPLIT, lambda: dataset.holdout(self.cooccurrence, self.ids(), SPLIT, later=True))

    def positives(self) -> DataFrame:
        return dataset.draw(self.testing(), SAMPLE)

    def truth(self) -> DataFrame:
        return self.known().select("x", "y").unionByName(self.testing().select("x", "y"))

    def negatives(self, size: int = SAMPLE) -> DataFrame:
        return dataset.negatives(self.ids(), self.truth(), size, exact=self.at_rest)

    def sampled_candidates(self) -> DataFrame:
        return dataset.labelled(self.positives(), self.negatives())

    def candidates(self) -> DataFrame:
        """Every test pair and as many negatives (all there are, if fewer)."""
        return self.once("candidates", SPLIT, lambda: dataset.labelled(self.testing(), self.negatives(self.testing().count())))

    def validation_candidates(self) -> DataFrame:
        """Every pair of the validation year and as many negatives, of what was known before it."""
        pairs = self.once("validation", SPLIT, self.validation)
        truth = self.known(SPLIT - 1).select("x", "y").unionByName(pairs.select("x", "y"))
        return self.once("validation_candidates", SPLIT, lambda: dataset.labelled(pairs, dataset.negatives(self.ids(SPLIT - 1), truth, pairs.count(), exact=self.at_rest)))


class Factors:
    """Factors and pairs made of embeddings: U is the first half of a vector, V the second."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        rows = table(spark, sf_dir, "embeddings")
        double = F.col("embedding").cast("array<double>")
        self.ids = rows.select(F.col("vec_id").alias("x"))
        self.u = rows.select(F.col("vec_id").alias("x"), F.slice(double, 1, K).alias("f"))
        self.v = rows.select(F.col("vec_id").alias("x"), F.slice(double, K + 1, K).alias("f"))
        self.neighbours = rows.select(F.col("vec_id").alias("x"), (F.col("vec_id") + 1).alias("y"))
        self.of_label = lambda n: rows.where(F.col("label") == n).select(F.col("vec_id").alias("x"))


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, method, score, class): two labels predicted by the length of the document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").unpivot("doc_id", ["quality", "toxic"], "method", "class")
    return labels.join(docs, "doc_id")
