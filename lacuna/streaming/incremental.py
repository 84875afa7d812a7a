"""Counts and first years kept up to date from a stream of mentions.

The batch pipeline reads years one after another; a stream of mention files is
the same thing without an end.  Each micro-batch is mined like a batch, and its
counts of pairs, concepts and units are written as partitions named by its number,
so a repeated batch replaces itself; the current counts are the sums over
partitions.  Units (one sentence or document) must arrive whole within a file; one
without concepts is a row with a null ``t``.

A second stream reads the pairs as they are mined and keeps each pair's first year
as state: a batch touches its own pairs only, and writes those whose first year is
new or has become earlier.  A year's holdout then needs the tracked pairs and the
counts of that year alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import mine
from ..operators.dataset import both_accepted

PAIRS, CONCEPTS, UNITS, FIRST = "cooccurrence", "occurrence", "sentences", "first"
#: Keys of the kinds of counts.
KEYS = {PAIRS: ("year", "x", "y"), CONCEPTS: ("year", "x"), UNITS: ("year",)}
_SCHEMAS = {PAIRS: "x long, y long, n long, batch long, year int", CONCEPTS: "x long, n long, batch long, year int", UNITS: "n long, batch long, year int", FIRST: "x long, y long, first_year int, batch long"}


def mine_stream(mentions: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Starts mining a stream (unit, year, t) into ``out``; takes what is there, then stops."""

    def write(batch: DataFrame, number: int) -> None:
        named = batch.where("t is not null")
        counts = {PAIRS: mine.cooccurrences(named), CONCEPTS: mine.occurrences(named), UNITS: mine.unit_counts(batch.select("unit", "year").distinct())}
        for kind, df in counts.items():
            df.write.mode("overwrite").partitionBy("year").parquet(f"{out}/{kind}/batch={number}")

    return mentions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def track_stream(spark: SparkSession, out: str, checkpoint: str) -> StreamingQuery:
    """Starts tracking first years of the pairs mined into ``out``; takes what is there, then stops."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{FIRST}/batch={number}")

    pairs = spark.readStream.schema(_SCHEMAS[PAIRS]).parquet(f"{out}/{PAIRS}")
    first = pairs.groupBy("x", "y").agg(F.min("year").alias("first_year"))
    return first.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _table(spark: SparkSession, out: str, kind: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[kind]).option("basePath", f"{out}/{kind}").parquet(f"{out}/{kind}")


def current(spark: SparkSession, out: str, kind: str = PAIRS) -> DataFrame:
    """Counts of a kind, by its keys, over all batches so far."""
    return _table(spark, out, kind).groupBy(*KEYS[kind]).agg(F.sum("n").alias("n"))


def tracked(spark: SparkSession, out: str) -> DataFrame:
    """(x, y, first_year) of every pair so far."""
    return _table(spark, out, FIRST).groupBy("x", "y").agg(F.min("first_year").alias("first_year"))


def holdout(spark: SparkSession, out: str, ids: DataFrame, year: int) -> DataFrame:
    """(year, x, y, n): accepted pairs first seen in ``year``; of the counts, only that year's partitions are read."""
    new = tracked(spark, out).where(F.col("first_year") == year).select("x", "y")
    counts = _table(spark, out, PAIRS).where(F.col("year") == year).groupBy("year", "x", "y").agg(F.sum("n").alias("n"))
    return both_accepted(counts.join(new, ["x", "y"]), ids).select("year", "x", "y", "n")
