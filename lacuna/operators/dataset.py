"""Splits of a year-stamped co-occurrence table, holdouts, negatives and checks."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled
from .matrix import canonical, ids_of, merge_counts, merge_pairs, merge_scalars

#: Negatives: draws for each pair wanted, and the multiple of these below which all pairs are listed.
DRAWS, DENSE = 4, 2
#: Draws that are joined with the ids at once.
DRAWN = 1 << 24


def known_pairs(cooccurrence: DataFrame, last_year: int) -> DataFrame:
    """(x, y, n) up to and with ``last_year``."""
    return merge_pairs(cooccurrence.where(F.col("year") <= last_year))


def known_occurrences(occurrence: DataFrame, ids: DataFrame, last_year: int) -> DataFrame:
    """(x, n) up to ``last_year`` of accepted ids."""
    return merge_counts(occurrence.where(F.col("year") <= last_year)).join(ids, "x", "left_semi")


def known_sentences(sentences: DataFrame, last_year: int) -> DataFrame:
    return merge_scalars(sentences.where(F.col("year") <= last_year))


def both_accepted(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """Pairs with both ends among ``ids``; ids are a vocabulary, left to adaptive joins."""
    other = ids.select(F.col("x").alias("y"))
    return pairs.join(ids, "x", "left_semi").join(other, "y", "left_semi")


def unknown_pairs(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs that ``known`` has in neither orientation."""
    keys = canonical(known.select("x", "y"))
    return pairs.withColumns({"_a": F.least("x", "y"), "_b": F.greatest("x", "y")}).join(keys.select(F.col("x").alias("_a"), F.col("y").alias("_b")), ["_a", "_b"], "left_anti").drop("_a", "_b")


def first_seen(cooccurrence: DataFrame) -> DataFrame:
    """(x, y, first_year, n): each pair's first year and its count in that year."""
    return cooccurrence.groupBy("x", "y").agg(F.min("year").alias("first_year"), F.min_by("n", "year").alias("n"))


def holdout(cooccurrence: DataFrame, ids: DataFrame, year: int, later: bool = False) -> DataFrame:
    """(year, x, y, n): accepted pairs first seen in ``year`` (``later``: after it).

    A tracking set that grows year by year holds a pair exactly from its first
    year on, so one aggregation replaces the loop over years.
    """
    seen = first_seen(cooccurrence)
    chosen = seen.where(F.col("first_year") > year if later else F.col("first_year") == year)
    return both_accepted(chosen, ids).select(F.col("first_year").alias("year"), "x", "y", "n")


def _order(seed: str, keys: tuple[str, ...] = ("x", "y")) -> Column:
    return F.md5(F.concat_ws("_", *(F.col(k).cast("string") for k in keys), F.lit(seed)))


def draw(df: DataFrame, size: int, seed: str = "draw", keys: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """``size`` rows without replacement, in the order of md5(keys and seed).

    A histogram of the first four digits tells up to where rows are taken whole;
    only rows of the digits on the cut are sorted.  ``df`` is read three times:
    settle what isn't cheap.
    """
    ordered = df.withColumn("_order", _order(seed, keys)).withColumn("_bin", F.substring("_order", 1, 4))
    ahead = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)  # 65,536 bins at most
    bins = ordered.groupBy("_bin").count().withColumn("_sum", F.sum("count").over(ahead))
    cut = bins.where(F.col("_sum") >= size).orderBy("_bin").first()
    if cut is None:
        return ordered.select(*df.columns)
    rest = size - (cut["_sum"] - cut["count"])
    last = ordered.where(F.col("_bin") == cut["_bin"]).orderBy("_order", *keys).limit(rest)
    return ordered.where(F.col("_bin") < cut["_bin"]).select(*df.columns).unionByName(last.select(*df.columns))


def _first_share(tries: int, size: int, count: int, possible: int) -> float:
    """Share of the md5 order that holds ``size`` of the pairs that so many tries give, with room to spare."""
    every = count * (count - 1) / 2
    expected = possible * -math.expm1(-tries * (1 - 1 / count) / every)
    return (1.05 * size + 10 * math.sqrt(size) + 100) / max(expected, 1.0)


def negatives(ids: DataFrame, truth: DataFrame, size: int, seed: str = "negative", exact: bool = False) -> DataFrame:
    """``size`` distinct pairs x < y of ids that aren't true (all there are, if fewer), as (x, y, n = 0).

    Seeded uniform draws of two ranks are repeated until there are enough.  Where
    most of what could be drawn is wanted, all pairs are listed instead; they
    are then fewer than true pairs and twice ``size`` together.  As the first in md5
    order are taken, only a share of that order is looked at, and all of it if that
    holds too few.  ``exact``: ``truth`` is at rest and holds distinct pairs x < y
    of ids.
    """
    ranked = settled(ids.select("x", (F.row_number().over(Window.orderBy("x")) - 1).cast("long").alias("_r")))  # a vocabulary, not data
    true_pairs = truth.select("x", "y") if exact else settled(both_accepted(canonical(truth.select("x", "y")), ids).where("x < y").distinct())
    count, known = ranked.count(), true_pairs.count()
    possible = count * (count - 1) // 2 - known
    size = min(size, possible)
    one, two = ranked.select(F.col("_r").alias("_a"), F.col("x").alias("p")), ranked.select(F.col("_r").alias("_b"), F.col("x").alias("q"))
    pair = [F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")]
    zero = F.lit(0).cast("long").alias("n")
    if possible < DENSE * size:
        listed = one.where(F.col("_a") < count - 1).withColumn("_b", F.explode(F.sequence(F.col("_a") + 1, F.lit(count - 1).cast("long")))).join(two, "_b")
        return draw(settled(listed.select(*pair).join(true_pairs, ["x", "y"], "left_anti")), size, seed).select("x", "y", zero)
    rank = lambda side: F.conv(F.substring(F.md5(F.concat_ws("_", F.col("id").cast("string"), F.lit(side), F.lit(seed))), 1, 8), 16, 10).cast("long") % max(1, count)

    def drawn(first: int, last: int, share: float) -> DataFrame:
        trial = ids.sparkSession.range(first, last).select(rank("a").alias("_a"), rank("b").alias("_b")).where("_a <> _b").join(one, "_a").join(two, "_b").select(*pair)
        return trial if share >= 1 else trial.where(_order(seed) < f"{int(share * 16**8):08x}")

    def fresh(first: int, last: int, share: float) -> DataFrame:
        if last - first <= DRAWN:
            some = drawn(first, last, share)
        else:  # the joins of one part at a time are on disk
            some = reduce(DataFrame.unionByName, [settled(drawn(at, min(at + DRAWN, last), share)) for at in range(first, last, DRAWN)])
        return some.distinct().join(true_pairs, ["x", "y"], "left_anti")

    tries = DRAWS * size
    share = _first_share(tries, size, count, possible) if size else 1.0
    found = settled(fresh(0, tries, share))
    if share < 1 and found.count() < size:
        found = settled(fresh(0, tries, 1.0))
    while found.count() < size:
        first, tries = tries, 2 * tries
        found = settled(found.unionByName(fresh(first, tries, 1.0)).distinct())
    return draw(found, size, seed).select("x", "y", zero)


def labelled(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """(x, y, class) of positives (1) and negatives (0)."""
    return positive.select("x", "y", F.lit(1).alias("class")).unionByName(negative.select("x", "y", F.lit(0).alias("class")))


def class_balance(ids: DataFrame, known: DataFrame, test: DataFrame) -> DataFrame:
    """One row: terms, known, test and test / (terms (terms + 1) / 2 - known)."""
    counts = [df.agg(F.count(F.lit(1)).alias(name)) for df, name in ((ids, "terms"), (known, "known"), (test, "test"))]
    row = counts[0].join(counts[1]).join(counts[2])  # one row each
    return row.withColumn("class_balance", F.col("test") / (F.col("terms") * (F.col("terms") + 1) / 2 - F.col("known")))


def check_occurrences(occurrence: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows that break the filter: ids not accepted (should be none)."""
    return occurrence.join(ids, "x", "left_anti")


def check_cooccurrences(pairs: DataFrame, ids: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows that break the filter: an end not accepted, or known before in this orientation."""
    other = ids.select(F.col("x").alias("y"))
    bad = pairs.join(ids, "x", "left_anti").select("x", "y").unionByName(pairs.join(other, "y", "left_anti").select("x", "y"))
    return bad.unionByName(pairs.join(previous.select("x", "y"), ["x", "y"], "left_semi").select("x", "y")).distinct()


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (repeats counted) that only one of two tables has, with ``side`` a or b."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))
