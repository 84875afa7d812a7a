"""Neighbourhood scores of candidate pairs.

Sums over shared neighbours come from tiles (see ``neighbours``); a method asks for
the sums it needs only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled
from .matrix import mirror
from .neighbours import APART, LEAST, LINKS, PRODUCT, shared_sums

#: Scores in the order of the wide table.
METHODS = ("factaplus", "bitola", "arrowsmith", "jaccard", "prefattach", "amw", "ltc_amw")
#: Names for figures (fixed values).
TITLES = {"anni": "ANNI", "prefattach": "Preferential Attachment", "factaplus": "FACTA+", "jaccard": "Jaccard", "arrowsmith": "Arrowsmith", "bitola": "BITOLA", "amw": "AMW", "ltc_amw": "LTC-AMW"}
MOST_AMW = 1000
#: Pairs from which those with degrees are written before they meet their sums.
LARGE = 1 << 22


def degrees(adjacency: DataFrame) -> DataFrame:
    """(x, degree) of a mirrored matrix of distinct pairs."""
    return adjacency.groupBy("x").agg(F.count(F.lit(1)).alias("degree"))


def with_degrees(candidates: DataFrame, degree: DataFrame) -> DataFrame:
    """``candidates`` with the degrees dx and dy of their ends, 0 if unknown."""
    out = candidates.join(degree.select("x", F.col("degree").alias("dx")), "x", "left").join(degree.select(F.col("x").alias("y"), F.col("degree").alias("dy")), "y", "left")
    return out.withColumns({"dx": F.coalesce("dx", F.lit(0)), "dy": F.coalesce("dy", F.lit(0))})


def score_all(candidates: DataFrame, cooccurrence: DataFrame, occurrence: DataFrame | None, methods: tuple[str, ...] = METHODS, at_rest: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(x, y) distinct candidates -> x, y, what is to ``keep`` and the scores of ``methods``.

    Pairs without a linking term get the scores of an empty set.  A missing
    occurrence counts as no association; AMW of 1000 or more is an error, as
    LTC-AMW would no longer sort by linking terms.  Occurrences matter to FACTA+
    only, counts of pairs to it, BITOLA and AMW, degrees to Jaccard and preferential
    attachment.  ``at_rest``: candidates and co-occurrences are, and candidates are
    distinct; no copies are written then.
    """
    pairs = candidates.select("x", "y", *keep) if at_rest else settled(candidates.select("x", "y", *keep).distinct())
    cooccurrence = cooccurrence.select("x", "y", "n")
    asked = {"factaplus": (APART,), "bitola": (PRODUCT,), "arrowsmith": (LINKS,), "jaccard": (LINKS,), "prefattach": (), "amw": (LINKS, LEAST), "ltc_amw": (LINKS, LEAST)}
    sums = tuple(s for s in (LINKS, PRODUCT, LEAST, APART) if any(s in asked[m] for m in methods))
    if APART in sums:
        joined = cooccurrence.select("x", "y", "n").join(occurrence.select("x", F.col("n").alias("ox")), "x", "left").join(occurrence.select(F.col("x").alias("y"), F.col("n").alias("oy")), "y", "left")
        cooccurrence = settled(joined.select("x", "y", "n", F.coalesce(F.try_divide(F.col("n").cast("double"), F.least("ox", "oy")), F.lit(0.0)).alias("d")))
    elif not at_rest:
        cooccurrence = settled(cooccurrence.select("x", "y", "n"))
    adjacency = mirror(cooccurrence)  # one orientation at rest
    out = with_degrees(pairs, degrees(adjacency)).select("x", "y", *keep, "dx", "dy") if {"jaccard", "prefattach"} & set(methods) else pairs
    if sums:
        if out is not pairs and pairs.count() > LARGE:
            out = settled(out)
        out = out.join(shared_sums(pairs.select("x", "y"), adjacency, sums), ["x", "y"], "left")
    if LINKS not in sums:
        out = out.withColumn(LINKS, F.lit(0))
    links = F.coalesce(LINKS, F.lit(0))
    if {"amw", "ltc_amw"} & set(methods):
        amw = F.when(links > 0, F.col(LEAST) / links).otherwise(0.0)
        out = out.withColumn("_amw", F.when(amw < MOST_AMW, amw).otherwise(F.raise_error(F.lit("AMW must be below 1000 for LTC-AMW")).cast("double")))
    every = {
        "factaplus": lambda: 1 - F.coalesce(APART, F.lit(1.0)),
        "bitola": lambda: F.coalesce(PRODUCT, F.lit(0)).cast("long"),
        "arrowsmith": lambda: links.cast("long"),
        "jaccard": lambda: F.when(F.col("dx") + F.col("dy") - links > 0, links / (F.col("dx") + F.col("dy") - links)).otherwise(0.0),
        "prefattach": lambda: (F.col("dx") + F.col("dy")).cast("long"),
        "amw": lambda: F.col("_amw"),
        "ltc_amw": lambda: links + 0.001 * F.col("_amw"),
    }
    return out.select("x", "y", *keep, *(every[m]().alias(m) for m in METHODS if m in methods))


def score(candidates: DataFrame, cooccurrence: DataFrame, occurrence: DataFrame | None, method: str, at_rest: bool = False) -> DataFrame:
    """(x, y, score) by one method."""
    return score_all(candidates, cooccurrence, occurrence, (method,), at_rest).select("x", "y", F.col(method).alias("score"))


def melt(scores: DataFrame, methods: tuple[str, ...] = METHODS, keep: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Wide scores -> (keep, method, score double)."""
    wide = scores.select(*keep, *(F.col(m).cast("double").alias(m) for m in methods))
    return wide.unpivot(list(keep), list(methods), "method", "score")


def title(method: str = "method"):
    """Display name of a method; anything with SVD in it is SVD."""
    named = F.create_map(*(F.lit(x) for pair in TITLES.items() for x in pair))
    return F.when(F.col(method).contains("SVD") | F.col(method).startswith("svd"), "SVD").otherwise(F.coalesce(F.try_element_at(named, F.col(method)), F.col(method)))


def shared_links(x: int, y: int, cooccurrence: DataFrame) -> DataFrame:
    """(link, n_x, n_y): linking terms of two concepts with their counts."""
    near = lambda v, name: cooccurrence.where((F.col("x") == v) | (F.col("y") == v)).select(F.when(F.col("x") == v, F.col("y")).otherwise(F.col("x")).alias("link"), F.col("n").alias(name))
    return near(x, "n_x").join(near(y, "n_y"), "link")
