"""Co-occurrence, occurrence and sentence counts of mentioned concepts.

A mention is (unit, year, t): concept ``t`` in a sentence or document.  Pairs
come from each unit's sorted set of concepts by array functions: one shuffle on
the unit, no self join; the sums combine before theirs.  Sets mined from texts can
hold hundreds of concepts each; their pairs are summed in numpy, many sets at once,
and never are rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import settled
from . import vocab
from .matrix import merge_counts, merge_pairs

#: Entries of sets that are counted at once, concepts that meet in a dense matrix, sets and pairs of a step.
ENTRIES, COMMON, SETS, STEP = 1 << 23, 4096, 1024, 1 << 22
#: A set goes through the dense matrix if it has more than 1/sqrt(DENSER) of the common concepts.
DENSER = 500
#: Shares of a year's sets.
WAYS = 8


def distinct_mentions(mentions: DataFrame) -> DataFrame:
    return mentions.select("unit", "year", "t").distinct()


def pairs_of_sets(units: DataFrame, terms: str = "terms") -> DataFrame:
    """(year, terms sorted distinct array) -> one row (year, x, y, 1) for each pair x < y."""
    at = F.posexplode(terms).alias("_i", "x")
    later = F.explode(F.slice(F.col(terms), F.col("_i") + 2, F.size(terms))).alias("y")
    return units.where(F.size(terms) > 1).select("year", terms, at).where(F.col("_i") + 1 < F.size(terms)).select("year", "x", later, F.lit(1).cast("long").alias("n"))


def counted(terms: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, n) of pairs x < y in sets given one after the other; a pair may come several times, its n add up.

    Concepts are ordered by how many sets hold them.  Pairs of common ones are added
    up in a dense matrix, by a product for large sets and one by one for others; a
    rarer one meets all that come before it in its set.
    """
    names, at, often = np.unique(terms, return_inverse=True, return_counts=True)
    order = np.argsort(-often, kind="stable")
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    names, common = names[order], min(COMMON, len(names))
    row = np.repeat(np.arange(len(lengths)), lengths)
    by_row = np.lexsort((rank[at], row))
    rank = rank[at][by_row]
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(rank)) - starts[row]
    large = np.bincount(row, rank < common, len(lengths)) ** 2 * DENSER > common**2
    sums = np.zeros((common, common), np.float32)  # counts below ENTRIES are exact
    kept = np.flatnonzero(large[row] & (rank < common))
    dense_row = (np.cumsum(large) - 1)[row[kept]]
    cuts = np.searchsorted(dense_row, np.arange(0, int(large.sum()) + SETS, SETS))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        cells = np.zeros((SETS, common), np.float32)
        cells[dense_row[a:b] - k * SETS, rank[kept[a:b]]] = 1
        sums += cells.T @ cells
    later = np.flatnonzero((place > 0) & ((rank >= common) | ~large[row]))
    steps = np.cumsum(place[later]) // STEP
    for part in np.split(later, np.flatnonzero(np.diff(steps)) + 1):
        size = place[part]
        one = np.repeat(rank[part], size)
        two = rank[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[row[part]], size)]
        both = one < common
        if both.any():
            found, n = np.unique(two[both] * common + one[both], return_counts=True)
            sums.ravel()[found] += n
        if not both.all():
            found, n = np.unique(two[~both] * len(names) + one[~both], return_counts=True)
            yield *_ends(names, found // len(names), found % len(names)), n
    i, j = np.nonzero(np.triu(sums, 1))
    yield *_ends(names, i, j), sums[i, j].astype(np.int64)


def _ends(names: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(names[i], names[j]), np.maximum(names[i], names[j])


def pair_sums(units: DataFrame, terms: str = "terms") -> DataFrame:
    """(year, distinct array) -> (year, x, y, n), as ``pairs_of_sets`` with sums of many sets; what is left to add comes from different tasks."""

    def run(batches):
        held: dict = {}

        def made(year):
            sets = held.pop(year)
            for x, y, n in counted(np.concatenate([t for t, _ in sets]), np.concatenate([k for _, k in sets])):
                for at in range(0, len(x), STEP):
                    some = [pa.array(v[at : at + STEP], pa.int64()) for v in (x, y, n)]
                    yield pa.RecordBatch.from_arrays([pa.array([year], pa.int32()).take(pa.array(np.zeros(len(some[0]), np.int32))), *some], names=["year", "x", "y", "n"])

        for batch in batches:
            years = batch.column(0)
            for year in years.unique().to_pylist():
                mask = np.array([v == year for v in years.to_pylist()])
                lists = batch.column(1).filter(pa.array(mask))
                held.setdefault(year, []).append((lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))
                if sum(len(t) for t, _ in held[year]) >= ENTRIES:
                    yield from made(year)
        for year in list(held):
            yield from made(year)

    dealt = units.where(F.size(terms) > 1).select(F.col("year").cast("int").alias("year"), F.col(terms).cast("array<bigint>").alias(terms))
    dealt = dealt.repartition("year", F.pmod(F.xxhash64(terms), F.lit(WAYS)))
    return merge_pairs(dealt.mapInArrow(run, "year int, x long, y long, n long"), "year")


def cooccurrences(mentions: DataFrame) -> DataFrame:
    """(year, x, y, n): number of units with both concepts, x < y."""
    sets = mentions.groupBy("unit", "year").agg(F.array_sort(F.collect_set("t")).alias("terms"))
    return merge_pairs(pairs_of_sets(sets), "year")


def pairs_of_split(mentions: DataFrame, last_year: int) -> DataFrame:
    """(x, y, n, first_year): units with both concepts up to and with ``last_year`` (0 if none), and the first year of any; one shuffle of pairs."""
    sets = mentions.groupBy("unit", "year").agg(F.array_sort(F.collect_set("t")).alias("terms"))
    known = F.when(F.col("year") <= last_year, F.col("n")).otherwise(0)
    return pairs_of_sets(sets).groupBy("x", "y").agg(F.sum(known).alias("n"), F.min("year").alias("first_year"))


def occurrences(mentions: DataFrame) -> DataFrame:
    """(year, x, n): number of units with the concept."""
    return merge_counts(distinct_mentions(mentions).select("year", F.col("t").alias("x"), F.lit(1).alias("n")), "year")


def unit_counts(units: DataFrame) -> DataFrame:
    """(year, n) over all units, those without concepts too."""
    return units.groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def mined_records(tagged: DataFrame) -> DataFrame:
    """Tagged sentences (year, n_sentences, term_sets) -> records (kind, year, x, y, n).

    ``term_sets`` holds the sorted distinct concept ids of each sentence.
    """
    sets = tagged.select("year", F.explode("term_sets").alias("terms"))
    pairs = pairs_of_sets(sets).select(F.lit("COOCCURRENCE").alias("kind"), "year", "x", "y", "n")
    single = sets.select("year", F.explode("terms").alias("x")).select(F.lit("OCCURRENCE").alias("kind"), "year", "x", F.lit(None).cast("long").alias("y"), F.lit(1).cast("long").alias("n"))
    counts = tagged.select(F.lit("SENTENCECOUNT").alias("kind"), "year", F.lit(None).cast("long").alias("x"), F.lit(None).cast("long").alias("y"), F.col("n_sentences").cast("long").alias("n"))
    return pairs.unionByName(single).unionByName(counts)


def split_records(records: DataFrame) -> dict[str, DataFrame]:
    """Records by kind, each with its own columns."""
    kinds = {"COOCCURRENCE": ["x", "y", "n"], "OCCURRENCE": ["x", "n"], "SENTENCECOUNT": ["n"]}
    year = ["year"] if "year" in records.columns else []
    return {kind: records.where(F.col("kind") == kind).select(*year, *cols) for kind, cols in kinds.items()}


def mine_texts(texts: DataFrame, words: DataFrame, longest: int, key: str = "doc_id", year: str = "year", blocks: str = "blocks", level: str = "sentence") -> DataFrame:
    """Texts (key, year, blocks) and a dictionary (tokens, term_id) -> merged records (kind, year, x, y, n).

    Blocks are normalised and cut into sentences, sentences into tokens; each
    sentence is tagged with the longest terms and gives its pairs, occurrences and
    a count of one.  Rows of one key must be of one year.  At ``level`` document, all
    sentences of a key are one unit, and units are counted instead of sentences.
    """
    block = texts.select(F.col(key).alias("doc"), F.col(year).alias("year"), F.posexplode(F.transform(blocks, lambda b: T.normalise(F.translate(b, "\n", " ")))).alias("block", "text"))
    spoken = block.select("doc", "year", "block", T.sentences(F.col("text")).alias("sentences"))
    sentences = spoken.select("doc", "year", "block", F.posexplode("sentences").alias("sentence", "s"))
    unit = ("doc", "year") if level == "document" else ("doc", "year", "block", "sentence")
    if longest == 1:  # nothing overlaps, so a unit's distinct tokens are all that is looked up
        if level == "document":
            said = spoken.select(*unit, F.flatten(F.transform("sentences", T.tokens)).alias("tokens"))
        else:
            said = sentences.select(*unit, T.tokens(F.col("s")).alias("tokens"))
        tagged = vocab.tag_single(said, words, unit)
    else:
        tagged = vocab.tag(sentences.select("doc", "year", "block", "sentence", T.tokens(F.col("s")).alias("tokens")), words, longest, ("doc", "year", "block", "sentence"))
        if level == "document":
            tagged = tagged.groupBy(*unit).agg(F.flatten(F.collect_set("ids")).alias("ids"))  # distinct lists of a document's sentences
    if level == "document":
        counts = texts.select(F.col(key).alias("doc"), F.col(year).alias("year")).distinct().groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    else:
        counts = spoken.groupBy("year").agg(F.sum(F.greatest(F.size("sentences"), F.lit(0))).alias("n"))
    sets = settled(tagged.select("year", F.array_sort(F.array_distinct("ids")).alias("terms")))  # read twice
    none = F.lit(None).cast("long")
    pairs = pair_sums(sets).select(F.lit("COOCCURRENCE").alias("kind"), "year", "x", "y", "n")
    single = sets.select("year", F.explode("terms").alias("x")).groupBy("year", "x").agg(F.count(F.lit(1)).alias("n")).select(F.lit("OCCURRENCE").alias("kind"), "year", "x", none.alias("y"), "n")
    return pairs.unionByName(single).unionByName(counts.where("n > 0").select(F.lit("SENTENCECOUNT").alias("kind"), "year", none.alias("x"), none.alias("y"), "n"))
