"""Word-lists, dictionaries and the longest-match tagger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Groups of semantic types whose concepts are kept (fixed values).
GROUPS = ("ANAT", "CHEM", "DISO", "GENE", "PHYS")


def selected_types(groups: DataFrame) -> DataFrame:
    """(group, name, type_id, type_name) -> distinct type ids of ``GROUPS``, findings left out."""
    return groups.where(F.col("group").isin(*GROUPS) & ~F.col("type_name").contains("Finding")).select("type_id").distinct()


def wordlist(concepts: DataFrame, types: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """term_id, cuid, types, terms, ordered by cuid.

    ``concepts`` (cuid, language, term) keep English terms of concepts with a
    selected type; ``types`` are (cuid, type_id).  Lists are sorted and distinct,
    terms in lower case.
    """
    kinds = types if selected is None else types.join(selected, "type_id", "left_semi")
    by_type = kinds.groupBy("cuid").agg(F.array_sort(F.collect_set("type_id")).alias("types"))
    terms = concepts.where(F.col("language") == "ENG").groupBy("cuid").agg(F.array_sort(F.collect_set(F.lower("term"))).alias("terms"))
    rows = by_type.join(terms, "cuid")
    return rows.select((F.row_number().over(Window.orderBy("cuid")) - 1).cast("long").alias("term_id"), "cuid", "types", "terms")  # a vocabulary


def cuid_mapping(concepts: DataFrame, types: DataFrame) -> DataFrame:
    """cuid, types, and the first English term by ``line``."""
    first = concepts.where(F.col("language") == "ENG").groupBy("cuid").agg(F.min_by("term", "line").alias("term"))
    return first.join(types.groupBy("cuid").agg(F.array_sort(F.collect_set("type_id")).alias("types")), "cuid").select("cuid", "types", "term")


def dictionary(terms: DataFrame, stopwords: DataFrame | None = None, drop_short: bool = False) -> DataFrame:
    """(term_id, synonyms 'a|b') -> (tokens, term_id), one row for each key and id.

    A key may stand for several ids.  Stop-words (a text column ``term``) take
    their tokens out as keys; so do keys of two bytes or fewer if asked.
    """
    spelled = terms.select("term_id", F.explode(F.split("synonyms", r"\|")).alias("s"))
    keys = spelled.select(T.tokens(T.strip_control(F.lower(F.trim("s")))).alias("tokens"), "term_id").where(F.size("tokens") > 0).distinct()
    if stopwords is not None:
        keys = keys.join(stopwords.select(T.tokens(F.trim("term")).alias("tokens")), "tokens", "left_anti")
    return keys.where(T.long_enough(F.col("tokens"))) if drop_short else keys


def greedy(hits: Column) -> Column:
    """Hits (length, start, ids) -> ids of a longest-first, left-to-right choice without overlaps."""
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct((-h["length"]).alias("l"), h["start"].alias("s"), h["ids"].alias("ids"))))
    start = F.struct(F.array().cast("array<int>").alias("taken"), F.array().cast("array<bigint>").alias("ids"))

    def choose(acc, h):
        span = F.sequence(h["s"], h["s"] - h["l"] - 1)
        free = ~F.arrays_overlap(acc["taken"], span)
        return F.when(free, F.struct(F.concat(acc["taken"], span).alias("taken"), F.concat(acc["ids"], h["ids"]).alias("ids"))).otherwise(acc)

    return F.aggregate(ordered, start, choose, lambda acc: acc["ids"])


def tag_single(units: DataFrame, words: DataFrame, key: tuple[str, ...], tokens: str = "tokens") -> DataFrame:
    """``key`` and ids: all dictionary ids of each unit's distinct tokens; rows of one key are one unit.  Terms of several tokens don't count."""
    ids = words.where(F.size("tokens") == 1).select(F.col("tokens")[0].alias("gram"), "term_id")
    spoken = units.select(*key, F.explode_outer(F.array_distinct(T.lowered(F.col(tokens)))).alias("gram"))  # a plain explode makes Spark filter by the tokens first, which makes them twice
    return spoken.join(ids, "gram").groupBy(*key).agg(F.collect_list("term_id").alias("ids"))


def tag(sentences: DataFrame, words: DataFrame, longest: int, key: tuple[str, ...] = ("doc_id", "sentence"), tokens: str = "tokens") -> DataFrame:
    """``key`` and ids: all dictionary ids of each sentence with a hit, longest terms first.

    Single tokens are looked up in one equi-join.  Longer terms are looked up
    where the first two tokens of one begin, and only at the lengths that terms
    with this beginning have; what overlaps is settled per sentence.  No term may
    be longer than ``longest``, the dictionary's longest key.
    """
    mark = "\u0001"
    ids = words.groupBy("tokens").agg(F.array_sort(F.collect_list("term_id")).alias("ids")).withColumn("length", F.size("tokens"))
    ids = ids.withColumn("gram", F.array_join("tokens", mark)).withColumn("two", F.array_join(F.slice("tokens", 1, 2), mark))
    low = sentences.select(*key, T.lowered(F.col(tokens)).alias("_t"))
    single = low.select(*key, F.posexplode_outer("_t").alias("start", "gram")).join(ids.where("length = 1").select("gram", "ids"), "gram")  # outer: else tokens are made twice, for a filter
    hits = single.select(*key, F.lit(1).alias("length"), (F.col("start") + 1).alias("start"), "ids")
    lengths = ids.where("length > 1").groupBy("two").agg(F.collect_set("length").alias("lengths"))
    places = F.when(F.size("_t") > 1, F.sequence(F.lit(1), F.size("_t") - 1))
    begun = low.select(*key, "_t", F.explode_outer(places).alias("start"))
    two = F.concat(F.get("_t", F.col("start") - 1), F.lit(mark), F.get("_t", F.col("start")))
    begun = begun.select(*key, "start", two.alias("two"), F.slice("_t", F.coalesce("start", F.lit(1)), F.lit(longest)).alias("rest")).join(lengths, "two")
    spread = begun.select(*key, "start", "rest", F.explode("lengths").alias("length")).where(F.size("rest") >= F.col("length"))
    spread = spread.select(*key, "start", "length", F.array_join(F.slice("rest", F.lit(1), F.col("length")), mark).alias("gram"))
    hits = hits.unionByName(spread.join(ids.where("length > 1").select("gram", "ids"), "gram").select(*key, "length", "start", "ids"))
    found = hits.groupBy(*key).agg(F.collect_list(F.struct("length", "start", "ids")).alias("_hits"))
    plain = F.flatten(F.transform(F.array_sort("_hits"), lambda h: h["ids"]))  # single tokens can't overlap
    return found.select(*key, F.when(F.exists("_hits", lambda h: h["length"] > 1), greedy(F.col("_hits"))).otherwise(plain).alias("ids"))
