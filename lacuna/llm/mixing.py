"""Mixing sources to target weights, exactly to the word.

Rows get hash-random keys and are sorted within their source.  A source's
budget is met by whole epochs over it and a last, partial one, cut where the
prefix sum of sizes in key order reaches the rest of the budget; the row on the
cut gives only the words still wanted, so the words taken of a source are its
target rounded down.

The prefix sum is distributed.  A row's key is the md5 of what it is (id, source
and text) and of its number among equal rows, so keys are uniform whatever ids
or texts repeat, and equal key ranges hold about equal numbers of rows: each
(source, range) is summed, the sums are accumulated per source, and a window
inside a range adds the rest.  A source that holds a third of all rows is spread
over as many ranges as there are (one for each ``ROWS_A_RANGE`` rows), each a
window of its own.  Equal rows are counted, never ranked: their numbers are
written out from the count.

Texts take no part in this; ``mixed_rows`` sends each text once, to its uses.

Defined cases: a null source is a source (the last one); a null key is a key of
its own; equal rows are interchangeable; texts without words have size 0 and
give nothing; an empty table gives no rows; other columns, whatever their names,
stay as they are (of rows equal in id, source and text ``mixed_rows`` uses one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hashable, id_text, n_words, repeated, settle

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix-1"
ROWS_A_RANGE = 16_384
LEAST_RANGES = 64


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """Budgets: (_source, source_size) -> (_source, source_size, target).

    Sources by code point, null last, take the weights in turn.  A source that
    would get over ``most`` times its size gets that; what is left is shared by
    weight among the others.  Capped sources are the first ones by cap/weight:
    one is capped as long as its cap is below its share of what the ones before
    it have left, so one pass in that order settles all.  One row for each
    source goes through these windows, never rows of the data.
    """
    turn = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((turn - 1) % len(weights) + 1).cast("int")).cast("double")
    cap = (F.col("source_size") * most).cast("double")
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_w"), F.col("_source").asc_nulls_last())
    every = Window.partitionBy()
    earlier, later = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    out = sizes.withColumn("_w", weight).withColumn("_cap", cap).withColumn("_all", F.sum("source_size").over(every) * share)
    out = out.withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))).withColumn("_rest", F.sum("_w").over(later))
    out = out.withColumn("_capped", F.col("_cap") * F.col("_rest") <= F.col("_left") * F.col("_w"))
    left = F.col("_all") - F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0.0)).over(every)
    open_weight = F.sum(F.when(F.col("_capped"), 0.0).otherwise(F.col("_w"))).over(every)
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(left * F.col("_w") / open_weight)
    return out.withColumn("target", target).select("_source", "source_size", "target")


def identity(key: Column, source: Column, text: Column) -> Column:
    """md5 of id, source and text, nulls told from every text."""
    flag = lambda c: c.isNull().cast("string")
    return F.md5(F.concat_ws("|", id_text(key), flag(key), id_text(source), flag(source), F.coalesce(F.md5(text.cast("binary")), F.lit("null"))).cast("binary"))


def takes(df: DataFrame, key: str, source: str, text: str, weights: tuple[int, ...], share: float, most: int, seed: str) -> DataFrame:
    """One row for each of ``df``: _what (``identity``), _key, _source, _size, source_size, target and taken."""
    what = identity(F.col(key), F.col(source), F.col(text))
    cols = [what.alias("_what"), F.col(key).alias("_key"), F.col(source).alias("_source"), n_words(F.col(text)).alias("_size")]
    equal = df.select(*cols).groupBy("_what", "_key", "_source", "_size").agg(F.count(F.lit(1)).alias("_n"))
    rows = repeated(settle(equal), "_n", "_number").drop("_n")
    n_ranges = max(LEAST_RANGES, rows.count() // ROWS_A_RANGE)
    order = F.md5(F.concat_ws("|", "_what", F.col("_number").cast("string"), F.lit(seed)).cast("binary"))
    spot = F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * F.lit(n_ranges) / F.lit(1 << 32)).cast("long")
    same = [F.coalesce(F.col("_source").cast("string"), F.lit("")).alias("_s"), F.col("_source").isNull().alias("_none")]
    rows = rows.withColumn("_order", order).select("*", *same, spot.alias("_range"))
    keys = ["_s", "_none", "_range"]

    ranges = settle(rows.groupBy("_source", *keys).agg(F.sum("_size").alias("_sum")))
    budget = targets(ranges.groupBy("_source").agg(F.sum("_sum").alias("source_size")), weights, share, most)
    budget = budget.select(*same, "source_size", "target")
    before = F.sum("_sum").over(Window.partitionBy("_s", "_none").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranges.withColumn("_offset", F.coalesce(before, F.lit(0))).drop("_source", "_sum").join(budget, ["_s", "_none"])

    inside = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_order").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(offsets, keys)
    budget_words = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div greatest(source_size, 1)")).otherwise(F.lit(0))
    rest = budget_words - F.col("_whole") * F.col("source_size") - F.col("_offset") - F.col("_inside")
    taken = F.col("_whole") * F.col("_size") + F.greatest(F.lit(0), F.least(rest, F.col("_size")))
    rows = rows.withColumn("_whole", whole).withColumn("taken", taken.cast("long"))
    return rows.select("_what", "_key", "_source", "_size", "source_size", "target", "taken")


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """key, source, size, source_size, target and taken of every row.

    ``taken`` counts words, repeats included; a row is used
    ``ceil(taken / size)`` times, at most ``most``.
    """
    rows = takes(df, key, source, text, weights, share, most, seed)
    return rows.select(F.col("_key").alias(key), F.col("_source").alias(source), F.col("_size").alias("size"), "source_size", "target", "taken")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The ``op3`` digest."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """Documents as the mix uses them: each one as often as words are taken of it.

    Columns stay those of ``docs``; the row on a cut is used whole.
    """
    used = takes(docs, "doc_id", "source", "text", WEIGHTS, SHARE, MOST_EPOCHS, SEED).where("taken > 0")
    uses = used.groupBy("_what").agg(F.sum(F.ceil(F.col("taken") / F.col("_size"))).alias("_uses"))
    whole = docs.select(F.struct("*").alias("_row"), identity(F.col("doc_id"), F.col("source"), F.col("text")).alias("_what"), F.xxhash64(*hashable(docs)).alias("_hash"))
    one = whole.groupBy("_what").agg(F.min_by("_row", "_hash").alias("_row"))  # equal rows meet before they are sent
    return repeated(one.join(uses, "_what"), "_uses", "_number").select("_row.*")
