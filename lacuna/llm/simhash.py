"""SimHash near-duplicates by tiled exact comparison.

A fingerprint bit is the majority of that bit over the XXH64 hashes of the
text's three-word shingles.  Distinct fingerprints fall into classes by their
population count and the counts of their four quarters (17 ** 4 classes at
most); classes in that order make chunks of about equal size, a large class
several, by hash.  A chunk knows the least and greatest counts in it.  Pairs of
chunks whose counts are apart by more than the radius cannot hold a link (the
sum of differences of part counts never exceeds the distance) and are dropped
before anything is sent; every other pair is one tile, compared with
exclusive-or and bit counts in numpy, strips that are too far apart left out.
No bucket is probed and nothing is estimated, so no link is lost.

A tile returns a spanning forest of its links, less than one row for each of its
fingerprints, so a huge group of near copies costs comparisons but no rows.
Copies of one fingerprint (documents without words, say) are one fingerprint.
Fingerprints, links and components stay in the cluster.

Defined cases: a text that is null or has no words has fingerprint zero and is
linked like any other; a text of any length is hashed in blocks; rows without a
key take part, link others, and have the component of what they reach (null if
no row with a key is); rows of one key with different texts are different rows;
repeated rows are copies; an empty table gives no rows; other columns, whatever
their names, never enter the plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_spread, settle
from .components import members_of
from .forest import Forest

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Chunks number about ``CHUNKS``, so that small tables make tasks enough, but hold at least and at most so many items.
CHUNKS, LEAST, MOST = 24, 1 << 12, 1 << 16
STRIP, COLUMNS = 128, 2048
HASHED_AT_ONCE = 1 << 16


def hashes(text: str | None, size: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """The XXH64 hashes of all shingles of a whole text, in blocks."""
    import xxhash

    words = text.encode().lower().split() if text else []  # of bytes: A-Z and ASCII white space only
    if not words:
        return
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    starts, ends = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), HASHED_AT_ONCE):
        spans = zip(starts[at : at + HASHED_AT_ONCE], ends[at : at + HASHED_AT_ONCE])
        yield np.array([digest(line[a:b], seed) for a, b in spans], np.uint64)


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    ones, n = np.zeros(64, np.int64), 0
    for block in hashes(text, size, seed):
        ones += np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(block)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long) of every row; ``fp`` is the fingerprint's signed value."""
    kind = df.schema[key].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["key", "fp"])

    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(hashed, f"key {kind}, fp long")


def quarter_counts(fp: str = "fp") -> dict[str, Column]:
    """The population count of a fingerprint and of its four quarters."""
    quarters = {f"_q{i}": F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long"))).cast("byte") for i in range(4)}
    return {"_all": F.bit_count(fp).cast("byte"), **quarters}


def gap(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    """How far boxes of counts are apart: in the first count, or in the sum of the others."""
    apart = np.maximum(np.maximum(low_a - high_b, low_b - high_a), 0)
    return np.maximum(apart[:, 0], apart[:, 1:].sum(1))


class Side:
    """The items of a chunk in the order of their counts, cut into strips."""

    def __init__(self, counts: np.ndarray, words: np.ndarray, shift: int, strip: int):
        order = np.lexsort(counts.T[::-1])
        counts = counts[order].astype(np.int16)
        self.cuts = np.arange(0, len(order), strip)
        self.low, self.high = (f.reduceat(counts, self.cuts, axis=0) for f in (np.minimum, np.maximum))
        self.words, self.at, self.strip = words[order], order + shift, np.arange(len(order)) // strip
        self.fp = np.ascontiguousarray(self.words[:, 0])


def tile_forest(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray] | None, radius: int = RADIUS, reach: int = RADIUS, wide_radius: int = 0) -> Forest:
    """The forest of a tile's items (left ones, then right ones).

    A side is its counts (n, classes) and words of bits (n, 1 or more); links are
    within ``radius`` bits in the first word and ``wide_radius`` in all others.
    Without ``right``, the left chunk is compared with itself.
    """
    own = right is None
    forest = Forest(len(left[0]) + (0 if own else len(right[0])))
    if not len(left[0]) or not (own or len(right[0])):
        return forest
    a = Side(*left, 0, STRIP)
    b = a if own else Side(*right, len(left[0]), STRIP)
    for s, cut in enumerate(a.cuts):
        near = gap(a.low[s], a.high[s], b.low, b.high) <= reach
        if own:
            near[:s] = False
        at = np.flatnonzero(near[b.strip])
        for c in range(0, len(at), COLUMNS):
            some = at[c : c + COLUMNS]
            i, j = np.nonzero(np.bitwise_count(a.fp[cut : cut + STRIP, None] ^ b.fp[None, some]) <= radius)
            i, j = cut + i, some[j]
            if a.words.shape[1] > 1:
                close = np.bitwise_count(a.words[i, 1:] ^ b.words[j, 1:]).sum(1) <= wide_radius
                i, j = i[close], j[close]
            forest.link(a.at[i], b.at[j])
    return forest


def links(distinct: DataFrame, classes: dict[str, Column], radius: int = RADIUS, reach: int = RADIUS, chunk: int | None = None, wide: tuple[str, ...] = (), wide_radius: int = 0) -> DataFrame:
    """(fp, rep) distinct fingerprints -> (a, b): linked pairs of reps, a spanning forest of each tile.

    ``classes`` are the counts that may be at most ``reach`` apart, see ``gap``;
    their distinct combinations must be few, whatever the number of rows.
    ``wide`` names columns of further bits, see ``tile_forest``.
    """
    marked = settle(distinct.select("fp", "rep", *wide, *(c.alias(name) for name, c in classes.items())))
    names, first = list(classes), next(iter(classes))
    if chunk is None:
        chunk = min(MOST, max(LEAST, marked.count() // CHUNKS))
    sizes = marked.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # classes, not rows
    sizes = sizes.withColumn("_first", F.floor(ahead / chunk).cast("int")).withColumn("_parts", F.greatest(F.lit(1), F.floor(F.col("_n") / chunk)).cast("int"))
    in_reach = Window.orderBy(F.col(first).cast("int")).rangeBetween(Window.unboundedPreceding, reach)
    sizes = settle(sizes.withColumn("_last", F.max(F.col("_first") + F.col("_parts") - 1).over(in_reach)))
    placed = marked.join(F.broadcast(sizes), names)  # a row for each class
    number = F.col("_first") + F.pmod(F.xxhash64("rep"), F.col("_parts")).cast("int")
    box = [f(c).alias(f"{side}{c}") for c in names for side, f in (("low", F.min), ("high", F.max))]
    packed = settle(placed.withColumn("k", number).groupBy("k").agg(F.collect_list(F.struct("fp", "rep", *wide, *names)).alias("items"), F.max("_last").alias("last"), *box))
    ends = [f"{side}{c}" for c in names for side in ("low", "high")]
    pairs = packed.select(F.col("k").alias("i"), *(F.col(e).alias(f"i{e}") for e in ends), F.explode(F.sequence("k", "last")).alias("j"))
    pairs = pairs.join(packed.select(F.col("k").alias("j"), *(F.col(e).alias(f"j{e}") for e in ends)), "j")
    apart = {c: F.greatest(F.col(f"ilow{c}") - F.col(f"jhigh{c}"), F.col(f"jlow{c}") - F.col(f"ihigh{c}"), F.lit(0)) for c in names}
    others = [apart[c].cast("int") for c in names if c != first]
    pairs = pairs.where((apart[first] <= reach) & (sum(others, F.lit(0)) <= reach)).select("i", "j")
    sides = settle(pairs).select("i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))).alias("k"))
    tiles = sides.join(packed.select("k", "items"), "k")

    def compare(tile: pa.Table) -> pa.Table:
        sides, reps = [], []
        for number in sorted(set(tile.column("k").to_pylist())):
            items = tile.column("items")[tile.column("k").to_pylist().index(number)].values
            column = lambda c: items.field(c).to_numpy(zero_copy_only=False)
            sides.append((np.stack([column(c) for c in names], 1), np.stack([column(c).view(np.uint64) for c in ("fp", *wide)], 1)))
            reps.append(column("rep"))
        forest = tile_forest(sides[0], sides[1] if len(sides) > 1 else None, radius, reach, wide_radius)
        rep = np.concatenate(reps)
        a, b = forest.pairs()
        return pa.table({"a": pa.array(rep[a]), "b": pa.array(rep[b])})

    return tiles.groupBy("i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fp, component): the smallest key each row reaches over links."""
    rows = settle(fingerprints(df, key, text))
    distinct = settle(rows.groupBy("fp").agg(F.min("key").alias("least")))
    members = members_of(links(distinct.select("fp", F.col("fp").alias("rep")), quarter_counts(), radius, radius), "root")
    inside = settle(distinct.join(members.withColumnRenamed("node", "fp"), "fp"))  # linked fingerprints only
    least = inside.groupBy("root").agg(F.min("least").alias("component"))
    linked = join_spread(inside.select("fp", "root"), least, "root", "fp").select("fp", "component")
    named = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"))
    return rows.join(named, "fp").select(F.col("key").alias(key), "fp", "component")


def deduplicate_documents(docs: DataFrame) -> DataFrame:
    """The ``op6`` digest."""
    found = near_duplicates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
