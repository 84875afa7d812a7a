"""Near copies by five-word SimHash, each link checked by exact Jaccard similarity.

The ``op6`` digest links texts by the parameters of its contract (three words,
3 bits).  Near copies in the usual sense, sets of five-word shingles with a
Jaccard similarity of ``SIMILAR`` or more, mostly differ in more bits, so the
pipeline's stage has parameters of its own:

1. A text becomes the set of XXH64 hashes of its five-word shingles.  Texts of
   one set are one node (``node`` is the set's hash).  A node has 256 majority
   bits over its *distinct* shingles: 64 from the hashes, 192 from mixed hashes.
2. Nodes are compared by the tiles of ``simhash`` at ``RADIUS`` bits of 64; pairs
   found must also be within ``WIDE_RADIUS`` bits of the other 192.  A bit of a
   pair at Jaccard 0.8 differs with probability 0.1875 at most (4 of 5 shingles
   shared; 0.15 for long texts), so by the binomial distribution the tiles find
   at least 0.999 of such pairs, and 0.9999 of pairs of long texts.  Population
   counts prune nothing at that radius; the sizes of the sets do, exactly: sets
   at Jaccard 0.8 differ in size by a quarter at most, so the tiles' classes are
   logarithms of sizes (``STEPS`` for each quarter).
3. Tiles return spanning forests of pairs, and each of these pairs is checked by
   its exact Jaccard similarity.  Groups in which all pairs hold are done.  In
   the others, *every* pair within the radii that isn't linked yet is checked,
   in blocks of ``BLOCK`` nodes and ``SHINGLES`` shingles a side.

Defined cases: fewer than five words are one shingle; texts that are null or
without words are copies of each other; of a group, the row of the smallest id
stays (rows without id come last; ties by a hash of the row), and nothing else
of it; rows of one id in different groups are different documents; other
columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import hashable, join_spread, settle
from .components import connect, members_of
from .forest import Forest

SHINGLE = 5
SIMILAR = (4, 5)  # 0.8, in whole numbers
RADIUS = 22
WIDE_RADIUS = 60
BLOCK = 1024
#: Shingles of a block's texts, about: with a block's nodes, what a task holds.
SHINGLES = 1 << 22
#: Size classes for each factor of 5/4; one more is compared, for rounding.
STEPS = 8
WORDS = ("fp", "w1", "w2", "w3")
MIXED = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7)))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a whole text's shingles."""
    found = [np.unique(h) for h in simhash.hashes(text, size)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bits(found: np.ndarray) -> np.ndarray:
    """Four words of majority bits over distinct hashes."""
    out = np.zeros(4, np.uint64)
    if not len(found):
        return out
    ones = np.zeros((4, 64), np.int64)
    for at in range(0, len(found), simhash.HASHED_AT_ONCE):
        part = found[at : at + simhash.HASHED_AT_ONCE]
        for k, h in enumerate((part, *(mixed(part + c) for c in MIXED))):
            ones[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(found), axis=1).view(np.uint64).ravel()


def digests(rows: DataFrame) -> DataFrame:
    """(row, id, text) -> (row, id, node, size, fp, w1, w2, w3)."""
    import xxhash

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, words = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, 4), np.uint64)
            for i, text in enumerate(batch.column(2).to_pylist()):
                found = shingles(text)
                nodes[i], sizes[i], words[i] = xxhash.xxh64_intdigest(found.tobytes()), len(found), bits(found)
            wide = [pa.array(np.ascontiguousarray(words[:, k]).view(np.int64)) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes.view(np.int64)), pa.array(sizes), *wide], names=["row", "id", "node", "size", *WORDS])

    return rows.select("row", "id", "text").mapInArrow(digest, f"row {kinds['row']}, id {kinds['id']}, node long, size long, fp long, w1 long, w2 long, w3 long")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have Jaccard similarity ``SIMILAR`` or more, exactly."""
    part, whole = SIMILAR
    if whole * min(len(a), len(b)) < part * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return whole * both >= part * (len(a) + len(b) - both)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) and (node, text) -> (a, b, holds), by exact similarity."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, held, holds = None, np.zeros(0, np.uint64), []
            for a, one, other in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if a != last:  # a pair's first end often has many
                    last, held = a, shingles(one)
                holds.append(similar(held, shingles(other)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(holds, pa.bool_())], names=["a", "b", "holds"])

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long, holds boolean")


def block_forest(words: np.ndarray, sets: list[np.ndarray], known: np.ndarray, split: int | None) -> Forest:
    """The forest of the nodes of one block, or of two (the second from ``split`` on); those of one ``known`` component are linked."""
    forest = Forest(len(sets))
    _, first, back = np.unique(known, return_index=True, return_inverse=True)
    forest.label = first[back]
    for a in range(len(sets) if split is None else split):
        start = a + 1 if split is None else split
        apart = np.bitwise_count(words[start:] ^ words[a])
        close = (apart[:, 0] <= RADIUS) & (apart[:, 1:].sum(1) <= WIDE_RADIUS) & (forest.label[start:] != forest.label[a])
        for b in (start + np.flatnonzero(close)).tolist():
            if forest.label[a] != forest.label[b] and similar(sets[a], sets[b]):
                forest.link(np.array([a]), np.array([b]))
    return forest


def checked(items: DataFrame) -> DataFrame:
    """(node, group, blocks, known, fp, w1..w3, text) of candidates -> (a, b), links that hold, as forests of each pair of blocks."""
    placed = items.withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    ways = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ways = ways.select("group", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "node", "known", *WORDS, "text")

    def check(tile: pa.Table) -> pa.Table:
        block = tile.column("b").to_numpy()
        order = np.argsort(block, kind="stable")
        two = tile.column("i")[0].as_py() != tile.column("j")[0].as_py()
        node, known = (tile.column(c).to_numpy()[order] for c in ("node", "known"))
        words = np.stack([tile.column(c).to_numpy() for c in WORDS], 1)[order].view(np.uint64)
        texts = tile.column("text")
        sets = [shingles(texts[int(at)].as_py()) for at in order]
        a, b = block_forest(words, sets, known, int((block == block.min()).sum()) if two else None).pairs()
        return pa.table({"a": pa.array(node[a]), "b": pa.array(node[b])})

    return ways.groupBy("group", "i", "j").applyInArrow(check, "a long, b long")


def similar_pairs(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, size, words of bits, row) and (row, text) -> (a, b), pairs of nodes that connect all similar ones."""
    size_class = F.floor(F.ln(F.greatest("size", F.lit(1))) * F.lit(STEPS / math.log(SIMILAR[1] / SIMILAR[0]))).cast("short")
    found = simhash.links(nodes.select("fp", F.col("node").alias("rep"), "w1", "w2", "w3", "size"), {"_size": size_class}, RADIUS, STEPS + 1, wide=WORDS[1:], wide_radius=WIDE_RADIUS)
    pairs = settle(found)
    groups = settle(members_of(pairs, "group"))
    wanted = nodes.join(groups, "node").select("node", "group", *WORDS, "row")
    items = settle(texts.join(wanted, "row").dropDuplicates(["node"]).select("node", "group", *WORDS, "text"))  # rows may repeat
    results = settle(verified(pairs, items))
    held = results.where("holds").select("a", "b")
    missed = results.where("not holds").select(F.col("a").alias("node")).distinct().join(groups, "node").select("group").distinct()
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("size") / F.lit(SHINGLES)))
    sizes = nodes.select("node", "size").join(groups, "node").groupBy("group").agg(blocks.cast("int").alias("blocks"))
    unsettled = join_spread(groups, sizes.join(missed, "group", "left_semi"), "group", "node").select("node", "blocks")
    rest = items.join(unsettled, "node").join(members_of(held, "known"), "node", "left").withColumn("known", F.coalesce("known", "node"))
    return held.unionByName(checked(settle(rest)))


def row_identity(df: DataFrame) -> Column:
    """128 bits of all columns and of which are null."""
    parts = [*hashable(df), *(F.col(f"`{c}`").isNull() for c in df.columns)]
    return F.struct(F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit("row"), *parts).alias("h2"))


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies; columns as in ``docs``."""
    inner = docs.select(*(F.col(c).alias(f"_in_{c}") for c in docs.columns))  # no name can clash
    named = inner.withColumn("row", row_identity(inner))
    texts = named.select("row", F.col(f"_in_{text}").cast("string").alias("text"))
    rows = digests(named.select("row", F.col(f"_in_{key}").alias("id"), F.col(f"_in_{text}").cast("string").alias("text")))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    nodes = settle(rows.groupBy("node").agg(first, *(F.first(c).alias(c) for c in ("size", *WORDS))))
    same = connect(similar_pairs(nodes.withColumn("row", F.col("first.row")), texts))
    chosen = nodes.join(same, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first"))
    kept = named.join(chosen.select("first.row"), "row", "left_semi").dropDuplicates(["row"])
    return kept.select(*(F.col(f"_in_{c}").alias(c) for c in docs.columns))
