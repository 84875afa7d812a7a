"""Sums over the shared neighbours of pairs, by tiles.

Ids are dealt to blocks by ranges that hold like numbers of entries; a pair belongs
to the tile of its two blocks.  Neighbours are cut by ranges, too (further by hash
where a range holds many entries, so no hub is one list).  A cell is a tile and a
cut: it gets its pairs and the lists of its two blocks in this cut (as sorted
arrays), and intersects them there: the shorter list of a pair is looked up in
the other's.  A cell in which one of the blocks has no neighbours gets nothing.  A
list is sent once for each tile of its block, never with every pair, and what is
made are sums, never shared neighbours.  Tiles are met in rounds, so disk holds what
one round sends, whatever the number of tiles.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import dealt, settled

#: Entries of the lists of a cell, pairs of a tile, and entries of a list, about.
BLOCK, TILE, LIST = 1 << 22, 1 << 20, 1 << 18
#: Entries that a round sends, about, and what a pair counts for.
ROUND, PAIR = 1 << 26, 3
#: Steps of neighbours by which blocks are found apart; blocks at most, and partners of a block, for which one cut is enough.
STEPS, MOST_BLOCKS, NEAR = 256, 128, 8
#: Neighbours looked up at once.
AT_ONCE = 1 << 21
#: What a list holds for a sum besides the neighbours.
HELD = {"links": (), "product": ("n",), "least": ("n",), "apart": ("d",)}
#: Sums there are: number of shared neighbours z, sums of n(x, z) n(z, y) and of their minimum, product of 1 - d(x, z) d(z, y).
LINKS, PRODUCT, LEAST, APART = "links", "product", "least", "apart"


def intersected(x: np.ndarray, y: np.ndarray, ids: np.ndarray, lengths: np.ndarray, links: np.ndarray, n: np.ndarray | None, d: np.ndarray | None, sums: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Sums of pairs (x, y) that share neighbours; lists are given one after the other, in the order of ``ids``."""
    names, link = np.unique(links, return_inverse=True)
    owner = np.repeat(np.arange(len(ids)), lengths)
    keys = owner * len(names) + link
    order = np.argsort(keys, kind="stable")
    keys, link, n, d = keys[order], link[order], None if n is None else n[order], None if d is None else d[order]
    starts = np.cumsum(lengths) - lengths
    by_id = np.argsort(ids)
    place = lambda v: by_id[np.minimum(np.searchsorted(ids, v, sorter=by_id), len(ids) - 1)]
    a, b = place(x), place(y)
    known = (ids[a] == x) & (ids[b] == y)
    x, y, a, b = x[known], y[known], a[known], b[known]
    a, b = np.where(lengths[a] <= lengths[b], a, b), np.where(lengths[a] <= lengths[b], b, a)
    by_other = np.argsort(b, kind="stable")  # look-ups stay in one list for a while
    x, y, a, b = x[by_other], y[by_other], a[by_other], b[by_other]
    cuts = np.cumsum(lengths[a]) // AT_ONCE
    out: dict[str, list[np.ndarray]] = {name: [] for name in ("x", "y", *sums)}
    for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(cuts)) + 1):
        size = lengths[a[part]]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[a[part]], size)
        wanted = np.repeat(b[part], size) * len(names) + link[at]
        found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = np.flatnonzero(keys[found] == wanted)
        pair = np.repeat(part, size)[hit]
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        if not len(first):
            continue
        one, two = at[hit], found[hit]
        out["x"].append(x[pair[first]])
        out["y"].append(y[pair[first]])
        for name in sums:
            out[name].append({
                LINKS: lambda: np.diff(np.append(first, len(pair))),
                PRODUCT: lambda: np.add.reduceat(n[one] * n[two], first),
                LEAST: lambda: np.add.reduceat(np.minimum(n[one], n[two]), first),
                APART: lambda: np.multiply.reduceat(1 - d[one] * d[two], first),
            }[name]())
    return {name: np.concatenate(parts) if parts else np.zeros(0, np.int64) for name, parts in out.items()}


def _cuts(adjacency: DataFrame, parts: int) -> list[float]:
    """Bounds of ranges of ids that hold like numbers of entries."""
    return sorted(adjacency.approxQuantile("x", [k / parts for k in range(1, parts)], 0.1 / parts)) if parts > 1 else []


def _range(column: str, cuts: list[float]) -> Column:
    """Which range of the cuts an id is in, by halves."""
    if len(set(cuts)) < len(cuts):  # an id with the entries of several ranges
        first = {c: k + 1 for k, c in enumerate(cuts)}
        return F.get(F.array(F.lit(0), *(F.lit(first[c]) for c in sorted(first))), _range(column, sorted(first)))

    def side(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(column) < F.lit(cuts[middle]), side(low, middle)).otherwise(side(middle + 1, high))

    return side(0, len(cuts))


class Cells:
    """How blocks, cuts and cells are laid out for some pairs and a matrix.

    ``holds`` has the entries of a block's lists in a cut, by steps of neighbours
    of like width: only blocks with a step in common can share a neighbour.
    """

    def __init__(self, pairs: DataFrame, adjacency: DataFrame):
        size = adjacency.groupBy("x").count().agg(F.count(F.lit(1)).alias("ids"), F.sum("count").alias("entries"), F.max("count").alias("longest"), F.min("x").alias("low"), F.max("x").alias("high")).first()
        self.ids, self.entries, self.pairs = size["ids"], size["entries"] or 0, pairs.count()
        low, width = size["low"] or 0, max(1, -(-((size["high"] or 0) - (size["low"] or 0) + 1) // STEPS))
        self.step = F.floor((F.col("y") - F.lit(low)) / F.lit(width)).cast("int")
        cells = 2 * self.entries / BLOCK
        fewest = max(1, math.ceil(math.sqrt(cells)), math.ceil(math.sqrt(2 * self.pairs / TILE)))
        longest = math.ceil((size["longest"] or 0) / LIST)
        self._lay(adjacency, min(max(fewest, math.ceil(cells)), max(fewest, MOST_BLOCKS)), max(1, longest))
        if self.partners > NEAR:  # ids say little about who is near whom
            self._lay(adjacency, fewest, max(1, math.ceil(cells / fewest), longest))
        ends = pairs.select(F.least(self.block("x"), self.block("y")).alias("i"), F.greatest(self.block("x"), self.block("y")).alias("j"))
        self._open({(r["i"], r["j"]): r["count"] for r in ends.groupBy("i", "j").count().collect()})

    def _lay(self, adjacency: DataFrame, blocks: int, ranges: int) -> None:
        self.block_cuts, self.range_cuts = _cuts(adjacency, blocks), _cuts(adjacency, ranges)
        found = adjacency.groupBy(self.block("x").alias("i"), self.range("y").alias("r"), self.step.alias("s")).count().collect()
        self.holds: dict[tuple[int, int], int] = {}
        for row in found:
            self.holds[row["i"], row["r"]] = self.holds.get((row["i"], row["r"]), 0) + row["count"]
        met = np.zeros((ranges, blocks, STEPS), np.float32)
        for row in found:
            met[row["r"], row["i"], row["s"]] = 1
        self.near = np.stack([m @ m.T > 0 for m in met])
        self.partners = self.near.any(0).sum() / blocks

    def block(self, column: str) -> Column:
        return _range(column, self.block_cuts)

    def range(self, column: str) -> Column:
        return _range(column, self.range_cuts)

    def _open(self, asked: dict[tuple[int, int], int]) -> None:
        """Cells (i, j, c) by rounds that send about ``ROUND`` entries and pairs."""
        both = lambda i, j, r: self.holds[i, r] + (self.holds[j, r] if i != j else 0)
        cells = [(i, j, r) for i, j in sorted(asked) for r in range(len(self.near)) if self.near[r, i, j]]
        self.ways = [max(1, math.ceil(max((both(*cell) for cell in cells if cell[2] == r), default=0) / BLOCK)) for r in range(len(self.near))]
        self.before = np.cumsum([0, *self.ways]).tolist()
        self.rounds: list[list[tuple[int, int, int]]] = [[]]
        sent, last = 0, None
        for i, j, r in cells:
            costs = both(i, j, r) + PAIR * asked[i, j] * self.ways[r]
            if sent + costs > ROUND and self.rounds[-1] and (i, j) != last:  # a tile's sums come of one round
                self.rounds.append([])
                sent = 0
            self.rounds[-1] += [(i, j, self.before[r] + w) for w in range(self.ways[r])]
            sent, last = sent + costs, (i, j)


def shared_sums(pairs: DataFrame, adjacency: DataFrame, sums: tuple[str, ...]) -> DataFrame:
    """(x, y) distinct and a mirrored (x, y, n and d for ``APART``) -> (x, y and ``sums``); pairs that share nothing are left out.

    Both are read more than once: settle what isn't cheap.  What is sent at once is
    bounded: lists are written once and tiles are met in rounds, each written
    before the next begins, if they don't fit one.
    """
    spark, kind = pairs.sparkSession, adjacency.schema["n"].dataType.simpleString()
    laid = Cells(pairs, adjacency)
    block = laid.block
    shares = F.array(*(F.lit(w) for w in laid.ways)), F.array(*(F.lit(b) for b in laid.before))
    cut = lambda r: F.get(shares[1], r) + F.pmod(F.xxhash64("y"), F.get(shares[0], r)).cast("int")
    held = ("y", *(c for c in ("n", "d") if any(c in HELD[name] for name in sums)))
    if laid.pairs < laid.ids:
        adjacency = adjacency.join(pairs.select(F.explode(F.array("x", "y")).alias("x")).distinct(), "x", "left_semi")
    entries = dealt(adjacency.select(F.col("x").alias("id"), *held), laid.entries, "id")  # lists begun before would be sent in pieces
    lists = entries.groupBy("id", cut(laid.range("y")).alias("c")).agg(F.sort_array(F.collect_list(F.struct(*held))).alias("near")).select("id", "c", *(F.col(f"near.{k}").alias(k) for k in held))
    if len(laid.rounds) > 1:
        lists = settled(lists)
    types = {LINKS: "long", PRODUCT: kind, LEAST: kind, APART: "double"}
    arrow = {name: pa.int64() if of in ("long", "bigint") else pa.float64() for name, of in types.items()}

    def tile(some: pa.Table, near: pa.Table) -> pa.Table:
        columns = {"x": pa.int64(), "y": pa.int64()} | {name: arrow[name] for name in sums}
        if not some.num_rows or not near.num_rows:
            return pa.table({name: pa.array([], of) for name, of in columns.items()})
        flat = lambda name: near.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        lengths = near.column("y").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        made = intersected(some.column("x").to_numpy(), some.column("y").to_numpy(), near.column("id").to_numpy(), lengths, flat("y"), *(flat(c) if c in held else None for c in ("n", "d")), sums)
        return pa.table({name: pa.array(made[name], of, safe=False) for name, of in columns.items()})

    def met(named: list[tuple[int, int, int]]) -> DataFrame:
        tiles = F.broadcast(spark.createDataFrame(named, "i int, j int, c int"))
        both = F.broadcast(spark.createDataFrame(sorted({(b, i, j, c) for i, j, c in named for b in (i, j)}), "b int, i int, j int, c int"))
        sent = lists.withColumn("b", block("id")).join(both, ["b", "c"])
        some = pairs.select("x", "y", F.least(block("x"), block("y")).alias("i"), F.greatest(block("x"), block("y")).alias("j")).join(tiles, ["i", "j"])
        found = some.groupBy("i", "j", "c").cogroup(sent.groupBy("i", "j", "c")).applyInArrow(tile, ", ".join(["x long", "y long", *(f"{name} {types[name]}" for name in sums)]))
        if laid.before[-1] == 1:
            return found
        return found.groupBy("x", "y").agg(*((F.product(name) if name == APART else F.sum(name)).alias(name) for name in sums))

    if len(laid.rounds) == 1:
        return met(laid.rounds[0])
    return reduce(DataFrame.unionByName, [settled(met(named)) for named in laid.rounds])
