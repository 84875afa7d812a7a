"""Embedding near-duplicates by collision-counting projections.

Many one-dimensional random projections are made of every vector.  Around each
vector, as the centre, lies a window on each projection; two vectors *collide*
on a projection if one lies in the other's window.  Pairs with at least a
threshold of collisions are verified by their cosine in double precision.

Windows alone don't thin out high-dimensional data: unit vectors spread over
about +-3 on every projection, so a fixed window holds a fixed share of all
rows.  So each projection is confined to cells by the signs of further random
projections of its own: colliding means same cell *and* within the window.  The
number of sign bits follows log2 of the number of rows, which keeps cells at
about ``CELL`` rows whatever the size of the input.

Calibration: for a pair exactly at the cosine bound, one projection collides
with probability p = (1 - angle/pi)**bits * P(|N(0, 1)| <= window/distance);
collisions on ``m`` projections are Binomial(m, p).  ``calibrate`` takes the
least m at which ``LEAST`` collisions come with probability ``RECALL``, however
many projections that takes, and then the greatest count that still keeps that
recall.  Closer pairs collide more often, so recall is at least that.  A recall
of 1 asks for the exact way: no cells, no windows, every pair is verified.

A projection's cells, some to a task, are sorted by cell and projection and swept
once.  A pair is counted and verified where it collides *first*, so links are
found once each and only sums leave a task: for each vector its links, and the
pairs of a spanning forest.  Rows of the sweep hold a vector's id, copies, stored
components and signs (a bit each); its projections are made again in the task.

Skew: equal vectors are one vector with a multiplicity.  Cells above ``CHUNK``
vectors (near copies of one vector) are dealt into chunks by hash and compared
chunk pair by chunk pair in tasks of their own.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, as do rows without an id (their component is
null); vectors of different lengths never link; rows repeating an id with other
vectors are one node whose links add up; an empty table gives no rows; other
columns, whatever their names, never enter the plan.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .components import connect
from .forest import Forest
from .topk import usable

COSINE = 0.95
RECALL = 0.9995
LEAST = 3
CELL = 256
CHUNK = 2048
#: Cells that a task sweeps together.
TOGETHER = 8
#: Window half-width in distances of a pair at the bound: 98.8 % of them are within.
REACH = 2.5
SEED = 20240601
#: Most oversized cells that are broadcast; beyond, they are joined by a shuffle.
BROADCAST_CELLS = 100_000
SWEEP = 128
#: Distance between cells on the line of a sweep; projections of unit vectors are far smaller.
APART = 1000.0


def tail(m: int, p: float, least: int) -> float:
    """P(Binomial(m, p) >= least)."""
    return 1.0 - sum(math.comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(least))


def calibrate(n: int, cosine: float = COSINE, recall: float = RECALL) -> dict:
    """Sign bits, window, projections and threshold for ``n`` distinct vectors."""
    if recall >= 1:
        return {"bits": 0, "window": math.inf, "m": 1, "threshold": 1, "p": 1.0}
    bits = max(0, math.ceil(math.log2(max(1, n) / CELL)))
    distance = math.sqrt(2 - 2 * cosine)
    p = (1 - math.acos(cosine) / math.pi) ** bits * math.erf(REACH / math.sqrt(2))
    m = LEAST
    while tail(m, p, LEAST) < recall:
        m += 1
    threshold = LEAST
    while tail(m, p, threshold + 1) >= recall:
        threshold += 1
    return {"bits": bits, "window": REACH * distance, "m": m, "threshold": threshold, "p": p}


def directions(dims: int, m: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The projections (dims, m) and the sign projections (dims, m * bits)."""
    rng = np.random.default_rng([SEED, dims])
    return rng.standard_normal((dims, m)), rng.standard_normal((dims, m * bits))


def cells_of(signs: np.ndarray, m: int, bits: int) -> np.ndarray:
    """Cells (n, m) of the signs (n, m * bits) of vectors."""
    if not bits:
        return np.zeros((len(signs), m), np.int32)
    return signs.reshape(len(signs), m, bits).astype(np.int32) @ (1 << np.arange(bits, dtype=np.int32))


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision; no square over- or underflows."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)
    return v / np.sqrt(np.square(v).sum(1, keepdims=True))


def sweep(j: int, cell: np.ndarray, side: np.ndarray, line: np.ndarray, cells: np.ndarray, unit: np.ndarray, copies: np.ndarray, window: float, threshold: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links within cells of projection ``j`` found nowhere before: (links of items, pairs of a forest).

    With two sides, only pairs across them count.
    """
    n = len(line)
    _, rank = np.unique(cell, return_inverse=True)
    at = line[:, j] + rank * APART if rank.any() else line[:, j]  # cells lie apart on one line
    order = np.argsort(at, kind="stable")
    at, line, cells, unit, side, copies = at[order], line[order], cells[order], unit[order], side[order], copies[order]
    far = np.searchsorted(at, at + window, side="right")
    links = np.zeros(n, np.int64)
    forest = Forest(n)
    across = side.min() != side.max()
    for a in range(0, n, SWEEP):
        b = min(n, a + SWEEP)
        end = int(far[a:b].max())
        rows, cols = np.arange(a, b), np.arange(a, end)
        pair = (cols[None] > rows[:, None]) & (cols[None] < far[a:b, None])
        if across:
            pair &= side[a:b, None] != side[None, a:end]
        i, k = np.nonzero(pair)
        i, k = i + a, k + a
        for c in range(0, len(i), 1 << 14):
            x, y = i[c : c + (1 << 14)], k[c : c + (1 << 14)]
            hit = cells[x] == cells[y]
            some = np.count_nonzero(hit, axis=1) >= threshold  # sharing cells is rarer than lying in a window
            x, y, hit = x[some], y[some], hit[some]
            hit &= np.abs(line[x] - line[y]) <= window
            hit[:, j] = True
            passed = (np.count_nonzero(hit, axis=1) >= threshold) & (hit.argmax(1) == j)  # an earlier collision: found there
            x, y = x[passed], y[passed]
            near = np.einsum("nd,nd->n", unit[x], unit[y]) >= cosine
            x, y = x[near], y[near]
            links += np.bincount(x, copies[y], n).astype(np.int64) + np.bincount(y, copies[x], n).astype(np.int64)
            forest.link(x, y)
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return links[back], order[forest.pairs()]


def by_length(column: pa.ListArray | pa.ChunkedArray, stored: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of all vectors, and where each vector starts and how long it is."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    dims = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False).astype(stored), np.cumsum(dims) - dims, dims


def near_links(distinct: DataFrame, n: int, cosine: float = COSINE, recall: float = RECALL, chunk: int = CHUNK) -> DataFrame:
    """(rep, copies, v) distinct vectors -> (rep, links, other): partial sums of links, and forest pairs where ``other`` isn't null."""
    plan = calibrate(n, cosine, recall)
    # Vectors travel as they are stored: single precision takes half of double.
    stored = np.float32 if distinct.schema["v"].dataType.elementType.typeName() == "float" else np.float64
    m, bits, window, threshold = plan["m"], plan["bits"], plan["window"], plan["threshold"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}
        for batch in batches:
            for part in (batch.slice(a, 2000) for a in range(0, batch.num_rows, 2000)):
                flat, starts, dims = by_length(part.column(2), stored)
                cells, packed = np.zeros((len(dims), m), np.int32), np.zeros((len(dims), -(-m * bits // 8)), np.uint8)
                for d in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == d)
                    made.setdefault(d, directions(d, m, bits))
                    signs = unit_rows(flat[starts[at][:, None] + np.arange(d)]) @ made[d][1] > 0
                    cells[at], packed[at] = cells_of(signs, m, bits), np.packbits(signs, axis=1)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, m, dtype=np.int32)), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(dims.astype(np.int32)), listed, part.column(2), pa.array([x.tobytes() for x in packed], pa.binary())], names=["rep", "copies", "dims", "cells", "v", "signs"])

    kind = distinct.schema["v"].dataType.simpleString()
    marked = settle(distinct.select("rep", "copies", "v").mapInArrow(project, f"rep long, copies long, dims int, cells array<int>, v {kind}, signs binary"))
    keys = ["dims", "j", "cell"]
    dealt = marked.select("rep", "copies", "dims", "v", "signs", F.posexplode("cells").alias("j", "cell"))
    big = settle(marked.select("dims", F.posexplode("cells").alias("j", "cell")).groupBy(*keys).count().where(F.col("count") > chunk).select(*keys, F.ceil(F.col("count") / chunk).cast("int").alias("g")))
    n_big = big.count()
    if n_big:
        dealt = dealt.join(F.broadcast(big) if n_big <= BROADCAST_CELLS else big, keys, "left")
    else:
        dealt = dealt.withColumn("g", F.lit(None).cast("int"))
    own = F.when(F.col("g").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("g"), F.lit(1)) - 1)))
    tile = F.when(F.col("g").isNull(), F.expr(f"cell div {TOGETHER}")).otherwise(-1 - F.col("cell").cast("long"))  # large cells by themselves
    tiles = dealt.select("rep", "copies", "v", "signs", "own", *keys, tile.alias("tile"), F.least("own", "other").alias("t1"), F.greatest("own", "other").alias("t2"))
    made: dict = {}

    def compare(key: tuple, tile: pa.Table) -> pa.Table:
        dims, j = key[0].as_py(), key[1].as_py()
        made.setdefault(dims, directions(dims, m, bits))
        unit = unit_rows(by_length(tile.column("v"), stored)[0].reshape(-1, dims))
        line = unit @ made[dims][0]
        packed = np.frombuffer(b"".join(tile.column("signs").to_pylist()), np.uint8).reshape(len(unit), -1)
        cells = cells_of(np.unpackbits(packed, axis=1, count=m * bits) if bits else packed, m, bits)
        rep, side, copies, cell = (tile.column(c).to_numpy() for c in ("rep", "own", "copies", "cell"))
        if key[3].as_py() != key[4].as_py() and side.min() == side.max():  # by chance, a chunk got nothing
            links, pairs = np.zeros(len(rep), np.int64), np.zeros((2, 0), np.int64)
        else:
            links, pairs = sweep(j, cell, side, line, cells, unit, copies, window, threshold, cosine)
        some = np.flatnonzero(links)
        found = pa.table({"rep": pa.array(rep[some]), "links": pa.array(links[some]), "other": pa.nulls(len(some), pa.int64())})
        joined = pa.table({"rep": pa.array(rep[pairs[0]]), "links": pa.array(np.zeros(pairs.shape[1], np.int64)), "other": pa.array(rep[pairs[1]])})
        return pa.concat_tables([found, joined])

    return tiles.groupBy("dims", "j", "tile", "t1", "t2").applyInArrow(compare, "rep long, links long, other long")


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """key, n_links, component_id and kept of every row of ``df``."""
    usable_row = usable(F.col(vector)) & F.exists(vector, lambda x: x != 0) & F.col(key).isNotNull()
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(usable_row, F.lit(False)).alias("ok"))
    good = rows.where("ok").select("id", "v")
    distinct = settle(good.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).select("rep", "copies", "v"))
    parts = settle(near_links(distinct, distinct.count(), cosine, recall))
    links = parts.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connect(parts.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    found = distinct.join(links, "rep", "left").join(components, F.col("rep") == F.col("node"), "left")
    found = found.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.join(found, "v").select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicate_embeddings(embeddings: DataFrame) -> DataFrame:
    """The ``op1`` result."""
    return near_duplicates(embeddings)
