"""Exact top-k search by columnar branch and bound.

Candidates are packed into blocks held vertically, a band of ``BAND`` dimensions
after another.  For a query, scores are accumulated band by band; after each
one, candidates whose partial score plus the most that the remaining dimensions
can add (product of the remaining norms) is below a floor are dropped and the
survivors compacted.  The floor is a k-th best exact score found so far: at
first against ``PIVOTS`` candidates drawn by hash (the same for all queries,
searched first), then, after each band, of the best partial scores.

Queries are packed into blocks too, with their floors, and every pair of a
candidate and a query block is a row of one join on the pair: neither side is
broadcast or collected, whatever the number of queries.  Blocks grow with the
table up to ``BLOCK`` and ``QUERIES``, so that few copies of each are sent.  A
pair returns at most k rows for each query, and those are ranked once more.

Scores are exact integers: components are floor(``SCALE`` * x), computed and
multiplied as doubles as long as no sum can reach 2**53, else as Python
integers (a score over 63 bits is an error).

Defined cases: vectors that are null or hold null or non-finite components, or
have no id, take no part; vectors are scored against those of their own length
only; rows repeating an id are candidates each, never for their own id, and one
query (the least vector); fewer than k candidates give fewer rows; an empty
table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

SCALE = 1024
#: Vectors and queries in a block: at least and at most so many, in between a share of all.
LEAST, BLOCK, QUERIES = 1024, 1 << 15, 1 << 13
SHARE = 12
PIVOTS = 2048
BAND = 16


def usable(vector: Column) -> Column:
    """Not null and of finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


class Vertical:
    """A block of integer vectors in bands of dimensions."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids = ids
        order = np.argsort(ids, kind="stable")  # ties go to smaller ids
        self.ids, vectors = ids[order], vectors[order]
        self.dims = vectors.shape[1]
        self.bands = [np.ascontiguousarray(vectors[:, d : d + BAND]) for d in range(0, self.dims, BAND)]
        squares = [np.square(b).sum(1) for b in self.bands]
        rest = np.cumsum([np.zeros(len(ids)), *squares[::-1]], axis=0)[::-1][1:]
        self.rest = np.sqrt(rest)  # norms of what follows each band
        self.most = float(np.abs(vectors).max(initial=0.0))
        self.vectors = vectors

    def top(self, own: int, query: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best but the query's own id; those below ``floor`` may be left out."""
        at = np.flatnonzero(self.ids != own)
        if self.dims * self.most * float(np.abs(query).max(initial=0.0)) >= 2.0**53:
            exact = [sum(int(a) * int(b) for a, b in zip(v, query)) for v in self.vectors[at].tolist()]
            best = sorted(range(len(at)), key=lambda i: -exact[i])[:k]
            return self.ids[at[best]], np.array([exact[i] for i in best], np.int64)
        tails = np.sqrt(np.cumsum([0.0, *[np.square(query[d : d + BAND]).sum() for d in range(0, self.dims, BAND)][::-1]])[::-1][1:])
        score = np.zeros(len(at))
        for b, band in enumerate(self.bands):
            part = query[b * BAND : (b + 1) * BAND]
            score = score + band[at] @ part
            if b == len(self.bands) - 1 or len(at) <= k:
                continue
            if len(at) > 4 * k:
                some = at[np.argpartition(score, len(score) - 4 * k)[-4 * k :]]
                floor = max(floor, np.sort(self.vectors[some] @ query)[-k])
            most = score + self.rest[b][at] * (tails[b] * (1 + 1e-9)) + 1
            stay = most >= floor
            at, score = at[stay], score[stay]
        if len(at) > k:
            kth = np.partition(score, len(score) - k)[-k]
            stay = score >= kth
            at, score = at[stay], score[stay]
        best = np.argsort(-score, kind="stable")[:k]
        return self.ids[at[best]], score[best].astype(np.int64)


def integers(items: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scaled vectors (doubles holding integers) of a packed block."""
    ids = items.values.field("id").to_numpy(zero_copy_only=False)
    flat = items.values.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return ids, np.floor(SCALE * flat).reshape(len(ids), -1 if len(flat) else 0)


def search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows (items, asked with floors) -> query ids, ids and scores of each pair of blocks."""
    for batch in batches:
        for items, asked in zip(batch.column(0), batch.column(1)):
            block = Vertical(*integers(items))
            floors = asked.values.field("floor").to_numpy(zero_copy_only=False).astype(np.float64)
            found = [(own, *block.top(own, query, k, -np.inf if np.isnan(floor) else floor)) for own, query, floor in zip(*integers(asked), floors)]
            query_ids = np.repeat(np.array([own for own, *_ in found], np.int64), [len(ids) for _, ids, _ in found])
            yield query_ids, *(np.concatenate([np.empty(0, np.int64), *(x[i] for x in found)]) for i in (1, 2))


def top_k(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10) -> DataFrame:
    """query_id, rank (from 1), ``key`` and score of each query's k best candidates."""
    rows = df.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.size(vector).alias("dims"), F.coalesce(is_query, F.lit(False)).alias("q"))
    n, n_queries = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("q").cast("int")), F.lit(0))).first()
    per_block = lambda m, most: max(1, -(-m // min(most, max(LEAST, m // SHARE))))
    n_blocks, n_query_blocks = per_block(n, BLOCK), max(1, -(-n_queries // QUERIES))
    deal = lambda m: F.pmod(F.xxhash64("id", "v"), F.lit(m)).cast("int")
    pack = F.collect_list(F.struct("id", "v"))
    blocks = settle(rows.groupBy("dims", deal(n_blocks).alias("b")).agg(pack.alias("items")))
    asked = settle(rows.where("q").groupBy("dims", "id").agg(F.min("v").alias("v")))

    def found(items: DataFrame, floored: DataFrame, n_items: int) -> DataFrame:
        """(dims, b, items) and (dims, id, v, floor) -> (query_id, id, score), k of each pair of blocks at most."""
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        queries = floored.groupBy("dims", deal(n_query_blocks).alias("a")).agg(F.collect_list(F.struct("id", "v", "floor")).alias("asked"))
        pairs = items.withColumn("a", every(n_query_blocks)).join(settle(queries).withColumn("b", every(n_items)), ["dims", "a", "b"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for columns in search(batches, k):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "id", "score"])

        return pairs.select("items", "asked").mapInArrow(run, "query_id long, id long, score long")

    chosen = rows.where(F.pmod(F.xxhash64("v", F.lit("pivot")), F.lit(max(1, n // PIVOTS))) == 0)
    pivots = chosen.select("dims", "id", "v").orderBy(F.xxhash64("id", "v"), "id").limit(PIVOTS).groupBy("dims").agg(pack.alias("items")).withColumn("b", F.lit(0))
    no_floor = F.lit(None).cast("long").alias("floor")
    first = found(pivots, asked.select("dims", "id", "v", no_floor), 1).groupBy("query_id").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("floor"))
    floors = first.where(F.col("c") >= k).select(F.col("query_id").alias("id"), "floor")
    best = found(blocks, asked.join(floors, "id", "left").select("dims", "id", "v", "floor"), n_blocks)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def search_embeddings(embeddings: DataFrame) -> DataFrame:
    """The ``op5`` result: queries are the rows whose id is divisible by 100."""
    return top_k(embeddings, F.col("vec_id") % 100 == 0)
