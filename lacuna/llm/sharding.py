"""Consistent-hash ring with virtual nodes and bounded loads (native).

Every shard owns ``vnodes`` points of a ring of ``cells`` cells.  A row falls
into a cell by the hash of its key, of its tie columns and of its number among
equal rows, so rows that repeat a key (or have none) are spread, and belongs to
the shard whose point comes next, clockwise.  A shard holds at most its
capacity; rows that find it full go on to the next *distinct* shard clockwise.
Rows are admitted in rounds (first choices before second choices, and so on) and
in hash order within a round, so the outcome depends on nothing but the rows and
the parameters.

Capacities add up to exactly the number of rows and differ by one at most, so
the law that holds is ``rows``: shard counts are at most one apart.  Adding a
shard only moves the rows of the arcs it takes over and the overflow that the
smaller capacities push on.

The admission runs on counts per cell (``cells`` rows, a constant), never on
rows: a round is a running sum per shard over the cells.  Rows meet the result
in one join on the cell, which is also the partitioning of the ranking window,
so rows are shuffled once, without their texts.

Equal rows are counted, never ranked: they are written out again from the count.

Defined cases: a null key hashes as the text ``null``; equal rows are
interchangeable; an empty table gives no rows; columns ``shard`` and ``slot`` of
the input are replaced by the result's, all others stay.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Settled, id_text, repeated, settle

#: Cells of the ring.  A constant, so the admission table never grows with the data.
CELLS = 1 << 14


def ring_points(n_shards: int, vnodes: int, cells: int) -> list[list[int]]:
    """Cells of the virtual nodes of each shard; only names decide them."""

    def point(shard: int, replica: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"shard-{shard}/{replica}".encode(), digest_size=8).digest()) % cells

    return [[point(s, r) for r in range(vnodes)] for s in range(n_shards)]


def preferences(cell: Column, n_shards: int, vnodes: int, cells: int) -> Column:
    """Shards in the order in which their next point follows ``cell`` clockwise."""
    ways = []
    for shard, points in enumerate(ring_points(n_shards, vnodes, cells)):
        steps = F.transform(F.array(*map(F.lit, points)), lambda p: F.pmod(p - cell, F.lit(cells)))
        ways.append(F.struct(F.array_min(steps).alias("way"), F.lit(shard).alias("shard")))
    return F.transform(F.array_sort(F.array(*ways)), lambda x: x["shard"])


def capacities(n_rows: int, n_shards: int) -> list[int]:
    """As equal as can be; their sum is ``n_rows``."""
    return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]


def admit(counts: DataFrame, n_shards: int, vnodes: int, cells: int) -> DataFrame:
    """Admission by cell: ``counts`` (cell, n) -> (_cell, parts of rank intervals).

    A part is (lo, n, shard, slot): the keys of ranks lo..lo+n-1 in the cell go
    to ``shard`` and take the slots from ``slot`` on.
    """
    state = Settled(counts.select("_cell", F.lit(0).cast("long").alias("_lo"), F.col("n").cast("long").alias("_n"), preferences(F.col("_cell").cast("int"), n_shards, vnodes, cells).alias("_pref")))
    total = state.df.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    room = capacities(total, n_shards)
    filled = [0] * n_shards
    accepted, left = [], total
    for turn in range(n_shards):
        if not left:
            break
        as_array = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
        shard = F.element_at("_pref", turn + 1)
        before = F.sum("_n").over(Window.partitionBy("_shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
        tried = state.df.where(F.col("_n") > 0).withColumn("_shard", shard).withColumn("_before", F.coalesce(before, F.lit(0)))
        free = F.element_at(as_array([r - f for r, f in zip(room, filled)]), F.col("_shard") + 1)
        took = F.greatest(F.lit(0).cast("long"), F.least(F.col("_n"), free - F.col("_before")))
        slot = F.element_at(as_array(filled), F.col("_shard") + 1) + F.col("_before")
        done = Settled(tried.withColumn("_took", took).withColumn("_slot", slot))
        accepted.append(done.df.where("_took > 0").select("_cell", F.struct(F.col("_lo").alias("lo"), F.col("_took").alias("n"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot")).alias("part")))
        for s, n in done.df.groupBy("_shard").agg(F.sum("_took")).collect():  # a row for each shard
            filled[s] += n
        left = total - sum(filled)
        if left:
            state = Settled(done.df.select("_cell", (F.col("_lo") + F.col("_took")).alias("_lo"), (F.col("_n") - F.col("_took")).alias("_n"), "_pref"))
    if not accepted:
        return state.df.select("_cell", F.expr("cast(array() as array<struct<lo:bigint,n:bigint,shard:int,slot:bigint>>)").alias("parts"))
    parts = accepted[0]
    for more in accepted[1:]:
        parts = parts.unionByName(more)
    return parts.groupBy("_cell").agg(F.collect_list("part").alias("parts"))


def bounded_ring(df: DataFrame, key: str, ties: list[str] | None = None, n_shards: int = 8, vnodes: int = 64, cells: int = CELLS) -> DataFrame:
    """``df`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard).

    ``df`` should hold narrow columns only, of kinds that can be grouped; it is
    written to the shared folder, so the source is scanned once.  ``ties`` tell
    rows of one key apart.
    """
    names = [c for c in df.columns if c not in ("shard", "slot")]
    inner = {c: f"_in_{i}" for i, c in enumerate(names)}  # no name can clash
    bits = cells.bit_length() - 1
    equal = df.select(*(F.col(c).alias(x) for c, x in inner.items())).groupBy(*inner.values()).agg(F.count(F.lit(1)).alias("_n"))
    hashed = F.xxhash64(id_text(F.col(inner[key])), *(inner[c] for c in ties or []), "_number")
    rows = repeated(settle(equal), "_n", "_number").withColumn("_hash", hashed)
    rows = settle(rows.select(*inner.values(), "_number", "_hash", F.shiftrightunsigned("_hash", 64 - bits).cast("int").alias("_cell")))
    parts = admit(rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")), n_shards, vnodes, cells)
    order = [F.col("_hash"), *(F.col(x) for x in inner.values()), F.col("_number")]
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_cell").orderBy(*order)).cast("long") - 1)
    part = F.element_at(F.filter("parts", lambda p: (F.col("_rank") >= p["lo"]) & (F.col("_rank") < p["lo"] + p["n"])), 1)
    placed = ranked.join(parts, "_cell").withColumn("_part", part)
    return placed.select(*(F.col(x).alias(c) for c, x in inner.items()), F.col("_part.shard").alias("shard"), (F.col("_part.slot") + F.col("_rank") - F.col("_part.lo")).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """The ``op4`` digest: shards of documents under the law ``rows``."""
    narrow = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    placed = bounded_ring(narrow, "doc_id", ["size", "text_crc32"], n_shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))
