"""Prefix trie of conversations, with what sharing prefixes saves, without climbing the tree.

A node is a distinct sequence of first turns (role, text); a conversation is a
member of every node on its path.  Every node is owned by its smallest member.
Who is smallest at a node is smallest below it too, so a conversation owns a
suffix of its own path and all sums over subtrees become sums over members:

* leaves below a node: members that own the childless node at their end;
* tokens saved below it: tokens of all occurrences minus those of owned ones.
  Of a member whose path is owned from some depth on, the occurrences between the
  node and that depth remain, so it gives max(0, before - above): ``above`` is
  the sum of tokens before the node, ``before`` that before its first owned one.

Owners are one grouped minimum (a window by node would put all members of the
root into one task), sums along a path are windows, and one group-by of prefixes
gives the rest.

A prefix is known by its depth and two running exclusive-ors of hashes of
(position, turn): 128 bits, made by windows of any number of ranges.  Turns are
ordered in key ranges that cut long conversations; a window stays in its range
and gets the totals of earlier ones (``running``), so no conversation, however
long, is one window.  Texts are never sent: a turn is two hashes and a size.

``ends_sha256`` is by definition one hash of all ids in order: ids are sorted in
ranges, joined to pieces of ``PIECE`` ids, and a node's pieces stream through
one hash; a task keeps a piece, never a list.

Defined cases: turns without a conversation id belong to none; a null turn
number comes first; turns of one number are ordered by their hashes, and equal
rows are turns one after the other; null role or text is the empty string; texts
of any length are hashed whole; a conversation without turns is a member of the
root only; an empty table has no nodes; other columns, whatever their names,
never enter the plan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, settle

#: Ids joined to one piece of a node's list.
PIECE = 4096
#: Rebuilding (fixed by the contract): a conversation starts with turns of the first of its five.
FAMILY, HEADS = 5, 9
NODE = ["depth", "a", "b"]


def in_ranges(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """``df`` at rest, with the number of the key range a row is in as ``_part``."""
    return settle(df.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))


def running(dealt: DataFrame, key: str, order: list[Column], sums: dict[str, tuple[Column, str]]) -> DataFrame:
    """``dealt`` (see ``in_ranges``) with running ``sum`` or ``xor`` of columns by ``key``, each row's own included.

    A window covers a key's rows of one range.  Keys that several ranges hold (one
    for each border at most, so they are broadcast) add the totals of earlier ranges.
    """
    how = {"sum": F.sum, "xor": F.bit_xor}
    here = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.withColumns({name: how[kind](value).over(here) for name, (value, kind) in sums.items()})
    edges = dealt.groupBy("_part").agg(F.array_distinct(F.array(F.min(key), F.max(key))).alias("_ends"))
    cut = edges.select(F.explode("_ends").alias(key)).groupBy(key).count().where("count > 1").select(key)
    totals = dealt.join(F.broadcast(cut), key).groupBy(key, "_part").agg(*(how[kind](value).alias(f"_of_{name}") for name, (value, kind) in sums.items()))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "_part", *(F.coalesce(how[kind](f"_of_{name}").over(earlier), F.lit(0)).alias(f"_of_{name}") for name, (_, kind) in sums.items()))
    out = out.join(F.broadcast(offsets), [key, "_part"], "left")
    offset = lambda name: F.coalesce(f"_of_{name}", F.lit(0))
    whole = {name: F.col(name).bitwiseXOR(offset(name)) if kind == "xor" else F.col(name) + offset(name) for name, (_, kind) in sums.items()}
    return out.withColumns(whole).drop(*(f"_of_{name}" for name in sums))


def numbered(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns as (c, at, hi, lo, n): place from 1, two hashes of role and text, UTF-8 bytes of the text; at rest."""
    of = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    slim = df.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.xxhash64(of(role), of(text)).alias("hi"), F.xxhash64(F.lit(1), of(role), of(text)).alias("lo"), F.octet_length(of(text)).cast("long").alias("n"))
    order = [F.col("t").asc_nulls_first(), F.col("hi").asc(), F.col("lo").asc()]
    placed = running(in_ranges(slim.where("c is not null"), "c", *order), "c", order, {"at": (F.lit(1), "sum")})
    return settle(placed.select("c", "at", "hi", "lo", "n"))


def rebuilt(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """(c, own, at, hi, lo, n): the first h turns of the first of each ``family``, then a conversation's own after its first h.

    h is the unsigned crc32 of the decimal id, modulo ``heads``.
    """
    h = F.crc32(F.col("c").cast("string").cast("binary")) % heads
    first = turns.where((F.col("c") % family == 0) & (F.col("at") < heads)).groupBy(F.col("c").alias("first")).agg(F.collect_list(F.struct("at", "hi", "lo", "n")).alias("head"))  # fewer than ``heads`` a list
    members = turns.select("c").distinct().withColumn("h", h).withColumn("first", F.col("c") - F.col("c") % family)
    given = members.join(first, "first").select("c", F.explode(F.filter("head", lambda x: x["at"] <= F.col("h"))).alias("x"))
    given = given.select("c", F.lit(0).alias("own"), "x.at", "x.hi", "x.lo", "x.n")
    return given.unionByName(turns.where(F.col("at") > h).select("c", F.lit(1).alias("own"), "at", "hi", "lo", "n"))


def occurrences(turns: DataFrame) -> DataFrame:
    """(c, own, at, hi, lo, n) -> (c, depth, a, b, pa, pb, n, above) for each turn, at rest: its prefix, the one before, and the bytes before it."""
    order = [F.col("own").asc(), F.col("at").asc()]
    dealt = running(in_ranges(turns, "c", *order), "c", order, {"depth": (F.lit(1), "sum")})
    own = dealt.withColumns({"ha": F.xxhash64("depth", "hi", "lo"), "hb": F.xxhash64(F.lit(1), "depth", "hi", "lo")})
    whole = running(own, "c", [F.col("depth").asc()], {"a": (F.col("ha"), "xor"), "b": (F.col("hb"), "xor"), "upto": (F.col("n"), "sum")})
    return settle(whole.select("c", "depth", "a", "b", F.col("a").bitwiseXOR(F.col("ha")).alias("pa"), F.col("b").bitwiseXOR(F.col("hb")).alias("pb"), "n", (F.col("upto") - F.col("n")).alias("above")))


def id_lists(ends: DataFrame) -> DataFrame:
    """(depth, a, b, c) -> (depth, a, b, ends_sha256) of each node's ids in order, comma-joined."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, out = None, [], []
        for batch in batches:
            for *node, c in zip(*(column.to_pylist() for column in batch.columns)):
                if ids and (node != now or len(ids) == PIECE):
                    out.append((*now, ids[0], ",".join(map(str, ids))))
                    ids = []
                now = node
                ids.append(c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if k == 4 else pa.int64()) for k, x in enumerate(zip(*out))], names=[*NODE, "first", "ids"])
                out = []
        if ids:
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (*now, ids[0])), pa.array([",".join(map(str, ids))])], names=[*NODE, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for batch in batches:
            for *node, _, ids in zip(*(column.to_pylist() for column in batch.columns)):
                if node == now:
                    state.update(b"," + ids.encode())
                    continue
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = node, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if k == 3 else pa.int64()) for k, x in enumerate(zip(*out))], names=[*NODE, "ends_sha256"])
                out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in now), pa.array([state.hexdigest()])], names=[*NODE, "ends_sha256"])

    of_node = "depth long, a long, b long"
    ids = ends.select(*NODE, F.col("c").cast("long")).repartitionByRange(*NODE, "c").sortWithinPartitions(*NODE, "c")
    pieces = ids.mapInArrow(joined, f"{of_node}, first long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, f"{of_node}, ends_sha256 string")


def trie(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of conversations (c) with turns (c, own, at, hi, lo, n): the columns of the ``op13`` digest."""
    each = occurrences(turns)
    last = each.groupBy("c").agg(F.max(F.struct("depth", "a", "b")).alias("end"), F.sum("n").alias("size"), F.count(F.lit(1)).alias("turns"))
    zero = F.lit(0).cast("long")
    paths = settle(conversations.join(last, "c", "left").select("c", *(F.coalesce(f"end.{x}", zero).alias(x) for x in NODE), F.coalesce("size", zero).alias("size"), F.coalesce("turns", zero).alias("turns")))
    root = paths.select("c", *(zero.alias(x) for x in NODE), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), zero.alias("n"), zero.alias("above"))
    members = each.unionByName(root).groupBy(*NODE).agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *(F.min(x).alias(x) for x in ("pa", "pb", "n", "above")))
    members = settle(members)
    children = members.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = settle(members.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)))

    owners = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.min("above").alias("before"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    owned = settle(paths.join(owners, "c", "left").select("c", "turns", F.coalesce("before", "size").alias("before"), F.coalesce("leaf", zero).alias("leaf")))
    along = join_hot(each.select("c", *NODE, "above"), owned, ["c"], "turns").select(*NODE, "above", "before", "leaf")
    along = along.unionByName(owned.select(*(zero.alias(x) for x in NODE), zero.alias("above"), "before", "leaf"))
    sums = along.groupBy(*NODE).agg(F.sum(F.greatest(zero, F.col("before") - F.col("above"))).alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))

    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    below = join_hot(nodes.where("depth > 0"), parents, ["depth", "pa", "pb"], "_n")
    every = below.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = every.join(sums, NODE).join(id_lists(paths), NODE, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(*(F.col(x).cast("long").alias(x) for x in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), F.coalesce("ends_sha256", none).alias("ends_sha256"))


def conversation_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of conversations as they are."""
    turns = numbered(df, conv, turn, role, text)
    return trie(turns.select("c").distinct(), turns.withColumn("own", F.lit(1)))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The ``op13`` digest: the trie of rebuilt conversations."""
    turns = numbered(conversations)
    return trie(turns.select("c").distinct(), rebuilt(turns))
