"""The conversation trie against a plain one in Python."""

import hashlib
import math
import zlib
from collections import defaultdict

import pytest
from lacuna.llm import trie
from pyspark.sql import functions as F

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(turns)] for c, turns in convs.items()}


def rebuilt(convs):
    heads = {c: zlib.crc32(str(c).encode()) % 9 for c in convs}
    return {c: convs.get(c - int(math.fmod(c, 5)), [])[: heads[c]] + convs[c][heads[c] :] for c in convs}


def plain(convs):
    members, children, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, those in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(those) - 1) * len(path[-1][1].encode()) if path else 0
    ends = lambda path: ",".join(str(c) for c in sorted(members[path]) if len(convs[c]) == len(path))
    rows = [(min(those), len(path), min(members[path[:-1]]) if path else None, len(those), children[path], leaves[path], saved[path], hashlib.sha256(ends(path).encode()).hexdigest()) for path, those in members.items()]
    return sorted(rows, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("x"), "c": F.lit(1), "n": F.lit(2), "_part": F.lit(3)})


SHARED = [(c, t, "user" if t % 2 else "assistant", f"é turn {t}" if t < 3 + c % 4 else f"own {c} {t}") for c in range(40) for t in range(c % 9)]


@pytest.mark.parametrize(
    "rows",
    [
        SHARED,
        [(c, t, "user", "same text") for c in range(60) for t in range(4)],  # copies of one conversation
        [(None, 1, "user", "a"), (3, None, "user", "first"), (3, 1, None, None), (3, 2, "user", ""), (8, 0, "user", "x"), (8, 1, "user", "x"), (-7, 0, "user", "neg")],
        [(7, 0, "user", "a"), (11, 0, "user", "b" * 100_000), (13, 5, "", "")],
        [],
    ],
    ids=["shared", "copies", "nulls", "few", "empty"],
)
def test_rebuilt(spark, rows):
    assert got(trie.rebuilt_trie(frame(spark, rows))) == plain(rebuilt(sequences(rows)))


def test_as_they_are(spark):
    rows = SHARED + [(100 + c, t, "user", f"deep {t}") for c in range(3) for t in range(300 + c)]  # longer than a key range
    assert got(trie.conversation_trie(frame(spark, rows))) == plain(sequences(rows))


def test_long_conversation_is_cut_into_ranges(spark):
    rows = spark.range(4000).select(F.lit(5).cast("long").alias("k"), "id").unionByName(spark.range(100).select((F.col("id") + 6).alias("k"), F.col("id")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = trie.in_ranges(rows.repartition(4), "k", "id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dealt.where("k = 5").select("_part").distinct().count() > 1
    sums = trie.running(dealt, "k", [F.col("id").asc()], {"s": (F.col("id"), "sum"), "x": (F.col("id"), "xor")})
    want, s, x = {}, 0, 0
    for i in range(4000):
        s, x = s + i, x ^ i
        want[i] = (s, x)
    assert {r["id"]: (r["s"], r["x"]) for r in sums.where("k = 5").collect()} == want
    assert sums.where("k > 5 and (s <> id or x <> id)").isEmpty()


def test_ties_and_repeated_rows(spark):
    rows = [(10, 1, "user", "a"), (10, 1, "user", "b"), (10, 1, "user", "a"), (10, 2, "user", "c")]
    out = trie.conversation_trie(frame(spark, rows)).orderBy("depth").collect()
    assert [r["depth"] for r in out] == [0, 1, 2, 3, 4]
    again = trie.conversation_trie(frame(spark, rows[::-1])).orderBy("depth").collect()
    assert out == again


def test_lists_longer_than_a_piece(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 7)
    ends = spark.range(500).select(*(F.lit(0).cast("long").alias(x) for x in trie.NODE), (F.col("id") * 3).alias("c"))
    assert trie.id_lists(ends).first()["ends_sha256"] == hashlib.sha256(",".join(str(3 * i) for i in range(500)).encode()).hexdigest()
