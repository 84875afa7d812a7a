"""Ring sharding and source mixing: laws, brute force and edge cases."""

import zlib
from collections import Counter, defaultdict

import pytest

from lacuna.llm import mixing, sharding

ROWS = [(i, "w " * (i % 7), "en", f"s{i % 3}" if i % 11 else None) for i in range(300)] + [(5, "same", "en", "s1")] * 4 + [(None, None, None, None), (None, "", None, "s0")]


def check_law(rows, n):
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts[s] for s in range(n)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_hold_the_law(frame):
    rows = sharding.shard_documents(frame(ROWS)).collect()
    assert len(rows) == len(ROWS)
    check_law(rows, 8)
    assert all(r.size == len((t or "").encode()) + 1 for r, t in [(r, next(t for i, t, *_ in ROWS if i == r.doc_id)) for r in rows if r.doc_id not in (5, None)])
    assert {r.text_crc32 for r in rows if r.doc_id == 7} == {zlib.crc32(b"")}
    assert sorted(map(str, rows)) == sorted(map(str, sharding.shard_documents(frame(ROWS[::-1])).collect()))


def brute_ring(counts, n, vnodes, cells):
    """The same admission, key by key."""
    points = sharding.ring_points(n, vnodes, cells)
    prefs = {c: [s for _, s in sorted((min((p - c) % cells for p in points[s]), s) for s in range(n))] for c in counts}
    room = sharding.capacities(sum(counts.values()), n)
    waiting = [(c, k) for c in sorted(counts) for k in range(counts[c])]
    placed, used = {}, [0] * n
    for turn in range(n):
        left = []
        start = list(used)
        for c, k in waiting:
            s = prefs[c][turn]
            if used[s] < room[s]:
                placed[c, k] = (s, used[s])
                used[s] += 1
            else:
                left.append((c, k))
        assert start <= used
        waiting = left
    assert not waiting
    return placed


def test_admission_against_key_by_key(spark):
    counts = {c: (c * 7919) % 13 for c in range(0, 64, 3)}
    df = spark.createDataFrame([(c, n) for c, n in counts.items() if n], "_cell int, n long")
    got = {}
    for r in sharding.admit(df, 5, 8, 64).collect():
        for p in r["parts"]:
            got |= {(r["_cell"], p["lo"] + i): (p["shard"], p["slot"] + i) for i in range(p["n"])}
    assert got == brute_ring({c: n for c, n in counts.items() if n}, 5, 8, 64)


def test_adding_a_shard_moves_few_keys(spark):
    df = spark.range(4000).withColumnRenamed("id", "doc_id")
    of = lambda n: {r.doc_id: r.shard for r in sharding.bounded_ring(df, "doc_id", n_shards=n).collect()}
    a, b = of(8), of(9)
    assert sum(a[i] != b[i] for i in a) < 4000 * 0.5  # dealing anew would move 8 of 9


def test_empty_tables(frame):
    assert sharding.shard_documents(frame([])).collect() == []
    assert mixing.mix_documents(frame([])).collect() == []
    assert mixing.mixed_rows(frame([])).collect() == []


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, capped = share * sum(sizes.values()), {}, set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        weight = sum(w[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * w[s] / weight for s in names}
        over = {s for s in names if s not in capped and target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix_meets_targets(frame):
    rows = mixing.mix_documents(frame(ROWS)).collect()
    assert len(rows) == len(ROWS)
    sizes = Counter()
    for i, t, _, s in ROWS:
        sizes[s] += len((t or "").split())
    target = plain_targets(sizes)
    by_source = defaultdict(int)
    names = {(sizes[s], round(target[s], 6)): s for s in sizes}
    for r in rows:
        s = names[r.source_size, round(r.target, 6)]
        by_source[s] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    assert all(by_source[s] == int(target[s] + 1e-9) for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_documents(frame(ROWS[::-1])).collect()))


def test_a_hot_source_is_spread(frame, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_A_RANGE", 4)
    rows = [(i, "a b c", "en", "hot" if i % 3 else "cold") for i in range(400)]
    got = mixing.mix_documents(frame(rows)).collect()
    target = plain_targets({"hot": 3 * sum(i % 3 > 0 for i in range(400)), "cold": 3 * sum(i % 3 == 0 for i in range(400))})
    assert sum(r.taken for r in got) == sum(map(int, target.values()))


def test_mixed_rows_repeat_documents(frame):
    df = frame([(1, "a b", "en", "a"), (2, "c", "en", "a"), (3, "d e f", "en", "b"), (4, None, "en", "b")])
    taken = {r.doc_id: -(-r.taken // r.size) if r.size else 0 for r in mixing.mix_documents(df).collect()}
    got = mixing.mixed_rows(df)
    assert got.columns == df.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter({k: v for k, v in taken.items() if v})


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10, "d": 1}, {"a": 0, "b": 5}, {None: 7}])
def test_targets_against_the_loop(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "_source string, source_size long")
    got = {r["_source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_repeated_and_keyless_rows_are_spread(frame):
    """A third of the rows have no id, a third are equal: neither makes a large cell, range or source window."""
    rows = [(None, f"t {i}", "en", "s") for i in range(300)] + [(7, "the same text", "en", "s")] * 300 + [(100 + i, "a b", "en", "r") for i in range(300)]
    placed = sharding.shard_documents(frame(rows)).collect()
    assert len(placed) == 900
    check_law(placed, 8)
    for key in (None, 7):
        assert len({r.shard for r in placed if r.doc_id == key}) == 8
    mixed = mixing.mix_documents(frame(rows)).collect()
    assert Counter(r.doc_id if r.doc_id in (None, 7) else 0 for r in mixed) == {None: 300, 7: 300, 0: 300}
    target = plain_targets({"s": 300 * 2 + 300 * 3, "r": 600})
    assert sum(r.taken for r in mixed) == sum(map(int, target.values()))
    used = Counter(r.doc_id if r.doc_id in (None, 7) else 0 for r in mixing.mixed_rows(frame(rows)).collect())
    assert used[7] == sum(-(-r.taken // r.size) for r in mixed if r.doc_id == 7)


def test_repeats_beyond_a_block(spark):
    from lacuna.llm.common import repeated

    got = repeated(spark.createDataFrame([("a", 10), ("b", 3), ("c", 8), ("d", 0)], "k string, n long"), "n", "i", at_once=4).collect()
    assert sorted((r.k, r.i) for r in got) == [(k, i) for k, n in (("a", 10), ("b", 3), ("c", 8)) for i in range(1, n + 1)]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, f"c{i}", 5) for i in range(40)], "doc_id long, _cell string, shard int").selectExpr("*", "'h' as _hash", "1 as _number")
    got = sharding.bounded_ring(df, "doc_id").collect()
    assert {(r.doc_id, r["_cell"], r["_hash"]) for r in got} == {(i, f"c{i}", "h") for i in range(40)}
    check_law(got, 8)
    docs = spark.createDataFrame([(1, "a b", "s", "x"), (2, "c", "s", "y")], "doc_id long, text string, source string, _what string").selectExpr("*", "'k' as _key", "9 as taken", "'r' as _row")
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and {r["_what"] for r in rows.collect()} == {"x", "y"}
