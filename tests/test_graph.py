"""Mining, merging, splits and scores on small graphs worked out by hand or by plain Python."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from pyspark.sql import functions as F

from lacuna import session
from lacuna.operators import anni, dataset, matrix, mine, neighbours, score
from lacuna.plans.fixtures import Graph


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def pairs(spark, data, schema="x long, y long, n long"):
    return spark.createDataFrame(data, schema)


def test_merges(spark):
    got = matrix.merge_pairs(pairs(spark, [(1, 4, 8), (2, 7, 4), (1, 4, 9), (3, 6, 1)]))
    assert rows(got) == [(1, 4, 17), (2, 7, 4), (3, 6, 1)]
    assert rows(matrix.merge_counts(spark.createDataFrame([(1, 8), (2, 4), (1, 9), (3, 1)], "x long, n long"))) == [(1, 17), (2, 4), (3, 1)]
    assert rows(matrix.merge_scalars(spark.createDataFrame([(8,), (4,), (9,), (1,)], "n long"))) == [(22,)]


def test_transforms(spark):
    m = pairs(spark, [(0, 1, 3), (1, 1, 5)])
    assert rows(matrix.mirror(m)) == [(0, 1, 3), (1, 0, 3), (1, 1, 5), (1, 1, 5)]
    assert rows(matrix.fill_diagonal(m, 2)) == [(0, 0, 1), (0, 1, 3), (1, 1, 1)]
    assert rows(matrix.binarize(m)) == [(0, 1, 1), (1, 1, 1)]
    got = {(r.x, r.y): r.n for r in matrix.transform(m, values="log").collect()}
    assert got[0, 1] == pytest.approx(math.log(4))


def test_mining_counts(spark):
    units = [(1, 2000, [1, 2, 3]), (2, 2000, [1, 2]), (3, 2001, [2]), (4, 2001, [])]
    mentions = spark.createDataFrame([(u, y, t) for u, y, ts in units for t in ts + ts[:1]], "unit long, year int, t long")
    assert rows(mine.cooccurrences(mentions)) == [(2000, 1, 2, 2), (2000, 1, 3, 1), (2000, 2, 3, 1)]
    assert rows(mine.occurrences(mentions)) == [(2000, 1, 2), (2000, 2, 2), (2000, 3, 1), (2001, 2, 1)]
    tagged = spark.createDataFrame([(y, 1, [t]) for _, y, t in units], "year int, n_sentences int, term_sets array<array<long>>")
    kinds = mine.split_records(mine.mined_records(tagged))
    assert rows(matrix.merge_pairs(kinds["COOCCURRENCE"], "year")) == rows(mine.cooccurrences(mentions))
    assert rows(matrix.merge_counts(kinds["OCCURRENCE"], "year")) == rows(mine.occurrences(mentions))
    assert rows(matrix.merge_scalars(kinds["SENTENCECOUNT"])) == [(4,)]


def random_graph(seed=5, ids=25, years=(2000, 2001, 2002, 2003)):
    rnd = random.Random(seed)
    counts = Counter()
    for year in years:
        for _ in range(60):
            for x, y in itertools.combinations(sorted(set(rnd.choices(range(ids), k=3))), 2):
                counts[year, x, y] += 1
    return [(y, a, b, n) for (y, a, b), n in counts.items()]


def test_holdout_is_the_growing_set_year_by_year(spark):
    data = random_graph()
    co = spark.createDataFrame(data, "year int, x long, y long, n long")
    known = dataset.known_pairs(co, 2001)
    ids = matrix.ids_of(known)
    accepted = {r.x for r in ids.collect()}
    tracked = {(r.x, r.y) for r in known.collect()}
    expected = []
    for year in (2002, 2003):
        new = [(year, x, y, n) for w, x, y, n in data if w == year and x in accepted and y in accepted and (x, y) not in tracked]
        expected += new
        tracked |= {(x, y) for _, x, y, _ in new}
    assert rows(dataset.holdout(co, ids, 2001, later=True)) == sorted(expected)
    assert dataset.check_cooccurrences(dataset.holdout(co, ids, 2001, later=True), ids, known).isEmpty()
    assert not dataset.check_cooccurrences(known, ids, known).isEmpty()


def test_negatives_are_unknown_pairs(spark):
    ids = spark.range(30).withColumnRenamed("id", "x")
    truth = pairs(spark, [(1, 2, 1), (9, 4, 1)])
    for size in (50, 300):  # few of all pairs, most of them
        got = rows(dataset.negatives(ids, truth, size), "x", "y", "n")
        assert len(got) == len(set(got)) == size
        assert all(0 <= x < y < 30 and n == 0 and (x, y) not in {(1, 2), (4, 9)} for x, y, n in got)
        assert got == rows(dataset.negatives(ids, truth, size), "x", "y", "n")
    assert dataset.negatives(ids.limit(0), truth, 5).isEmpty()


@pytest.mark.parametrize("wanted", [14, 100])
def test_negatives_are_as_many_as_there_can_be(spark, wanted):
    ids = spark.range(6).withColumnRenamed("id", "x")
    got = rows(dataset.negatives(ids, pairs(spark, [(5, 0, 1), (0, 5, 2), (0, 99, 1)]), wanted), "x", "y")
    assert got == [p for p in itertools.combinations(range(6), 2) if p != (0, 5)]


def test_draws_go_on_until_there_are_enough(spark, monkeypatch):
    monkeypatch.setattr(dataset, "DRAWS", 1)  # a first round that can't do
    got = rows(dataset.negatives(spark.range(20).withColumnRenamed("id", "x"), pairs(spark, [(0, 1, 1)]), 90), "x", "y")
    assert len(set(got)) == 90 and (0, 1) not in got


def test_draw_is_the_head_of_the_hash_order(spark):
    data = [(i % 40, i) for i in range(500)]
    df = pairs(spark, data, "x long, y long")
    order = sorted(data, key=lambda p: (hashlib.md5(f"{p[0]}_{p[1]}_draw".encode()).hexdigest(), p))
    for size in (0, 1, 77, 500, 900):
        assert sorted(rows(dataset.draw(df, size))) == sorted(order[:size])


def plain_scores(co, occ, x, z):
    n, near = {}, defaultdict(set)
    for a, b, c in co:
        n[a, b] = n[b, a] = c
        near[a].add(b)
        near[b].add(a)
    shared = near[x] & near[z]
    strength = lambda v, w: n[v, w] / min(occ[v], occ[w])
    either = near[x] | near[z]
    amw = sum(min(n[x, y], n[y, z]) for y in shared) / len(shared) if shared else 0
    return {
        "factaplus": 1 - math.prod(1 - strength(x, y) * strength(y, z) for y in shared),
        "bitola": sum(n[x, y] * n[y, z] for y in shared),
        "arrowsmith": len(shared),
        "jaccard": len(shared) / len(either) if either else 0.0,
        "prefattach": len(near[x]) + len(near[z]),
        "amw": amw,
        "ltc_amw": len(shared) + 0.001 * amw,
    }


@pytest.mark.parametrize("sizes", [(1 << 21, 1 << 16, 1 << 18, 1 << 21), (40, 20, 3, 7)], ids=["one tile", "small tiles, cut lists"])
def test_scores_against_plain_python(spark, monkeypatch, sizes):
    for name, size in zip(("BLOCK", "TILE", "LIST", "AT_ONCE"), sizes):
        monkeypatch.setattr(neighbours, name, size)
    co = [(a, b, n) for y, a, b, n in random_graph(years=(2000,))]
    occ = Counter()
    for a, b, n in co:
        occ[a] += n
        occ[b] += n
    cand = list(itertools.combinations(range(27), 2))[::3]
    got = score.score_all(spark.createDataFrame(cand, "x long, y long"), pairs(spark, co), spark.createDataFrame(list(occ.items()), "x long, n long")).collect()
    assert len(got) == len(cand)
    for r in got:
        expected = plain_scores(co, occ, r.x, r.y)
        for m in score.METHODS:
            assert r[m] == pytest.approx(expected[m], abs=1e-9), (m, r)
    for m in ("arrowsmith", "jaccard", "prefattach", "bitola"):  # by themselves, without what others need
        alone = {(r.x, r.y): r.score for r in score.score(spark.createDataFrame(cand, "x long, y long"), pairs(spark, co), None, m).collect()}
        assert alone == pytest.approx({(r.x, r.y): r[m] for r in got})


def test_amw_over_the_limit_is_an_error(spark):
    co = pairs(spark, [(1, 3, 1000), (2, 3, 5000)])
    occ = spark.createDataFrame([(1, 9000), (2, 9000), (3, 9000)], "x long, n long")
    with pytest.raises(Exception, match="AMW"):
        score.score_all(spark.createDataFrame([(1, 2)], "x long, y long"), co, occ).collect()


@pytest.mark.parametrize("sizes", [(256, 256, 1 << 18), (3, 4, 10)], ids=["one tile", "small tiles"])
def test_sparse_anni_is_the_dense_product(spark, monkeypatch, sizes):
    for name, size in zip(("COUNTS", "IDS", "PAIRS"), sizes):
        monkeypatch.setattr(anni, name, size)
    co = [(a, b, n) for y, a, b, n in random_graph(years=(2000,), ids=20)]
    occ = {i: 3 + 2 * i for i in range(20)}
    total = 120
    n = {(a, b): c for a, b, c in co} | {(b, a): c for a, b, c in co}
    seen = sorted({i for pair in n for i in pair})

    def plogp(c):
        return -c / total * math.log(c / total) if c > 0 else 0.0

    def u(i, j):
        h = plogp(occ[i]) + plogp(total - occ[i]) + plogp(occ[j]) + plogp(total - occ[j])
        c = n.get((i, j), 0)
        joint = plogp(c) + plogp(occ[j] - c) + plogp(occ[i] - c) + plogp(total - occ[j] - occ[i])
        return (h - joint) / (0.5 * h) if h else 0.0

    cand = list(itertools.combinations(seen, 2))[::5]
    got = anni.score_anni(spark.createDataFrame(cand, "x long, y long"), pairs(spark, co), spark.createDataFrame(list(occ.items()), "x long, n long"), total).collect()
    assert len(got) == len(cand)
    for r in got:
        assert r.anni == pytest.approx(sum(u(r.x, y) * u(r.y, y) for y in seen), abs=1e-9)


def test_results_ignore_row_order_and_orientation(spark):
    co = [(a, b, n) for y, a, b, n in random_graph(years=(2000,))]
    occ = spark.createDataFrame([(i, 50) for i in range(25)], "x long, n long")
    cand = spark.createDataFrame([(0, 5), (3, 9)], "x long, y long")
    one = rows(score.score_all(cand, pairs(spark, co), occ))
    two = rows(score.score_all(cand, pairs(spark, [(b, a, n) for a, b, n in reversed(co)]), occ))
    assert [tuple(round(v, 9) for v in r) for r in one] == [tuple(round(v, 9) for v in r) for r in two]


def test_titles_and_links(spark):
    df = spark.createDataFrame([("ltc_amw",), ("SVD_43",), ("other",)], "method string")
    assert [r[0] for r in df.select(score.title()).collect()] == ["LTC-AMW", "SVD", "other"]
    got = score.shared_links(1, 2, pairs(spark, [(1, 3, 4), (2, 3, 5), (1, 7, 1)]))
    assert rows(got) == [(3, 4, 5)]


@pytest.mark.parametrize("sizes", [(1 << 23, 4096, 1024, 1 << 22), (60, 5, 3, 20)], ids=["at once", "few common concepts, small steps"])
def test_pairs_of_large_sets_are_summed_many_sets_at_once(spark, monkeypatch, sizes):
    for name, size in zip(("ENTRIES", "COMMON", "SETS", "STEP"), sizes):
        monkeypatch.setattr(mine, name, size)
    rnd = random.Random(3)
    units = [(rnd.choice([2000, 2001]), sorted(rnd.sample(range(30), rnd.choice([0, 1, 2, 5, 25])))) for _ in range(80)]
    expected = Counter((y, a, b) for y, ts in units for a, b in itertools.combinations(ts, 2))
    made = mine.pair_sums(spark.createDataFrame(units, "year int, terms array<long>"))
    assert rows(made, "year", "x", "y", "n") == sorted((*k, n) for k, n in expected.items())
    sets = [ts for _, ts in units if len(ts) > 1]
    parts = list(mine.counted(np.concatenate([np.array(ts) for ts in sets]), np.array([len(ts) for ts in sets])))
    if len(parts) == 1:
        assert len(parts[0][0]) == len({p for ts in sets for p in itertools.combinations(ts, 2)})  # a row for each pair, not for each set's pairs


def test_cells_without_shared_neighbours_get_nothing(spark, monkeypatch):
    """Two graphs apart: lists and pairs of one aren't sent to tiles of both."""
    for name, size in (("BLOCK", 20), ("TILE", 100)):
        monkeypatch.setattr(neighbours, name, size)
    near = [(a + far, b + far, 1) for far in (0, 1000) for a, b in itertools.combinations(range(12), 2) if (a + b) % 3]
    adjacency = matrix.mirror(pairs(spark, near))
    met = []
    broadcast = neighbours.F.broadcast
    monkeypatch.setattr(neighbours.F, "broadcast", lambda df: met.append(df) or broadcast(df))
    asked = pairs(spark, [(a, b) for a in range(12) for b in range(1000, 1012)] + [(a, b) for a, b in itertools.combinations(range(12), 2)], "x long, y long")
    got = {(r.x, r.y): r.links for r in neighbours.shared_sums(asked, adjacency, (neighbours.LINKS,)).collect()}
    n = {(a, b) for a, b, _ in near} | {(b, a) for a, b, _ in near}
    expected = {(x, y): sum((x, z) in n and (y, z) in n for z in range(12)) for x, y in itertools.combinations(range(12), 2)}
    assert got == {p: v for p, v in expected.items() if v}
    tiles = {(r.i, r.j) for r in met[0].collect()}
    blocks = max(j for _, j in tiles) + 1
    assert len(tiles) < blocks * (blocks + 1) // 2


@pytest.mark.parametrize("share", [0.0, None])
def test_negatives_look_at_a_share_of_the_order_only(spark, monkeypatch, share):
    ids, truth = spark.range(400).withColumnRenamed("id", "x"), pairs(spark, [(1, 2, 1)])
    whole = rows(dataset.negatives(ids, truth, 900), "x", "y")
    monkeypatch.setattr(dataset, "_first_share", lambda *_: 1.0 if share is None else share)  # none at first, or all
    assert rows(dataset.negatives(ids, truth, 900), "x", "y") == whole and len(whole) == 900


def test_mentions_are_dealt_by_rows(spark, monkeypatch):
    """Tasks of mining grow in number with the items; adaptive execution doesn't put them together again."""
    monkeypatch.setattr(session, "ROWS", 500)
    mentions = Graph(spark, "/root/testdata/sf0.001").mentions
    rows = mentions.count()
    parts = mentions.groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(parts) == -(-rows // 500) and max(r["count"] for r in parts) < 3 * 500


def test_scores_at_rest_write_and_send_no_more_than_needed(spark):
    """The same scores with nothing copied; degrees are joined for the methods that use them only, lists hold what the sums need."""
    co = pairs(spark, [(1, 2, 3), (1, 3, 1), (2, 3, 2), (3, 4, 5), (2, 4, 1), (4, 5, 2)])
    occ = spark.createDataFrame([(1, 4), (2, 6), (3, 8), (4, 8), (5, 2)], "x long, n long")
    cand = spark.createDataFrame([(1, 4, 1), (1, 5, 0), (2, 5, 0), (3, 5, 1)], "x long, y long, class int")
    whole = rows(score.score_all(cand, co, occ), "x", "y", *score.METHODS)
    kept = score.score_all(cand, co, occ, at_rest=True, keep=("class",))
    assert rows(kept, "x", "y", *score.METHODS) == whole and rows(kept, "x", "y", "class") == rows(cand)
    for at, m in enumerate(score.METHODS):
        one = score.score(cand, co, occ, m, at_rest=True)
        assert rows(one) == [(*r[:2], r[2 + at]) for r in whole]
        plan = one._jdf.queryExecution().optimizedPlan().toString()
        assert ("dx#" in plan) == (m in ("jaccard", "prefattach"))
    folder, adjacency = session.shared_folder(spark), matrix.mirror(co)
    before = len(list(Path(folder.removeprefix("file:")).iterdir()))
    score.score(cand, co, None, "arrowsmith", at_rest=True).collect()
    assert len(list(Path(folder.removeprefix("file:")).iterdir())) == before
    links = neighbours.shared_sums(cand.select("x", "y"), adjacency.drop("n").withColumn("n", F.lit(None).cast("long")), (neighbours.LINKS,))
    assert sorted((r.x, r.y, r.links) for r in links.collect()) == [(1, 4, 2), (2, 5, 1), (3, 5, 1)]


def test_sums_come_in_rounds(spark, monkeypatch):
    """Tiles that don't fit one round are written by rounds, each with whole tiles; sums are those of one round, near or far, cut or not."""
    near = [(a + far, b + far, a % 3 + 1) for far in (0, 1000, 2000) for a, b in itertools.combinations(range(14), 2) if (a + b) % 3]
    near += [(5, 1005, 2), (5, 1006, 1), (1005, 2001, 3)]
    adjacency = matrix.mirror(pairs(spark, near)).withColumn("d", F.lit(0.5) / F.col("n"))
    asked = pairs(spark, [(a, b) for a in range(14) for b in range(a + 1, 14)] + [(a, b) for a in range(14) for b in range(1000, 1014)] + [(1004, 1009), (1005, 2002), (7, 2003)], "x long, y long")
    every = (neighbours.LINKS, neighbours.PRODUCT, neighbours.LEAST, neighbours.APART)
    sorted_rows = lambda: sorted((r.x, r.y, r.links, r.product, r.least, r.apart) for r in neighbours.shared_sums(asked, adjacency, every).collect())
    whole = sorted_rows()
    assert whole
    folder = Path(session.shared_folder(spark).removeprefix("file:"))
    for patched in ({"ROUND": 60, "TILE": 100}, {"ROUND": 60, "BLOCK": 30, "LIST": 4}, {"ROUND": 200, "BLOCK": 30, "NEAR": 0, "TILE": 40}):
        with monkeypatch.context() as m:
            for name, size in patched.items():
                m.setattr(neighbours, name, size)
            before = len(list(folder.iterdir()))
            got = sorted_rows()
            assert [r[:5] for r in got] == [r[:5] for r in whole], patched
            assert [r[5] for r in got] == pytest.approx([r[5] for r in whole], rel=1e-12)
            assert len(list(folder.iterdir())) > before + 1


def test_what_is_settled_keeps_no_shuffle(spark):
    blocks = lambda: [b for b in map(str, spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|").split("|")) if "shuffle_" in b]
    before = len(blocks())
    kept = session.settled(spark.range(1000).repartition(4, "id"))
    assert len(blocks()) <= before and kept.count() == 1000
    assert spark.conf.get(session.CLEANUP) == "false"


def test_one_split_sums_pairs_once(spark):
    """The same known pairs, ids, test pairs and candidates without a table of every year."""
    whole, one = Graph(spark, "/root/testdata/sf0.001", at_rest=True), Graph(spark, "/root/testdata/sf0.001", one_split=True)
    assert rows(one.known(), "x", "y", "n") == rows(whole.known(), "x", "y", "n")
    assert rows(one.testing(), "year", "x", "y") == rows(whole.testing(), "year", "x", "y")
    assert rows(one.candidates()) == rows(whole.candidates())
    assert not any(name == "cooccurrence" for name, _ in one.done)


def test_negatives_are_drawn_in_parts(spark, monkeypatch):
    ids, truth = spark.range(400).withColumnRenamed("id", "x"), pairs(spark, [(1, 2, 1)])
    whole = rows(dataset.negatives(ids, truth, 900), "x", "y")
    monkeypatch.setattr(dataset, "DRAWN", 1000)
    assert rows(dataset.negatives(ids, truth, 900), "x", "y") == whole and len(whole) == 900


def test_concept_scores_come_in_slices(spark, monkeypatch):
    co = pairs(spark, [(1, 2, 3), (1, 3, 1), (2, 3, 2), (3, 4, 5), (2, 4, 1), (4, 5, 2)])
    occ = spark.createDataFrame([(1, 4), (2, 6), (3, 8), (4, 8), (5, 2)], "x long, n long")
    cand = pairs(spark, [(a, b) for a, b in itertools.combinations(range(1, 6), 2)], "x long, y long")
    scores = lambda: [(r.x, r.y, round(r.anni, 12)) for r in anni.score_anni(cand, co, occ, 100).orderBy("x", "y").collect()]
    whole = scores()
    monkeypatch.setattr(anni, "SLICE", 3)
    assert scores() == whole and len(whole) == 10
