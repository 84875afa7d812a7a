"""SimHash groups against a plain recomputation."""

import random
import re

import numpy as np
import pytest
import xxhash

from lacuna.llm import simhash
from lacuna.llm.components import connect


def plain(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = ["", None, " \t\n", "One", "one", "a b", "A B c", "a b c d", "É b\u00a0c d\x1ce", "x " * 5000]


def corpus():
    rnd = random.Random(3)
    out = list(TEXTS)
    for _ in range(120):
        words = [rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(rnd.randint(30, 200))]
        out.append(" ".join(words))
        for _ in range(rnd.randint(0, 3)):
            other = list(words)
            other[rnd.randrange(len(other))] = "zz"
            out.append(" ".join(other))
    return out


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_blocks_of_hashes(monkeypatch):
    text = " ".join(f"w{i % 91}" for i in range(1000))
    monkeypatch.setattr(simhash, "HASHED_AT_ONCE", 64)
    assert simhash.fingerprint(text) == plain(text)


@pytest.mark.parametrize("chunk", [None, 16])
def test_groups_against_brute_force(spark, frame, monkeypatch, chunk):
    if chunk:
        monkeypatch.setattr(simhash, "LEAST", chunk)
    texts = corpus()
    df = frame([(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, texts[20], "en", "s"), (3, "One", "en", "s")])
    rows = simhash.deduplicate_documents(df).collect()
    assert len(rows) == len(texts) + 2
    fps = np.array([plain(t) for t in texts], np.uint64)
    comp = np.arange(len(texts))
    while True:
        new = np.array([comp[np.bitwise_count(fps ^ f) <= 3].min() for f in fps])
        if (new == comp).all():
            break
        comp = new
    for r in rows:
        i = 20 if r.doc_id is None else r.doc_id
        assert r.fingerprint == f"{fps[i]:016x}" and r.component_id == comp[i]


def test_tiles_find_every_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << int(rng.integers(64))) for _ in range(6)]]))
    counts = np.stack([np.bitwise_count(fps), *(np.bitwise_count(fps >> np.uint64(16 * i) & np.uint64(0xFFFF)) for i in range(4))], 1)
    forest = simhash.tile_forest((counts, fps[:, None]), None)
    label = forest.label
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    comp = np.arange(len(fps))
    while True:
        new = np.array([comp[n].min() for n in near])
        if (new == comp).all():
            break
        comp = new
    assert len(set(zip(label.tolist(), comp.tolist()))) == len(set(label.tolist())) == len(set(comp.tolist()))
    a, b = forest.pairs()
    assert near[a, b].all() and len(a) == len(fps) - len(set(comp.tolist()))


def test_rows_without_key_link_others(spark):
    """a and c are 4 words of bits apart only through b, which has no key; ids repeat with other texts."""
    rnd = random.Random(4)
    words = [f"w{rnd.randrange(900)}" for _ in range(400)]
    chain = [" ".join(words)]
    while len(chain) < 40:
        words = list(words)
        words[rnd.randrange(len(words))] = f"z{len(chain)}"
        chain.append(" ".join(words))
    fps = [plain(t) for t in chain]
    near = lambda x, y: (x ^ y).bit_count() <= 3
    a, b, c = next((i, j, k) for i in range(40) for j in range(i, 40) for k in range(j, 40) if near(fps[i], fps[j]) and near(fps[j], fps[k]) and not near(fps[i], fps[k]))
    far = "something else entirely, in seven words here"
    rows = [(9, chain[a]), (None, chain[b]), (4, chain[c]), (4, far), (None, "alone in the world")]
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.deduplicate_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    name = lambda t: f"{plain(t):016x}"
    assert got == {(9, name(rows[0][1])): 4, (None, name(rows[1][1])): 4, (4, name(rows[2][1])): 4, (4, name(far)): 4, (None, name("alone in the world")): None}


def test_components(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, 201 + i) for i in range(30)]
    got = {r.node: r.component for r in connect(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {v: v for e in edges for v in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {v: c for v, c in label.items() if v != c}
    assert connect(spark.createDataFrame([], "a long, b long")).collect() == []


def test_empty(frame):
    assert simhash.deduplicate_documents(frame([])).collect() == []
