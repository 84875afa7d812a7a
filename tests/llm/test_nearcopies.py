"""Near copies of the pipeline's stage against brute-force Jaccard similarities."""

import random
import re

import pytest

import corpus_pipeline
from lacuna.llm import mixing, nearcopies, simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def corpus():
    rnd = random.Random(11)
    out = ["", None, " \n", "one", "ONE", "a b c d e f g h", "a b c d e f g h i"]
    for _ in range(60):
        words = [f"w{rnd.randrange(500)}" for _ in range(rnd.randint(30, 300))]
        out.append(" ".join(words))
        for n in range(rnd.randint(0, 3)):  # edits spread over the text: similarities on both sides of 0.8
            other = list(words)
            for at in rnd.sample(range(len(words)), max(1, len(words) * (n + 1) // 60)):
                other[at] = "zz"
            out.append(" ".join(other))
    return out


def groups(sets):
    comp = list(range(len(sets)))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for _ in comp:
        for i, j in pairs:
            comp[i] = comp[j] = min(comp[i], comp[j])
    return comp, pairs


def test_columns_of_any_kind(spark, frame):
    """Maps and names with dots; blocks of few shingles."""
    rows = [(i, " ".join(f"w{j}" for j in range(40)) + (f" x{i}" if i else ""), "en", "s") for i in range(6)] + [(9, "all by itself here it is", "en", "s")]
    docs = frame(rows).selectExpr("*", "map('k', doc_id) as m", "array(named_struct('v', map(doc_id, 'x'))) as deep")
    kept = nearcopies.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 9]
    mixed = mixing.mixed_rows(docs).collect()
    assert mixed and all(r["m"] == {"k": r["doc_id"]} for r in mixed)


def test_blocks_by_shingles(spark, frame, monkeypatch):
    monkeypatch.setattr(nearcopies, "SHINGLES", 60)
    rng = random.Random(5)
    base = [f"w{j}" for j in range(60)]
    texts = []
    for _ in range(25):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = f"z{rng.randrange(9)}"
        texts.append(" ".join(words))
    kept, _ = groups([plain(t) for t in texts])
    assert {r["doc_id"] for r in nearcopies.one_of_each_group(frame([(i, t, "en", "s") for i, t in enumerate(texts)])).collect()} == set(kept)


@pytest.mark.parametrize("block", [nearcopies.BLOCK, 2])
def test_stage_drops_near_copies_of_five_words(spark, frame, monkeypatch, block):
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    texts = corpus()
    comp, pairs = groups([plain(t) for t in texts])
    apart = [(simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > 3 for i, j in pairs]
    assert sum(apart) > 10  # what three words and 3 bits leave
    df = frame([(i, t, "en", "s") for i, t in enumerate(texts)])
    out = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(comp))


def test_ids_missing_or_repeated(spark, frame):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a, "en", "s"), (5, a, "en", "s"), (5, b, "en", "s"), (None, a + " x", "en", "s"), (None, "alone", "en", "s"), (None, "alone", "de", "s")]
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, frame(rows), "").collect()), key=str)
    assert got == sorted([(5, a), (5, b), (None, "alone")], key=str)


def test_no_rows(spark, frame):
    assert corpus_pipeline.drop_near_duplicates(spark, frame([]), "").collect() == []
