"""Token counts and sampled pieces against the libraries and a brute-force lattice."""

import math
import random
from collections import Counter

import pytest

from lacuna.llm import pieces, tokencount

ALPHABET = ["a", "B", " ", "\n", "'s", "  ", "\x1c", "e\u0301", "é", "Σ", "<|endoftext|>", "!", "9", "\u00a0", "😀", "\r", "\x85", "ß", "İ", "_", "▁", "\x00"]


def texts(n=600, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(40))) for _ in range(n)] + ["", None, "word " * 60000, "x" * 3000, "The quick brown fox's tail."]


def test_counts_are_the_library_s(frame):
    data = texts()
    rows = tokencount.count_documents(frame([(i, t, "en", "s") for i, t in enumerate(data)] + [(None, "a b", "en", "s")])).collect()
    tokenizer = tokencount.load(None)
    assert len(rows) == len(data) + 1
    for r in rows:
        t = "a b" if r.doc_id is None else data[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids))
        assert r.over_limit == (r.n_tokens > 2048)
    assert tokencount.count_documents(frame([])).collect() == []


def test_counts_with_a_small_memory_and_parts(monkeypatch):
    tokenizer = tokencount.load(None)
    data = texts(200)
    expected = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in data]
    monkeypatch.setattr(tokencount, "REMEMBERED", 20)
    monkeypatch.setattr(tokencount, "PART", 1000)
    assert tokencount.Counts(tokenizer).of_texts(data) == expected


@pytest.fixture(scope="module")
def segmenter():
    return pieces.Segmenter(pieces.read_model(pieces.default_path()))


def test_lossless_and_by_row_key_alone(segmenter):
    data = texts()
    ids = segmenter.sample(list(enumerate(data)), 1)
    assert all(t is None if i is None else segmenter.decode(i.tolist()) == t for t, i in zip(data, ids))
    order = list(range(len(data)))[::-1]
    again = segmenter.sample([(k, data[k]) for k in order], 1)
    assert all((a is None and b is None) or a.tolist() == b.tolist() for a, b in zip(again, [ids[k] for k in order]))
    other = segmenter.sample(list(enumerate(data)), 2)
    assert any(a is not None and a.tolist() != b.tolist() for a, b in zip(ids, other))


def test_parts_of_a_long_text(segmenter, monkeypatch):
    text = " ".join(random.Random(1).choices(["the", "then", "  lead", "übung\n", "▁x"], k=3000))
    whole = segmenter.sample([(7, text)], 1)[0].tolist()
    monkeypatch.setattr(pieces, "BLOCK", 500)
    assert segmenter.sample([(7, text)], 1)[0].tolist() == whole
    assert segmenter.decode(whole) == text


@pytest.mark.parametrize("word", ["then", "a b", "éa"])
def test_draws_follow_the_lattice(segmenter, word):
    model = pieces.read_model(pieces.default_path())
    number = {p: i for i, p in model["pieces"].items()}
    marked = pieces.MARK + word.replace(" ", pieces.MARK)
    paths = {}

    def extend(at, path, weight):
        if at == len(marked):
            paths[tuple(path)] = weight
            return
        for end in range(at + 1, len(marked) + 1):
            if marked[at:end] in number:
                i = number[marked[at:end]]
                extend(end, [*path, i], weight + segmenter.weight[i])

    extend(0, [], 0.0)
    total = sum(map(math.exp, paths.values()))
    n = 20000
    drawn = Counter(tuple(i.tolist()) for i in segmenter.sample([(k * 7919, word) for k in range(n)], 1))
    assert set(drawn) <= set(paths)
    for path, weight in paths.items():
        p = math.exp(weight) / total
        assert abs(drawn[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_pieces_of_documents(frame):
    data = texts(40)
    df = frame([(i, t, "en", "s") for i, t in enumerate(data)] + [(None, "a b", "en", "s"), (3, data[3], "en", "s")])
    got = pieces.encode_documents(df)
    rows = got.collect()
    assert len(rows) == len(data) + 2 and all(r.lossless for r in rows)
    assert all((r.pieces is None) == (r.doc_id is not None and data[r.doc_id] is None) for r in rows)
    back = {r.doc_id: r.decoded for r in pieces.decode_pieces(got).collect()}
    assert all(back[i] == t for i, t in enumerate(data))
    assert pieces.encode_documents(frame([])).collect() == []
