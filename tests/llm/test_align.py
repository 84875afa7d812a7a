"""Alignment against token spans compared pair by pair on whole texts."""

import hashlib
from collections import Counter

import pytest
from lacuna.llm import align

TEXTS = [
    "the cat sat on the mat",
    "The cat  sat\n\n on\tthe mat. ",
    " leading and trailing  ",
    "naïve café, über-groß 北京 🙂🙂 ﬁ ①",
    "<|endoftext|> <s> </s> <unk> <0x41> it's we'll x'S",
    "a▁b marks",
    "ends in ▁",
    "",
    None,
    " ",
    "\n",
    "x",
    "nul \x00 and \x1c control\x85 signs　wide   blank",
    "12 345 6,789.01 -- !!! ...   ??",
    "the cat sat on the mat",
    "word " * 400 + "antidisestablishmentarianism",
    "é combining ​ zero width",
    "nospace" * 300,
]


def spans(ids, size):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + size[i]))
        at += size[i]
    return out


def plain(texts):
    tokens = align.Tokenizers()
    docs = []
    for text in texts:
        a, b = (tokens.a.encode(" " + text, add_special_tokens=False).ids, tokens.b.encode(text)) if text else ([], [])
        if text and not tokens.spell(text, a, b):
            a, b = [], []
        sa, sb = spans(a, {i: len(tokens.bytes_a[i]) for i in a}), spans(b, {i: len(tokens.bytes_b[i]) for i in b})
        links = [(x, y) for x, s, e in sa for y, p, q in sb if s < q and p < e]
        both = sorted({e for _, _, e in sa} & {e for _, _, e in sb})
        groups, start = [], 0
        for end in both:
            inside = lambda those: ",".join(str(i) for i, s, e in those if start <= s and e <= end)  # noqa: E731, B023
            groups.append(f"{inside(sa)}|{inside(sb)}")
            start = end
        docs.append((len(a), len(b), links, groups))
    counts = Counter(x for d in docs for x in d[2])
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    rows = [(na, nb, len(g), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for na, nb, links, g in docs]
    return rows, counts, [";".join(g) or None for *_, g in docs]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture
def docs(frame):
    return frame([(k, t, "en", "s") for k, t in enumerate(TEXTS)]).selectExpr("*", "1 as chunk", "2 as items", "'k' as key").repartition(3)


def test_documents(docs):
    rows, counts, groups = plain(TEXTS)
    assert rows[5] == (0, 0, 0, 0, 0, 0, "") and rows[0][0] > 0
    made = align.Alignment(docs)
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in made.documents().collect()} == dict(enumerate(rows))
    assert {(r["a"], r["b"]): r["count"] for r in made.pairs().collect()} == counts
    assert {r["doc_id"]: r["groups"] for r in align.groups(docs).collect()} == dict(enumerate(groups))


def test_many_chunks_and_blocks(docs, monkeypatch):
    """Small chunks, long texts in parts and a forgetful transducer change nothing."""
    for name, value in (("PARTS", 5), ("BLOCK", 40), ("TRANSITIONS", 10)):
        monkeypatch.setattr(align, name, value)
    rows, _, groups = plain(TEXTS)
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in align.align_documents(docs).collect()} == dict(enumerate(rows))
    assert {r["doc_id"]: r["groups"] for r in align.groups(docs).collect()} == dict(enumerate(groups))


def test_whole_texts(docs, monkeypatch):
    """Tokenizers that can't be cut at blanks."""
    monkeypatch.setattr(align.Tokenizers, "separable", lambda self: False)
    rows, _, _ = plain(TEXTS)
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in align.align_documents(docs).collect()} == dict(enumerate(rows))


def test_null_and_repeated_keys(frame):
    rows = [(None, "one two", "en", "s"), (None, "one two", "en", "s"), (4, "one two", "en", "s"), (4, "three", "en", "s")]
    got = sorted(((r["doc_id"] or 0, r["n_links"]) for r in align.align_documents(frame(rows)).collect()))
    want, _, _ = plain([r[1] for r in rows])
    assert got == sorted((r[0] or 0, w[3]) for r, w in zip(rows, want))


def test_empty_table(frame):
    assert align.align_documents(frame([])).collect() == []
    assert align.align_documents(frame([(1, "", "en", "s"), (2, None, "en", "s")])).select("n_a", "groups_sha256").distinct().collect() == [(0, "")]


def test_transducer_remembers():
    machine = align.Transducer([b" ab", b"c", b"d e"], [b" a", b"bcd", b" e"])
    links = []
    assert machine.walk([0, 1, 2], [0, 1, 2], links) == ("0,1,2|0,1,2", 1)
    assert [(x >> 32, x & 0xFFFF) for x in links] == [(0, 0), (0, 1), (1, 1), (2, 1), (2, 2)]
    seen = len(machine.memo)
    assert machine.walk([0, 1, 2] * 5, [0, 1, 2] * 5, [])[1] == 5
    assert len(machine.memo) == seen == 6
    with pytest.raises(ValueError, match="different bytes"):
        machine.walk([0, 1], [0, 2], [])


def test_faster_library_gives_the_same_ids():
    tokens = align.Tokenizers()
    assert tokens.fast
    texts = [f"{x}{y} {z}{x}" for x in ("é", "it's", "1a", "--", "Ab", "\n\t") for y in ("", "'ll", "²", "ÿ", "\x85") for z in ("q", "'S", "00", "ɏ", "\x1d")]
    assert all(max(t) < align.AFTER_LATIN for t in texts)
    assert tokens.encode(texts)[0] == [x.ids for x in tokens.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_short_parts_are_encoded_and_walked_together(monkeypatch):
    """A part costs no call of its own, unless it is long (op11_align took 1,519 CPU seconds a GB when each did)."""
    tokens, calls = align.Tokenizers(), []
    monkeypatch.setattr(tokens, "separable", lambda: True)
    encode, walk = tokens.fast, align.Transducer.walk
    monkeypatch.setattr(tokens, "fast", lambda text: calls.append("encoded") or encode(text))
    monkeypatch.setattr(align.Transducer, "walk", lambda *a: calls.append("walked") or walk(*a))
    align.Builder(tokens, 0).documents([" ".join(f"wörd{k} x{k}y" for k in range(at, at + 100)) for at in range(0, 1000, 100)] + ["nospace" * 300])
    assert calls.count("encoded") <= 10 and calls.count("walked") == 1


def test_steps_of_all_parts_at_a_time(monkeypatch):
    tokens = align.Tokenizers()
    parts = sorted({p for t in TEXTS if t for p in align.SEAM.split(t)} | {"x" * k for k in range(1, 90)} | {f"é{k}'ll 🙂{k}" for k in range(300)})
    monkeypatch.setattr(align, "JOINED", 7)
    for separable in (True, False):
        chunk = align.Chunk(tokens, align.Transducer(tokens.bytes_a, tokens.bytes_b), separable)
        assert chunk.numbers([parts]).tolist() == list(range(len(parts)))
        machine, at, all_links = align.Transducer(tokens.bytes_a, tokens.bytes_b), 0, align.np.concatenate(chunk.links)
        for part, text, sizes in zip(parts, chunk.texts, chunk.sizes.tolist()):
            (a,), (b,) = tokens.encode([part])
            links = []
            groups, n = machine.walk(a, b, links) if tokens.spell(part, a, b) else (None, 0)
            assert sizes == ([1, len(a), len(b), n, len(links)] if groups else [0] * 5) and text.decode() == (groups + ";" if groups else "")
            assert all_links[at : at + len(links)].tolist() == links
            at += len(links)
        assert at == len(all_links) and 0 < sum(chunk.sizes[:, 0]) < len(parts)
