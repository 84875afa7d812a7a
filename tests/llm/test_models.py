"""URL filter, language identification and toxicity: held-out accuracy and edge cases."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from lacuna.llm import langid, toxicity, url_lm

SF = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identify_documents(docs).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_language_edge_cases(frame):
    data = [(i, "the cat and the dog were here", "en", "s") for i in range(30)] + [(100 + i, "der hund und die katze waren hier", "de", "s") for i in range(30)]
    data += [(200, None, "en", "s"), (201, "", None, "s"), (202, "12 34 !?", "en", "s"), (203, "und der hund " * 30000, None, "s"), (None, "the dog", "en", "s"), (5, "the cat and the dog were here", "en", "s")]
    df = frame(data)
    got = {r.doc_id: r for r in langid.identify_documents(df).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (200, 201, 202))
    assert got[203].lang_pred == "de" and got[None].lang_pred == "en" and got[None].held_out is False
    assert {r.lang_pred for r in langid.identify_documents(df.selectExpr("doc_id", "text", "cast(null as string) lang", "source")).collect()} == {"und"}
    assert langid.identify_documents(frame([])).collect() == []
    kept = langid.keep_identified(df)
    assert kept.columns == df.columns and not {r.doc_id for r in kept.collect()} & {200, 201, 202}


def plain_grams(text):
    """Counts of n-grams by plain string handling."""
    signs = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
    line = " " + " ".join(signs.split()) + " "
    out = Counter()
    for n in (1, 2, 3):
        out.update(line[i : i + n] for i in range(len(line) - n + 1))
    return out


def bucket(gram):
    o, mask = [ord(c) for c in gram], (1 << 64) - 1
    n = {1: lambda: o[0], 2: lambda: o[1] + o[0] * 1_000_003, 3: lambda: o[2] + o[1] * 1_000_003 + o[0] * 2_654_435_761_001}[len(gram)]()
    return (n * 0x9E3779B97F4A7C15 & mask) >> 49


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 1 << 20])
def test_grams_are_the_same_in_blocks(monkeypatch, size):
    monkeypatch.setattr(langid, "MOST_AT_ONCE", size)
    grams = langid.Grams()
    for text in ("\u00c1bc, d\u00e9f! \U0001f600 " * 20, "x", "  a", "b  ", "one  two\n\nthree", "\U00010400 deseret"):
        expected = Counter()
        for gram, n in plain_grams(text).items():
            expected[bucket(gram)] += n
        assert dict(zip(*map(np.ndarray.tolist, grams.of(text)))) == dict(expected), text
    assert len(grams.of("\U0001f600 12")[0]) == 0


def test_scores_against_plain_tf_idf(spark):
    rng = np.random.default_rng(5)
    texts = ["the cat and the dog", "der hund und die katze", "le chat et le chien", "Le chien et la vache et le chat", "x"]
    n, df = langid.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"))
    model = langid.Model(["a", "b", "c"], np.log((1 + n) / (1 + df)) + 1, rng.standard_normal((langid.DIMS, 3)), np.array([0.1, 0.2, -0.3]), 0.7)
    got = model.predict(pd.Series(texts))
    for text, lang, score in zip(texts, got.lang, got.score):
        tf = Counter()
        for gram, k in plain_grams(text).items():
            tf[bucket(gram)] += k
        in_texts = {f: sum(f in {bucket(g) for g in plain_grams(t)} for t in texts) for f in tf}
        x = {f: (1 + math.log(k)) * (math.log((1 + len(texts)) / (1 + in_texts[f])) + 1) for f, k in tf.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        logits = [(sum(v / norm * model.weights[f, c] for f, v in x.items()) + model.bias[c]) / 0.7 for c in range(3)]
        chances = [math.exp(z) / sum(map(math.exp, logits)) for z in logits]
        assert lang == "abc"[int(np.argmax(chances))] and score == pytest.approx(max(chances), abs=1e-9)


def test_ftrl_against_plain_steps():
    """One epoch over three rows, weight by weight."""
    data = [(0, np.array([3, 8]), np.array([0.6, 0.8])), (1, np.array([8, 11]), np.array([1.0, 0.5])), (0, np.array([3]), np.array([1.0]))]
    w, bias = langid.fit_ftrl(data, 2, epochs=1)
    p = langid.FTRL
    z, n = Counter(), Counter()

    def weight(f, c):
        l1 = 0.0 if f == "bias" else p["l1"]
        l2 = 0.0 if f == "bias" else p["l2"]
        if abs(z[f, c]) <= l1:
            return 0.0
        return -(z[f, c] - math.copysign(l1, z[f, c])) / ((p["beta"] + math.sqrt(n[f, c])) / p["alpha"] + l2)

    for i in np.random.default_rng(7).permutation(3).tolist():
        y, at, x = data[i]
        row = [*zip(at.tolist(), x.tolist()), ("bias", 1.0)]
        now = {(f, c): weight(f, c) for f, _ in row for c in (0, 1)}
        logits = [sum(v * now[f, c] for f, v in row) for c in (0, 1)]
        chances = [math.exp(s) / sum(map(math.exp, logits)) for s in logits]
        for c in (0, 1):
            for f, v in row:
                g = v * (chances[c] - (c == y))
                z[f, c] += g - (math.sqrt(n[f, c] + g * g) - math.sqrt(n[f, c])) / p["alpha"] * now[f, c]
                n[f, c] += g * g
    for c in (0, 1):
        assert bias[c] == pytest.approx(weight("bias", c), abs=1e-12)
        assert {f: w[f, c] for f in np.flatnonzero(w[:, c]).tolist()} == pytest.approx({f: weight(f, c) for f in (3, 8, 11) if weight(f, c)}, abs=1e-12)


def test_many_languages_are_all_learned(frame):
    rng = np.random.default_rng(2)
    stems = {f"l{i}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3)) for _ in range(4)] for i in range(230)}
    rows = [(i * 300 + k, " ".join(rng.choice(s, 12)), name, "s") for i, (name, s) in enumerate(stems.items()) for k in range(12)]
    got = langid.identify_documents(frame(rows)).collect()
    assert len({r.lang_pred for r in got}) > 220


def test_ftrl_gives_sparse_weights():
    rng = np.random.default_rng(0)
    data = []
    for i in range(300):
        y = i % 2
        at = np.unique(np.append(rng.integers(0, 500, 20), 1000 + y))
        data.append((y, at, np.ones(len(at)) / np.sqrt(len(at))))
    w, b = langid.fit_ftrl(data, 2)
    assert (w == 0).mean() > 0.9
    assert np.mean([np.argmax(x @ w[at] + b) == y for y, at, x in data]) > 0.99


def toxic_frame(spark, frame):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        text = list(rng.choice(words, rng.integers(20, 120)))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(5):
                text[rng.integers(len(text))] = "qwizz" + str(rng.choice(["er", "ling", "ard", "o", "ek", "um"]))
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, 1, int(toxic)))
    return frame(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark, frame):
    docs, labels = toxic_frame(spark, frame)
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == 600
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    hit = sum(r.predicted for r in held if r.doc_id % 5 == 0)
    assert hit >= 0.9 * sum(r.doc_id % 5 == 0 for r in held)
    assert sum(r.predicted for r in held if r.doc_id % 5) <= 0.05 * len(held)
    kept = {r.doc_id for r in toxicity.keep_clean(docs, labels).collect()}
    assert len(kept) < 600 and toxicity.keep_clean(docs, labels).columns == docs.columns


def test_toxicity_edge_cases(spark, frame):
    docs = frame([(1, None, None, None), (2, "", "en", "s"), (3, "word " * 300_000, "en", "s"), (None, "a b", "en", "s"), (3, "again", "en", "s")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score_documents(docs, none).collect()
    assert len(rows) == 5 and all(r.score < 0.01 and r.predicted == 0 for r in rows)
    one = spark.createDataFrame([(3, 1, 1), (None, 1, 0), (9, 0, None)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.score_documents(docs, one).collect())
    assert toxicity.score_documents(frame([]), none).collect() == []


def test_score_against_plain_recomputation():
    rng = np.random.default_rng(9)
    model = toxicity.Model(rng.standard_normal(toxicity.BUCKETS), -0.3, 1.7, 0.4)

    def bucket(gram):
        h = 0
        for c in gram:
            h = h * 1_000_003 + ord(c)
        return (h * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 48

    def word(w):
        w = "<" + re.sub(r"^\W+|\W+$", "", w) + ">"
        grams = [w[i : i + n] for n in (3, 4, 5, 6) for i in range(len(w) - n + 1)] + [w]
        return sum(model.bucket[bucket(g)] for g in grams) / len(grams)

    for text in ("", "one", "Two words!", "a b c d e", "-- ab ??", "The quick (brown) f\u00f6x jumps over 3 lazy dogs, and so on until the end."):
        words = text.lower().split()
        size = min(4, len(words))
        first = sorted({*range(0, max(1, len(words) - 4), 2), max(0, len(words) - 4)})
        means = {a: sum(map(word, words[a : a + size])) / size for a in first} if words else {}
        logit = 0.0
        if means:
            best = max(means, key=means.get)
            logit = (means[best] + max((v for a, v in means.items() if abs(a - best) >= size), default=means[best])) / 2
        expected = 1 / (1 + math.exp(-(1.7 * (logit - 0.3) + 0.4)))
        assert model.scores(pd.Series([text]), {})[0] == pytest.approx(expected, abs=1e-9), text


def test_training_step_against_plain_gradients():
    """A step of the joint training moves every parameter as numeric gradients of the loss say."""
    trainer = toxicity.Trainer([["ab", "cd", "ef", "gh"], ["ab", "xy"]], np.array([1, 0]), seed=3)
    rows, labels = np.arange(len(trainer.windows)), trainer.doc[np.arange(len(trainer.windows))] ^ 1
    names = ["ab", "cd", "ef", "gh", "xy"]

    def loss(table, soft, bias):
        total = 0.0
        for window, y in zip(trainer.windows[rows], labels):
            vectors = [np.mean([table[b] for b in toxicity.subwords([names[w]])[0]], 0) for w in window if w >= 0]
            out = np.mean(vectors, 0) @ soft + bias
            total -= out[y] - np.log(np.exp(out).sum())
        return total / len(rows)

    before = [x.copy() for x in (trainer.table, trainer.soft, trainer.bias)]
    trainer.step(rows, labels)
    for d in range(2):
        moved = [x.copy() for x in before]
        moved[2][d] += 1e-6
        g = (loss(*moved) - loss(*before)) / 1e-6
        assert trainer.bias[d] - before[2][d] == pytest.approx(-toxicity.RATE * g / math.sqrt(1e-6 + g * g), abs=1e-4)
    bucket_ab = int(toxicity.subwords(["ab"])[0][0])
    g = []
    for d in range(toxicity.DIMS):
        moved = [x.copy() for x in before]
        moved[0][bucket_ab, d] += 1e-6
        g.append((loss(*moved) - loss(*before)) / 1e-6)
    step = -toxicity.RATE * np.array(g) / math.sqrt(1e-6 + np.square(g).mean())
    assert trainer.table[bucket_ab] - before[0][bucket_ab] == pytest.approx(step, abs=1e-3)


def test_long_texts_are_learned_whole(spark, frame):
    """The only toxic words stand at the end of very long texts."""
    rows = [(i, "plain words of all kinds " * 3000 + ("qwizzer qwizzling qwizzard qwizzo" if i % 2 else "more plain words here"), "en", "s") for i in range(1, 41)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 41)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_documents(frame(rows), labels).collect()}
    assert got == {i: i % 2 for i in range(1, 41)}


def test_clashing_columns_stay(spark):
    rows = [(i, "the cat and the dog", "en", "s", i, "x") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score long, row string").selectExpr("*", "'y' as _toxicity", "'z' as p", "'l' as _language")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    for kept in (langid.keep_identified(docs), toxicity.keep_clean(docs, labels)):
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.collect()))


def test_windows_cover_the_text():
    for n in range(1, 40):
        first = toxicity.starts(n)
        covered = {w for s in first for w in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n))


URLS = [
    ("https://www.x.org/a", "www.x.org", "/a", "org/", "allow"),
    ("http://a.example.org/es/1?q", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("HTTP://EXAMPLE.ORG/en/12#top", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("https://shop.com/fr/x", "shop.com", "/fr/x", "com/fr/", "allow"),
    ("https://shop.com/de/x", "shop.com", "/de/x", "com/de/", "block"),
    ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("https://x.org", "x.org", "", None, None),
    ("https://x.org?u=/a", "x.org", "", None, None),
    ("no scheme.org/", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("a://b://c/d", "b:", "//c/d", None, None),
]


def test_hosts_and_rules(spark):
    df = spark.createDataFrame([(i, u[0], "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: r for r in url_lm.judge_pages(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), URLS[i]
        assert got[i].verdict == verdict if verdict else got[i].verdict in ("allow", "block")
    assert url_lm.judge_pages(df.limit(0)).collect() == []


def test_ratio_tells_classes_apart(spark):
    rng = np.random.default_rng(0)
    name = lambda letters: "".join(rng.choice(list(letters), 8))
    rows = [(i, f"https://{name('abcde')}.org/{name('abcde')}") for i in range(400)] + [(1000 + i, f"https://{name('vwxyz')}.com/de/{name('vwxyz')}") for i in range(400)]
    rows += [(2000 + i, f"https://{name('abcde')}.net/{name('abcde')}") for i in range(60)] + [(3000 + i, f"https://{name('vwxyz')}.net/{name('vwxyz')}") for i in range(60)]
    got = {r.page_id: r.verdict for r in url_lm.judge_pages(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert np.mean([got[2000 + i] == "allow" for i in range(60)]) > 0.95
    assert np.mean([got[3000 + i] == "block" for i in range(60)]) > 0.95


def plain_url(url):
    head, mark, rest = (url or "").partition("://")
    text = (rest if mark and rest else head + mark + rest).lower()
    return "".join("0" if c in "123456789" else c for c in text)


def plain_ratio(url, accepted, rejected):
    """Mean log-ratio of two models whose counts are made afresh of lists of URLs."""

    def model(urls):
        cells, contexts = Counter(), Counter()
        for u in urls:
            padded = "\x01" * 5 + plain_url(u) + "\n"
            for i in range(5, len(padded)):
                for k in range(6):
                    cells[padded[i - k : i + 1], k] += 1
                    contexts[padded[i - k : i], k] += 1
        return cells, contexts

    total, padded = 0.0, "\x01" * 5 + plain_url(url) + "\n"
    for (cells, contexts), sign in ((model(accepted), 1), (model(rejected), -1)):
        for i in range(5, len(padded)):
            p = 1 / 256
            for k in range(6):
                p = (cells[padded[i - k : i + 1], k] + 2.0 * p) / (contexts[padded[i - k : i], k] + 2.0)
            total += sign * math.log(p)
    return total / (len(padded) - 5)


@pytest.mark.parametrize("hot", [url_lm.HOT, 1])
def test_ratios_and_threshold_against_plain_models(spark, monkeypatch, hot):
    monkeypatch.setattr(url_lm, "HOT", hot)
    rng = np.random.default_rng(3)
    name = lambda letters: "".join(rng.choice(list(letters), 6))
    rows = [f"https://{name('abcdefv')}.org/{name('abc1')}" for _ in range(60)] + [f"https://{name('vwxyzaé')}.com/de/{name('vwx2')}" for _ in range(60)]
    other = [f"http://{name('abcxyz')}.net/{name('abcxyz')}?Q={i}" for i in range(40)] + ["", None, "http://", rows[0].replace("org", "net") + "/" + "z" * 30_000, "mailto:a"] + [rows[0]] * 3
    df = spark.createDataFrame(list(enumerate(rows + other)), "page_id long, url string").selectExpr("*", "'t' as text", "'k' as key", "1 as fold")
    got = {r.page_id: r for r in url_lm.judge_pages(df).collect()}
    assert len(got) == len(rows + other)
    everything = rows + [rows[0]] * 3
    accepted, rejected = [u for u in everything if ".org/" in u], [u for u in everything if ".com/de/" in u]
    fold = lambda u: zlib.crc32(u.encode()) % 5 == 0
    held = [(plain_ratio(u, [x for x in accepted if not fold(x)], [x for x in rejected if not fold(x)]), u in accepted) for u in everything if fold(u)]
    hist = np.zeros((2, url_lm.BINS))
    for ratio, good in held:
        hist[int(good), min(url_lm.BINS - 1, max(0, int(np.floor((ratio + url_lm.SPAN) * url_lm.BINS / (2 * url_lm.SPAN)))))] += 1
    threshold = url_lm.best_edge(hist)
    for i, u in enumerate(rows + other):
        if got[i].rule is None:
            ratio = plain_ratio(u, accepted, rejected)
            assert got[i].ratio == pytest.approx(ratio, abs=1e-9), u
            assert got[i].verdict == ("allow" if ratio >= threshold else "block")
        else:
            assert got[i].ratio is None


def test_counts_grow_with_the_urls(spark):
    df = spark.createDataFrame([("a.org/x", 1, 0), ("b.com/de/", 0, 1), ("a.org/x", 1, 0)], "text string, accepted int, fold int")
    counts = {(r.kind, r.gram): (r.a0, r.r0, r.a1, r.r1) for r in url_lm.gather(df).collect()}
    assert counts["x0", ""] == (16, 0, 0, 10) and counts["c5", "a.org/"] == (2, 0, 0, 0) and counts["c0", "/"] == (2, 0, 0, 2)


@pytest.mark.parametrize("seen,verdict", [(1, "allow"), (0, "block")])
def test_one_class_only(spark, seen, verdict):
    url = "https://a.org/" if seen else "https://a.com/de/"
    df = spark.createDataFrame([(1, url), (2, "https://x.net/")], "page_id long, url string")
    assert {r.verdict for r in url_lm.judge_pages(df).where("rule is null").collect()} == {verdict}


def test_long_urls_in_proportion(spark):
    """Eight times the length takes far less than the square of it."""
    import time

    def seconds(n):
        urls = ["https://a.org/x", "https://b.com/de/q", "https://c.net/" + "ab3/x" * (n // 5), "https://d.net/q", "https://e.org/yy", "https://f.com/de/w"]
        began = time.time()
        assert len(url_lm.judge_pages(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()) == 6
        return time.time() - began

    seconds(1000)
    assert seconds(400_000) < 8 * seconds(50_000)
