"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its hashed character n-grams (3 to 6, with border marks)
and itself; its vector is their mean, a window's vector the mean of its words',
and a linear softmax over that gives the class.  Embeddings and softmax are
trained jointly in numpy (Adagrad).  Misspellings unseen in training share most
n-grams with what was seen.

A long text dilutes a few words in its average, so texts are averaged in
overlapping windows of ``WINDOW`` words that cover the whole text, and the
document's logit is the mean of its two highest windows that don't overlap
(of its window, if it has one only).  Training knows labels of
documents only: windows of toxic documents start as toxic, and in later rounds
only those stay that score above nearly all windows of clean documents (always
the best one), while clean documents add their highest-scoring windows.  Scores
of n-grams are averaged over the rounds after the first.  A logistic calibration
on sample rows kept out of the training maps the logit to a probability; toxic
rows weigh ``MISSED`` times their share there, as a toxic document missed costs
that much more than a clean one rejected.

The fit runs on the driver, on a sample of at most ``POSITIVES`` + ``NEGATIVES``
labelled rows, drawn by a hash of the id, with their whole texts: in the order of
that hash, as many of either label as ``SAMPLE_BYTES`` hold.  The model is ``BUCKETS`` numbers.  As window logits are means of word scores,
a word is scored once for each task and remembered.

Defined cases: a null or wordless text gets the calibrated score of an empty
window (logit of the bias alone); with no labels, or only one class of them,
every score is the share of toxic labels (0 without labels); an id labelled
more than once is toxic if any label is, and learned with the least of its texts
if it has several; a text that ``SAMPLE_BYTES`` can't hold isn't learned; labels without a document and null labels are ignored; very
long texts are scored in blocks; other columns, whatever their names, stay.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle
from .langid import remainder

BUCKETS = 1 << 16
DIMS = 8
WINDOW = 4
STRIDE = 2
POSITIVES = 1000
NEGATIVES = 1400
GRAMS = (3, 4, 5, 6)
#: UTF-8 bytes of the sample's texts of either label that the driver gets at most; rows are taken whole.
SAMPLE_BYTES = 1 << 26
MISSED = 2.0
ROUNDS = 6
RATE = 0.2
#: Least batches in a round of training.
STEPS = 120
REMEMBERED = 400_000
WORDS_AT_ONCE = 1 << 16
PRIME, GOLDEN = np.uint64(1_000_003), np.uint64(0x9E3779B97F4A7C15)
THRESHOLD = 0.5
EDGES = re.compile(r"^\W+|\W+$")


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of words and of the words themselves, and how many each word has.

    Punctuation at a word's ends doesn't count.  A gram hashes as a polynomial of
    its characters, so all words are hashed at once.
    """
    line = "".join(f"<{EDGES.sub('', w)}>" for w in words)
    size = np.fromiter((len(EDGES.sub("", w)) + 2 for w in words), np.int64, len(words))
    cps = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.cumsum(size)
    first = ends - size
    rest = np.repeat(ends, size) - np.arange(len(cps))  # characters to the end of the word
    owner = np.repeat(np.arange(len(words)), size)
    hashes, owners, h = [], [], np.zeros(len(cps), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h[: max(0, len(cps) - n + 1)] * PRIME + cps[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(rest[: len(h)] >= n)
            hashes.append(h[at])
            owners.append(owner[at])
    power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(int(size.max(initial=0)), PRIME))])
    terms = cps * power[rest - 1]  # the same polynomial over the whole word
    hashes.append(np.add.reduceat(terms, first) if len(words) else np.zeros(0, np.uint64))
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    bucket = ((np.concatenate(hashes) * GOLDEN) >> np.uint64(48)).astype(np.int64)
    return bucket[order], np.bincount(owner, minlength=len(words))


def starts(n: int, stride: int = STRIDE) -> np.ndarray:
    """First words of the windows over ``n`` words; the last window ends the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.unique(np.append(np.arange(0, n - WINDOW, stride), n - WINDOW))


class Model:
    """Score of each bucket, bias of a window and the calibration."""

    def __init__(self, bucket: np.ndarray, bias: float, slope: float, shift: float):
        self.bucket, self.bias, self.slope, self.shift = bucket, bias, slope, shift

    def logit(self, scores: np.ndarray) -> float:
        """Of word scores: the mean of the two highest window means, plus the bias."""
        if not len(scores):
            return self.bias
        sums = np.concatenate([[0.0], np.cumsum(scores)])
        first = starts(len(scores))
        size = min(WINDOW, len(scores))
        means = (sums[first + size] - sums[first]) / size
        best = int(means.argmax())
        others = means[np.abs(first - first[best]) >= size]
        second = others.max() if len(others) else means[best]
        return float(means[best] + second) / 2 + self.bias

    def words(self, words: list[str]) -> np.ndarray:
        """Mean n-gram score of each word."""
        out = np.zeros(len(words))
        for at in range(0, len(words), WORDS_AT_ONCE):
            bucket, size = subwords(words[at : at + WORDS_AT_ONCE])
            out[at : at + WORDS_AT_ONCE] = np.add.reduceat(self.bucket[bucket], np.cumsum(size) - size) / size
        return out

    def logits(self, texts: list[list[str]], known: dict[str, float]) -> list[float]:
        """Of the words of texts; ``known`` remembers word scores."""
        new = list({w for words in texts for w in words if w not in known})
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list({w for words in texts for w in words})
        known.update(zip(new, self.words(new).tolist()))
        return [self.logit(np.fromiter(map(known.__getitem__, words), float, len(words))) for words in texts]

    def scores(self, texts: Iterable[str | None], known: dict[str, float]) -> np.ndarray:
        out: list[float] = []
        block: list[list[str]] = []
        size = 0
        for text in texts:
            block.append(text.lower().split() if text else [])
            size += len(block[-1])
            if size >= WORDS_AT_ONCE:
                out += self.logits(block, known)
                block, size = [], 0
        logits = np.array(out + self.logits(block, known), float)
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -40, 40)))


class Trainer:
    """Joint training of n-gram embeddings and softmax on windows of word numbers."""

    def __init__(self, docs: list[list[str]], toxic: np.ndarray, seed: int = 11):
        self.rng = np.random.default_rng(seed)
        numbers: dict[str, int] = {}
        windows, owner = [], []
        for d, words in enumerate(docs):
            ids = np.array([numbers.setdefault(w, len(numbers)) for w in words] or [-1], np.int32)
            ids = np.append(ids, np.full(max(0, WINDOW - len(ids)), -1, np.int32))
            first = starts(len(words), STRIDE)
            windows.append(ids[first[:, None] + np.arange(WINDOW)])
            owner.append(np.full(len(first), d, np.int32))
        self.windows, self.doc = np.concatenate(windows), np.concatenate(owner)
        self.flat, self.size = subwords(list(numbers))
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.table = self.rng.uniform(-0.1, 0.1, (BUCKETS, DIMS))
        self.soft = self.rng.uniform(-0.1, 0.1, (DIMS, 2))
        self.bias = np.zeros(2)
        self.rounds: list[tuple[np.ndarray, float]] = []
        self.table_sq, self.soft_sq, self.bias_sq = np.full(BUCKETS, 1e-6), np.full((DIMS, 2), 1e-6), np.full(2, 1e-6)

    def step(self, rows: np.ndarray, labels: np.ndarray) -> None:
        windows = self.windows[rows]
        words, inverse = np.unique(windows, return_inverse=True)
        inverse = inverse.reshape(windows.shape)
        real = words >= 0
        size = np.where(real, self.size[words], 0)
        edge = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.at[words], size)
        bucket, owner = self.flat[edge], np.repeat(np.arange(len(words)), size)
        vectors = np.stack([np.bincount(owner, self.table[bucket, d], len(words)) for d in range(DIMS)], 1) / np.maximum(size, 1)[:, None]
        filled = np.maximum((windows >= 0).sum(1), 1)
        hidden = vectors[inverse].sum(1) / filled[:, None]
        out = hidden @ self.soft + self.bias
        p = np.exp(out - out.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(rows)), labels] -= 1
        p /= len(rows)
        g_hidden = p @ self.soft.T / filled[:, None]
        g_soft, g_bias = hidden.T @ p, p.sum(0)
        g_word = np.stack([np.bincount(inverse.ravel(), np.repeat(g_hidden[:, d], WINDOW), len(words)) for d in range(DIMS)], 1) / np.maximum(size, 1)[:, None]
        used, back = np.unique(bucket, return_inverse=True)
        g = np.stack([np.bincount(back, g_word[owner, d], len(used)) for d in range(DIMS)], 1)
        self.table_sq[used] += np.square(g).mean(1)
        self.table[used] -= RATE * g / np.sqrt(self.table_sq[used])[:, None]
        self.soft_sq += np.square(g_soft)
        self.soft -= RATE * g_soft / np.sqrt(self.soft_sq)
        self.bias_sq += np.square(g_bias)
        self.bias -= RATE * g_bias / np.sqrt(self.bias_sq)

    def logits(self) -> np.ndarray:
        bucket = self.table @ (self.soft[:, 1] - self.soft[:, 0])
        word = np.append(np.add.reduceat(bucket[self.flat], self.at[:-1]) / self.size if len(self.size) else np.empty(0), 0.0)
        return word[self.windows].sum(1) / np.maximum((self.windows >= 0).sum(1), 1) + self.bias[1] - self.bias[0]

    def train(self, toxic: np.ndarray, rounds: int = ROUNDS, batch: int = 512) -> None:
        """``toxic``: label of each document."""
        label = toxic[self.doc]
        for turn in range(rounds):
            positive, negative = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
            if turn:
                logits = self.logits()
                best = np.full(len(toxic), -np.inf)
                np.maximum.at(best, self.doc, logits)
                bar = np.quantile(logits[negative], 0.998)
                positive = positive[(logits[positive] > bar) | (logits[positive] >= best[self.doc[positive]])]
                hard = negative[np.argsort(-logits[negative])[: 2 * len(positive)]]
            else:
                hard = negative
            easy = self.rng.choice(negative, min(len(negative), max(2 * len(positive), 4 * batch)), replace=False)
            rows = np.concatenate([positive, easy, hard] if turn else [positive, easy])
            for _ in range(-(-STEPS * batch // len(rows))):  # passes, by the steps a round takes
                rows = self.rng.permutation(rows)
                for a in range(0, len(rows), batch):
                    self.step(rows[a : a + batch], label[rows[a : a + batch]])
            if turn:
                self.rounds.append((self.table @ (self.soft[:, 1] - self.soft[:, 0]), self.bias[1] - self.bias[0]))

    def result(self) -> tuple[np.ndarray, float]:
        """Score of each bucket and bias, averaged over the rounds after the first."""
        return np.mean([b for b, _ in self.rounds], 0), float(np.mean([x for _, x in self.rounds]))


def calibrate(logits: np.ndarray, toxic: np.ndarray, share: float) -> tuple[float, float]:
    """Slope (positive) and shift of a logistic curve, by Newton steps with a little ridge.

    Rows are weighted so that toxic ones make up ``share``, as among all labels, times ``MISSED``.
    """
    weight = np.where(toxic == 1, MISSED * share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    scale = max(1e-9, float(logits.std()))
    x = np.stack([logits / scale, np.ones(len(logits))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ ((p - toxic) * weight) + 0.05 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        w -= np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(max(w[0], 1e-6) / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", positives: int = POSITIVES, negatives: int = NEGATIVES) -> Model:
    """A model of the labelled rows; all of ``labels`` may be learned from."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    order = F.xxhash64(F.col("id").cast("string"), F.lit("toxicity"))
    sample = known.where("toxic = 1").orderBy(order, "id").limit(positives).unionByName(known.where("toxic = 0").orderBy(order, "id").limit(negatives))
    texts = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).where("text is not null")
    sizes = texts.join(F.broadcast(sample), "id").groupBy("id", "toxic").agg(F.max(F.octet_length("text")).alias("size"))
    upto = F.sum("size").over(Window.partitionBy("toxic").orderBy(order, "id"))  # over the sample only
    sample = settle(sizes.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).select("id", "toxic"))
    found = texts.join(F.broadcast(sample), "id").groupBy("id", "toxic").agg(F.min("text").alias("text")).toPandas()  # rows and bytes are bounded by the sample
    found = found.sort_values("id")
    held = np.array([zlib.crc32(f"fold {i}".encode()) % 5 == 0 for i in found.id], bool)
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    return fit_rows(list(found.text), found.toxic.to_numpy(int), held, share)


def fit_rows(texts: list[str], toxic: np.ndarray, held: np.ndarray, share: float) -> Model:
    """A model of texts and labels; those of ``held`` only calibrate it, to a ``share`` of toxic ones."""
    if len(set(toxic)) < 2:
        return Model(np.zeros(BUCKETS), 0.0, 1.0, float(np.log(max(share, 1e-15) / max(1 - share, 1e-15))))
    words = [t.lower().split() for t in texts]
    if len(set(toxic[held])) < 2 or len(set(toxic[~held])) < 2:
        held = np.zeros(len(texts), bool)
    trainer = Trainer([w for w, h in zip(words, held) if not h], toxic[~held])
    trainer.train(toxic[~held])
    model = Model(*trainer.result(), 1.0, 0.0)
    check = held if held.any() else ~held
    logits = np.array(model.logits([w for w, h in zip(words, check) if h], {}))
    model.slope, model.shift = calibrate(logits, toxic[check], share)
    return model


def scored(df: DataFrame, model: Model, text: str) -> DataFrame:
    """(row struct of ``df``, score of each whole text)."""
    shared = df.sparkSession.sparkContext.broadcast(vars(model))  # arrays only: workers need not have this package

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, known = Model(**shared.value), {}
        for texts in batches:
            yield pd.Series(own.scores(texts, known))

    rows = df.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"))
    return rows.select("row", score("text").alias("score"))


def learned(labels: DataFrame) -> DataFrame:
    """Labels that may be learned from: the remainder of the id by 5 isn't 0."""
    return labels.where(remainder(F.col("doc_id"), 5) != 0)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The ``op8`` digest."""
    model = fit(docs, learned(labels))
    rows = scored(docs.select("doc_id", "text"), model, "text").select("row.doc_id", "score")
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents not predicted toxic; columns as in ``docs``."""
    return scored(docs, fit(docs, learned(labels)), "text").where(F.col("score") < THRESHOLD).select("row.*")
