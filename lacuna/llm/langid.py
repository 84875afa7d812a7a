"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weighted character n-grams (1 to 3 letters, word borders
included) hashed into ``DIMS`` columns.  Document frequencies cover every
training document; the weights are fitted on the driver, on a sample of about
``ROWS`` labelled documents, or ``LEAST_ROWS`` for each language if that is more
(equal shares, drawn by a hash of id and text), by follow-the-regularised-leader with elastic-net penalties: the L1
part keeps weights at exact zero.  A fifth of the sample is kept out of the fit
for the temperature by which logits are divided.

Whole texts are scored, in every language that a training row names.  The model
is ``DIMS`` x languages numbers, so what is sent to executors grows with the
number of languages and not with the rows.

Defined cases: a null text or one without letters is ``und`` with score 0; with
no labelled training row every text is ``und``; a null id is neither learned
from nor held out; repeated rows get equal results and are learned from once;
very long texts are counted in blocks, with the n-grams of the whole; other
columns, whatever their names, stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text

DIMS = 1 << 15
ROWS = 2400
LEAST_ROWS = 20
EPOCHS = 3
FTRL = {"alpha": 0.5, "beta": 1.0, "l1": 0.002, "l2": 0.001}
UNKNOWN = "und"
MOST_AT_ONCE = 1 << 20
#: The pipeline drops what is ``und`` or less certain than this.
CERTAIN = 0.5


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text, modulo ``by``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % by


class Grams:
    """Counts of hashed character n-grams of letters."""

    def __init__(self):
        table = np.arange(1 << 16, dtype=np.uint32)
        for c in range(1 << 16):
            char = chr(c)
            low = char.lower()
            table[c] = ord(low[0]) if char.isalpha() else 32
        self.table = table

    @staticmethod
    def count(c: np.ndarray, new: int, counts: np.ndarray) -> None:
        """Adds the n-grams of a line of signs that end at its place ``new`` or later."""
        a, b, d = c[new:], c[max(0, new - 1) :], c[max(0, new - 2) :]
        for grams in (a, b[1:] + b[:-1] * np.uint64(1_000_003), d[2:] + d[1:-1] * np.uint64(1_000_003) + d[:-2] * np.uint64(2_654_435_761_001)):
            mixed = grams * np.uint64(0x9E3779B97F4A7C15)
            counts += np.bincount((mixed >> np.uint64(49)).astype(np.int64), minlength=DIMS)

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Features and their counts; both empty for a text without letters."""
        counts = np.zeros(DIMS, np.int64)
        before = np.array([32], np.uint64)  # the last signs so far, two at most; blanks aren't repeated
        self.count(before, 0, counts)
        some = False
        for at in range(0, len(text or ""), MOST_AT_ONCE):
            cps = np.frombuffer(text[at : at + MOST_AT_ONCE].encode("utf-32-le", "surrogatepass"), "<u4")
            high = cps >= 1 << 16
            mapped = self.table[np.where(high, 0, cps)]
            if high.any():
                mapped[high] = [ord(chr(c).lower()[0]) if chr(c).isalpha() else 32 for c in cps[high].tolist()]
            blank = mapped == 32
            some |= not blank.all()
            keep = ~(blank & np.concatenate([[before[-1] == 32], blank[:-1]]))  # runs of blanks count once
            line = np.concatenate([before, mapped[keep].astype(np.uint64)])
            self.count(line, len(before), counts)
            before = line[-2:]
        if not some:
            return np.empty(0, np.int64), np.empty(0)
        if before[-1] != 32:
            self.count(np.append(before, np.uint64(32)), len(before), counts)
        at = np.flatnonzero(counts)
        return at, counts[at].astype(np.float64)


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.idf, self.weights, self.bias, self.temperature = languages, idf, weights, bias, temperature

    def features(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return x / np.sqrt(np.square(x).sum())

    def chances(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return softmax((self.features(at, counts) @ self.weights[at] + self.bias) / self.temperature)

    def predict(self, texts: pd.Series) -> pd.DataFrame:
        grams = Grams()
        names, scores = [], []
        for text in texts:
            at, counts = grams.of(text)
            if not len(at) or not self.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            p = self.chances(at, counts)
            best = int(p.argmax())
            names.append(self.languages[best])
            scores.append(float(min(1.0, p[best])))
        return pd.DataFrame({"lang": names, "score": scores})


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """(text) -> number of texts with letters and each feature's document frequency."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, df, n = Grams(), np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                at, _ = grams.of(text)
                df[at] += 1
                n += len(at) > 0
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["feature", "df"])

    found = texts.mapInArrow(count, "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")).toPandas()  # DIMS + 1 rows at most
    df = np.zeros(DIMS)
    own = found[found.feature >= 0]
    df[own.feature.to_numpy()] = own.df.to_numpy()
    return int(found.df[found.feature < 0].sum()), df


def sampled_features(docs: DataFrame, rows: int) -> tuple[list[str], list[tuple[int, np.ndarray, np.ndarray]]]:
    """(id, text, lang) -> languages, and (language, features, counts) of a bounded sample."""
    sizes = docs.groupBy("lang").count().collect()  # languages
    if not sizes:
        return [], []
    languages = sorted(r["lang"] for r in sizes)
    quota = max(rows / len(languages), LEAST_ROWS)
    rates = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], min(1.0, quota / r["count"])) for r in sizes], "lang string, rate double"))
    mark = F.xxhash64(id_text(F.col("id")), "text", F.lit("sample"))
    chance = F.pmod(mark, F.lit(1 << 32)) / F.lit(float(1 << 32))
    chosen = docs.join(rates, "lang").where(chance < F.col("rate"))
    chosen = chosen.groupBy("lang", mark.alias("mark")).agg(F.first("text").alias("text")).select("lang", "text")  # repeated rows once

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            got = [grams.of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.astype(np.int32).tobytes() for a, _ in got], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in got], pa.binary())], names=["lang", "at", "counts"])

    number = {name: i for i, name in enumerate(languages)}
    found = chosen.mapInArrow(featurise, "lang string, at binary, counts binary").toPandas()
    sample = [(number[r.lang], np.frombuffer(r.at, np.int32).astype(np.int64), np.frombuffer(r.counts, np.int32).astype(np.float64)) for r in found.itertuples()]
    sample = [x for x in sample if len(x[1])]
    sample.sort(key=lambda x: (x[0], len(x[1]), x[1].sum(), x[2].sum()))  # whatever order the rows came in
    return languages, sample


def fit_ftrl(samples: list[tuple[int, np.ndarray, np.ndarray]], n_classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(class, features, values) -> sparse weights (DIMS, classes) and bias, by FTRL-proximal."""
    alpha, beta, l1, l2 = (FTRL[k] for k in ("alpha", "beta", "l1", "l2"))
    z = np.zeros((DIMS + 1, n_classes))  # the last row is the bias, without penalty
    n = np.zeros((DIMS + 1, n_classes))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(samples)).tolist():
            y, at, x = samples[i]
            at, x = np.append(at, DIMS), np.append(x, 1.0)
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            w[-1] = -zs[-1] / ((beta + np.sqrt(ns[-1])) / alpha)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            g2 = g * g
            z[at] = zs + g - (np.sqrt(ns + g2) - np.sqrt(ns)) / alpha * w
            n[at] = ns + g2
    bias = -z[-1] / ((beta + np.sqrt(n[-1])) / alpha)
    return weights(z[:-1], n[:-1]), bias


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of logits with the least log loss on held-back rows."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean()
    return float(min(np.geomspace(0.05, 5, 60), key=loss))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = ROWS) -> Model:
    """A model of the rows of ``docs`` (all of them may be learned from)."""
    labelled = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")
    languages, sample = sampled_features(labelled, rows)
    n, df = document_frequencies(labelled.select("text"))
    idf = np.log((1 + n) / (1 + df)) + 1
    model = Model(languages, idf, np.zeros((DIMS, len(languages))), np.zeros(len(languages)), 1.0)
    if languages:
        weighted = [(y, at, model.features(at, counts)) for y, at, counts in sample]
        held = [x for i, x in enumerate(weighted) if i % 5 == 4]
        model.weights, model.bias = fit_ftrl([x for i, x in enumerate(weighted) if i % 5 != 4], len(languages))
        if held:
            model.temperature = temperature(np.array([x @ model.weights[at] + model.bias for _, at, x in held]), np.array([y for y, _, _ in held]))
    return model


def predicted(df: DataFrame, model: Model, text: str) -> DataFrame:
    """(row struct of ``df``, lang and score of each whole text)."""
    shared = df.sparkSession.sparkContext.broadcast(vars(model))  # arrays only: workers need not have this package

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(**shared.value)
        for texts in batches:
            yield own.predict(texts)

    rows = df.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"))
    return rows.select("row", predict("text").alias("p")).select("row", "p.lang", "p.score")


def identify_documents(docs: DataFrame) -> DataFrame:
    """The ``op7`` digest: learns from documents whose remainder by 4 isn't 2."""
    model = fit(docs.where(remainder(F.col("doc_id"), 4) != 2))
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    rows = predicted(docs.select("doc_id", "text"), model, "text").select("row.doc_id", "lang", "score")
    return rows.select("doc_id", held.alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def keep_identified(docs: DataFrame, certain: float = CERTAIN) -> DataFrame:
    """Documents in a language the model knows and is certain of; columns as in ``docs``."""
    model = fit(docs.where(remainder(F.col("doc_id"), 4) != 2))
    return predicted(docs, model, "text").where((F.col("lang") != UNKNOWN) & (F.col("score") >= certain)).select("row.*")
