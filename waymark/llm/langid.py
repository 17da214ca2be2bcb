"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features: the text lower-cased, runs of anything but letters as one space, its 1-, 2- and 3-grams hashed into BUCKETS; term
frequency 1 + ln(count), inverse document frequency over all training documents, length 1. Weights are fitted by
follow-the-regularised-leader with an elastic net (L1 makes them sparse) on a bounded sample of the training documents, and a
temperature is fitted on a part of the sample that the weights did not see.

Nulls and texts without a letter are `und` with score 0; so is everything if there is nothing to learn from. lang, source and
doc_id take no part in a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices

BUCKETS = 1 << 16
#: Documents that weights are fitted on, over all languages, and the least number for each language (where it has them).
SAMPLE, LEAST_OF_EACH = 4000, 60
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.05, 0.05
#: The pipeline keeps a document if its language is known with this score at least.
LEAST_SCORE = 0.5


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (ascending) and their counts; none for a text without a letter."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of other characters the first stays, as a space
    keep[0] = True
    c = np.where(letter, raw, 32)[keep].astype(np.uint32)
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + c[2:]
    total = np.bincount(np.concatenate([(x * np.uint32(0x27D4EB2F)) >> np.uint32(16) for x in (one, two, three)]), minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def vector(self, found: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = (1 + np.log(count)) * self.idf[found]
        return x / max(np.sqrt((x * x).sum()), 1e-12)

    def logits(self, found: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.vector(found, count) @ self.weights[found] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found, count = ngram_counts(text or "")
        if not len(found) or not self.langs:
            return "und", 0.0
        z = self.logits(found, count) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def _frequency_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of this task's texts hold each bucket; bucket -1 counts the texts."""
    total, n = np.zeros(BUCKETS, np.int64), 0
    for batch in slices(batches, "text"):
        for text in batch.column("text").to_pylist():
            total[ngram_counts(text)[0]] += 1
            n += 1
    found = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1], found))), pa.array(np.concatenate(([n], total[found])))], ["bucket", "docs"])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        both = [ngram_counts(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), pa.array([f.astype("<i4").tobytes() for f, _ in both], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in both], pa.binary())],
            ["doc_id", "lang", "found", "counts"])


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], model: Model, seed: int = 3) -> None:
    """Set weights and bias. rows: class, buckets, vector."""
    k = len(model.langs)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    order = np.random.default_rng(seed)

    def weights(z, n):
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    for _ in range(EPOCHS):
        for at in order.permutation(len(rows)):
            y, found, x = rows[at]
            found, x = np.append(found, BUCKETS), np.append(x, 1.0)
            w = weights(z[found], n[found])
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            z[found] += g - (np.sqrt(n[found] + g * g) - np.sqrt(n[found])) / ALPHA * w
            n[found] += g * g
    w = weights(z, n).astype(np.float32)
    model.weights, model.bias = w[:-1], w[-1]


def fit_temperature(rows: list[tuple[int, np.ndarray]]) -> float:
    """The temperature with the least log loss on classes and logits; a share of 1 / (rows + 2) of each class goes to the others."""
    if not rows:
        return 1.0
    y, z = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    target = np.full(z.shape, 1 / (len(y) + 2) / max(z.shape[1] - 1, 1))
    target[np.arange(len(y)), y] = 1 - 1 / (len(y) + 2)
    best = (np.inf, 1.0)
    for t in np.exp(np.linspace(np.log(0.05), np.log(5), 60)):
        s = z / t
        s = s - s.max(1, keepdims=True)
        loss = ((np.log(np.exp(s).sum(1, keepdims=True)) - s) * target).sum(1).mean()
        best = min(best, (float(loss), float(t)))
    return best[1]


def train(docs: DataFrame) -> Model:
    """Learn from docs (doc_id, text, lang; rows without text or lang are left out)."""
    docs = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    per_lang = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(per_lang)
    frequency = docs.select("text").mapInArrow(_frequency_batches, "bucket long, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs")).collect()
    docs_with, n = np.zeros(BUCKETS), 0
    for r in frequency:
        if r.bucket < 0:
            n = r.docs
        else:
            docs_with[r.bucket] = r.docs
    model = Model(langs, (np.log((1 + n) / (1 + docs_with)) + 1).astype(np.float32), np.zeros((BUCKETS, len(langs)), np.float32), np.zeros(len(langs), np.float32), 1.0)
    if not langs:
        return model
    share = {lang: min(1.0, max(SAMPLE / len(langs), LEAST_OF_EACH) / m) for lang, m in per_lang.items()}
    pick = F.lit(False)
    for lang in langs:
        pick = pick | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(share[lang] * 1_000_000) + 1))
    rows, held = [], []
    sample = docs.filter(pick).mapInArrow(_count_batches, "doc_id long, lang string, found binary, counts binary").collect()
    sample.sort(key=lambda r: (r.lang, r.doc_id is not None, r.doc_id or 0, r.found, r.counts))
    for i, r in enumerate(sample):
        found, count = np.frombuffer(r.found, "<i4").astype(np.int64), np.frombuffer(r.counts, "<i4")
        if len(found):
            (held if i % 5 == 0 and len(sample) > 20 else rows).append((langs.index(r.lang), found, count))
    fit_ftrl([(y, f, model.vector(f, c)) for y, f, c in rows], model)
    model.temperature = fit_temperature([(y, model.logits(f, c)) for y, f, c in held])
    return model


def _predict_batches(batches, model):
    for batch in slices(batches, "text"):
        got = [model.value.predict(t) for t in batch.column("text").to_pylist()]
        out = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in batch.schema.names] + out, [*batch.schema.names, "lang_pred", "score"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score (columns of these names are replaced)."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double"
    return docs.mapInArrow(partial(_predict_batches, model=shared), schema)


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score over the whole documents table."""
    docs = documents(spark, sf_dir)
    model = train(docs.filter(~held_out() | held_out().isNull()))
    got = predict(docs.select("doc_id", "text"), model)
    return got.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def _known_batches(batches, model):
    for batch in slices(batches, "text"):
        got = [model.value.predict(t) for t in batch.column("text").to_pylist()]
        yield batch.filter(pa.array([lang != "und" and score >= LEAST_SCORE for lang, score in got], pa.bool_()))


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is recognised with LEAST_SCORE or more."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs))
    return docs.mapInArrow(partial(_known_batches, model=model), docs.schema)
