"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, their stems, bigrams and one-gap skip-bigrams of the whole text, hashed. FTRL-proximal
(McMahan and others, 2013) keeps a learning rate for each coordinate and sets most weights to exactly zero, so the
fitted model is a short list of (index, weight) that goes to the executors in the task closure; its size is bounded
by the number of hash slots and in practice by the sample.

Fitted on a bounded sample of labelled rows (documented parameters), scored on all whole texts.

Defined cases: null and empty texts have no features and get the intercept's score; rows without a label train
nothing; without labels of both kinds every score is the labels' mean (0 without labels); equal texts, equal scores;
equal labels of an id count once, different ones both; repeated rows of an id are one text; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import batches, bounded_sample, bucket_of_id, hash_words

BITS = 20
#: Unigrams also count by their first bytes, so that a stem is known in words that the sample lacks.
STEMS = (5, 7)
#: Labelled texts of each class that the fit sees at most.
SAMPLE_PER_CLASS = 3000
#: Bytes of a text that may be in the sample, and of all sampled texts of a class.
TEXT_BYTES, CLASS_BYTES = 1 << 16, 12 << 20
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 6.0, 0.1, 5
THRESHOLD = 0.7


@dataclass
class SparseWeights:
    index: np.ndarray
    weight: np.ndarray
    intercept: float


def _strip(run: list[bytes]) -> list[bytes]:
    """Punctuation at words' edges doesn't make another word."""
    return [x.translate(_PLAIN) for x in run]


_PLAIN = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def features(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number << BITS | slot, distinct and ascending; texts' words) of lower-cased texts."""
    plain = _strip(run)
    h, counts = hash_words(plain)
    doc = np.repeat(np.arange(len(counts)), counts)
    parts = [(doc, h), *((doc, (hash_words(plain, stem)[0] + np.uint64(stem)) * np.uint64(0x94D049BB133111EB)) for stem in STEMS)]
    for gap in (1, 2):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            pair = (h[:-gap] * np.uint64(0x9E3779B97F4A7C15 + gap * 2) + h[gap:])[same]
            parts.append((doc[gap:][same], (pair ^ (pair >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)))
    keys = np.concatenate([d.astype(np.uint64) << np.uint64(BITS) | x >> np.uint64(64 - BITS) for d, x in parts])
    return np.unique(keys), counts


def fit(texts: list[str], labels: list[int], seed: int = 3) -> SparseWeights:
    y = np.array(labels, dtype=float)
    if len(set(labels)) < 2:
        mean = float(y.mean()) if len(y) else 0.0
        return SparseWeights(np.zeros(0, np.int64), np.zeros(0), np.log((mean + 1e-6) / (1 - mean + 1e-6)))
    rows: list[np.ndarray] = []
    for _, run in batches(texts, lower=True):
        keys, counts = features(run)
        doc = keys >> np.uint64(BITS)
        slots = (keys & np.uint64((1 << BITS) - 1)).astype(np.int32)
        rows += np.split(slots, np.searchsorted(doc, np.arange(1, len(counts))))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = 1 << BITS
    rng = np.random.default_rng(seed)

    def weights(i: np.ndarray) -> np.ndarray:
        l1 = np.where(i == bias, 0.0, L1)
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(PASSES):
        for k in rng.permutation(len(y)):
            i = np.append(rows[k], bias)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y[k]
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    every = weights(np.arange(len(z)))
    kept = np.flatnonzero(every[:-1])
    return SparseWeights(kept, every[kept], float(every[-1]))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, train: Column, per_class: int = SAMPLE_PER_CLASS, class_bytes: int = CLASS_BYTES) -> list[tuple[str, int]]:
    """At most per_class labelled texts of each class and class_bytes bytes of them, by a hash of the id; texts above
    TEXT_BYTES are left out. Bounded, and alike in reruns. Labels are cut first, then ids with sizes, then texts come."""
    key = F.xxhash64(F.col("doc_id").cast("string"), F.lit(5))
    known = labels.where(train & F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
    few = bounded_sample(known.select("doc_id", column, key.alias("key"), F.lit(0).alias("bytes")), column, "key", "bytes", 4 * per_class, 1)
    tid = F.xxhash64(docs["text"])
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), tid.alias("tid")).where(F.col("bytes") <= TEXT_BYTES)
    few = bounded_sample(sized.join(F.broadcast(few.select("doc_id", column, "key")), "doc_id"), column, "key", "bytes", per_class, class_bytes)
    chosen = few.select(F.col("doc_id").alias("_id"), F.col("tid").alias("_tid"), column, "nth")
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (tid == F.col("_tid")))
    got = got.select(column, "nth", F.coalesce("text", F.lit("")).alias("text")).distinct().orderBy(column, "nth", "text")
    return [(r["text"], int(r[column])) for r in got.collect()]


def score(docs: DataFrame, model: SparseWeights, name: str = "score") -> DataFrame:
    """docs with the model's probability of label 1 added."""

    def run(texts: pd.Series) -> pd.Series:
        table = np.zeros(1 << BITS)
        table[model.index] = model.weight
        out = np.full(len(texts), model.intercept)
        for first, part in batches(texts, lower=True):
            keys, _ = features(part)
            doc = (keys >> np.uint64(BITS)).astype(np.int64)
            out[first : first + len(part)] += np.bincount(doc, table[(keys & np.uint64((1 << BITS) - 1)).astype(np.int64)], len(part))
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return docs.withColumn(name, F.pandas_udf(run, "double")(F.col("text")))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (crc32 of the id modulo 3 is 1), score, predicted (score >= 0.7)."""
    fold = bucket_of_id(F.col("doc_id"), 3)
    sample = labelled_sample(docs, labels, "toxic", fold != 1)
    scored = score(docs.select("doc_id", "text"), fit([t for t, _ in sample], [y for _, y in sample]))
    return scored.select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
