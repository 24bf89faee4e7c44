"""Quality by a weak-label model.

Overlapping heuristic labellers vote good, bad or abstain on every document. Expectation-maximisation estimates how
often each labeller is right and how many documents are good, without any true label; the posterior of each vote
pattern is the soft label. A hashed linear scorer (words and shape features) is trained on posterior labels and
scores all documents, also those on which every labeller abstains.

The model needs only how often each vote pattern occurs: counts over all documents, one row a pattern, at most
3 ** labellers however large the corpus. The scorer is fitted on a bounded sample (documented parameter).

Defined cases: null and empty texts count as bad by the length labeller and get a score like any other; an empty table gives no rows;
equal texts get equal scores; repeated rows are counted and scored each; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .base import batches, bounded_sample, hash_words, stored_in_small_batches

BITS = 16
SHAPES = 8
#: Texts that the scorer is fitted on at most, from each side of posterior 1/2.
SAMPLE_PER_SIDE = 1500
#: Bytes of a text that may be in that sample, and of all sampled texts of a side.
TEXT_BYTES, SIDE_BYTES = 1 << 16, 12 << 20
ROUNDS = 60
KEEP = 0.5


SHAPE = "chars long, letters long, upper long, symbols long, shouts long, words long, distinct long, sentences long, bytes long"
_CLASSES = np.zeros((6, 256), dtype=np.int64)
for _i in range(256):
    _c = chr(_i)
    _CLASSES[:, _i] = (
        _i & 0xC0 != 0x80,  # starts a code point
        _c.isalpha() if _i < 128 else _i >= 0xC0,  # code points beyond ASCII count as letters
        "A" <= _c <= "Z",
        _i < 128 and not _c.isalnum() and not _c.isspace() and _c not in ".,;:!?'\"()-",
        _c == "!",
        _c == ".",
    )


def shapes(texts: pd.Series) -> pd.DataFrame:
    """What the labellers look at, counted over each whole text."""
    out = np.zeros((len(texts), 9), dtype=np.int64)
    for first, run in batches(texts):
        h, n = hash_words([x.lower() for x in run])
        ends = np.cumsum(n)
        lengths = np.array([len(x) for x in run])
        buf = np.frombuffer(b"".join(run), dtype=np.uint8)
        doc = np.repeat(np.arange(len(run)), lengths)
        for k in range(6):
            out[first : first + len(run), k if k < 5 else 7] = np.bincount(doc[_CLASSES[k][buf] > 0], minlength=len(run))
        out[first : first + len(run), 5] = n
        out[first : first + len(run), 8] = lengths
        out[first : first + len(run), 6] = [len(np.unique(h[e - c : e])) for e, c in zip(ends, n, strict=True)]
    return pd.DataFrame(out, columns=[x.split()[0] for x in SHAPE.split(", ")])


def with_shape(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("_shape", F.pandas_udf(shapes, SHAPE)(F.col(text)))


def votes(s: Column) -> Column:
    """array<int>: 1 good, -1 bad, 0 no opinion, of each labeller. Most know one defect and have no other opinion."""
    n, words, letters = (F.greatest(s[k], F.lit(1)) for k in ("chars", "words", "letters"))

    stuck = (s["distinct"] / words < 0.15) & (words > 60)

    def bad(x: Column) -> Column:
        return F.when(x, -1).otherwise(0)

    def good(x: Column) -> Column:
        return F.when(x & ~stuck, 1).otherwise(0)

    return F.array(
        bad(s["symbols"] / n > 0.04),
        bad(s["upper"] / letters > 0.5),
        bad(s["letters"] / n < 0.66),
        bad(s["shouts"] / words > 0.2),
        bad((s["sentences"] / words < 0.02) & (words > 40)),
        bad(stuck),
        bad((s["distinct"] / words < 0.25) & (words > 25) & (words < 400)),
        bad(s["chars"] / words > 8.5),
        bad(s["words"] < 3),
        good((s["symbols"] / n < 0.01) & (s["upper"] / letters < 0.2)),
        good((s["letters"] / n > 0.74) & (s["chars"] / words < 8)),
        good((s["sentences"] / words > 0.03) & (s["shouts"] / words < 0.02)),
        good((s["distinct"] / words > 0.4) & (words > 15)),
    ).cast("array<int>")


@dataclass
class LabelModel:
    good: float
    right: np.ndarray  # labellers x (good, bad): chance of the vote for the side, given an opinion on it
    opinion: np.ndarray  # labellers x (good, bad): chance to have an opinion

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        logs = np.log(np.array([self.good, 1 - self.good]))[None, :] + np.zeros((len(patterns), 2))
        for j in range(patterns.shape[1]):
            v = patterns[:, j]
            for side, sign in ((0, 1), (1, -1)):
                r, o = self.right[j, side], self.opinion[j, side]
                logs[:, side] += np.log(np.where(v == 0, 1 - o, np.where(v == sign, o * r, o * (1 - r))))
        return 1 / (1 + np.exp(np.clip(logs[:, 1] - logs[:, 0], -50, 50)))


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """EM over vote patterns with their counts; starts from labellers that are right more often than not."""
    m = patterns.shape[1]
    model = LabelModel(0.8, np.full((m, 2), 0.8), np.full((m, 2), 0.7))
    for _ in range(rounds if counts.sum() else 0):
        p = model.posterior(patterns)
        side = np.stack([p, 1 - p], axis=1) * counts[:, None]
        total = side.sum(axis=0)
        good = float(np.clip((total[0] + 4) / (total.sum() + 5), 0.02, 0.98))
        right, opinion = np.empty((m, 2)), np.empty((m, 2))
        for k, sign in ((0, 1), (1, -1)):
            has = (side[:, k, None] * (patterns != 0)).sum(axis=0)
            hit = (side[:, k, None] * (patterns == sign)).sum(axis=0)
            right[:, k] = np.clip((hit + 8) / (has + 10), 0.05, 0.99)
            opinion[:, k] = np.clip((has + 7) / (total[k] + 10), 0.01, 0.99)
        model = LabelModel(good, right, opinion)
    return model


def _features(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) pairs of the words of each text, by presence."""
    docs, slots = [], []
    for first, run in batches(texts, lower=True):
        h, n = hash_words(run)
        stems, _ = hash_words(run, 3)
        doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)
        keys = np.unique(np.concatenate([doc << np.uint64(BITS) | x >> np.uint64(64 - BITS) for x in (h, stems * np.uint64(0x94D049BB133111EB))]))
        docs.append((keys >> np.uint64(BITS)).astype(np.int64) + first)
        slots.append((keys & np.uint64((1 << BITS) - 1)).astype(np.int64))
    return (np.concatenate(docs), np.concatenate(slots)) if docs else (np.zeros(0, np.int64),) * 2


def _shapes(s: pd.DataFrame) -> np.ndarray:
    n, w, le = np.maximum(s["chars"], 1), np.maximum(s["words"], 1), np.maximum(s["letters"], 1)
    return np.stack([10 * np.minimum(s["symbols"] / n, 0.3), 3 * s["upper"] / le, 3 * s["letters"] / n, np.minimum(s["shouts"] / w, 2), 10 * np.minimum(s["sentences"] / w, 0.3), 2 * s["distinct"] / w, np.minimum(s["chars"] / w, 20) / 5, np.log1p(w) / 4], axis=1)


@dataclass
class Scorer:
    slots: np.ndarray
    shapes: np.ndarray
    bias: float

    def __call__(self, texts: pd.Series, shapes: pd.DataFrame) -> np.ndarray:
        doc, slot = _features(texts)
        n = np.maximum(np.bincount(doc, minlength=len(texts)), 1)
        z = np.bincount(doc, self.slots[slot], len(texts)) / np.sqrt(n) + _shapes(shapes) @ self.shapes + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_scorer(texts: pd.Series, shapes: pd.DataFrame, soft: np.ndarray, steps: int = 150) -> Scorer:
    """Full-batch logistic regression on soft labels, both sides weighted alike, Adagrad steps."""
    out = Scorer(np.zeros(1 << BITS, np.float32), np.zeros(SHAPES), 0.0)
    if not len(texts):
        return out
    doc, slot = _features(texts)
    scale = 1 / np.sqrt(np.maximum(np.bincount(doc, minlength=len(texts)), 1))
    x = _shapes(shapes)
    side = np.array([max((soft < 0.5).sum(), 1), max((soft >= 0.5).sum(), 1)])
    weight = (1 / side)[(soft >= 0.5).astype(int)] / 2
    g2, s2, b2 = np.full(1 << BITS, 1e-6), np.full(SHAPES, 1e-6), 1e-6
    for _ in range(steps):
        z = np.bincount(doc, out.slots[slot], len(texts)) * scale + x @ out.shapes + out.bias
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft) * weight
        g = np.bincount(slot, (d * scale)[doc], 1 << BITS) + 1e-5 * out.slots
        gs, gb = x.T @ d + 1e-4 * out.shapes, d.sum()
        g2, s2, b2 = g2 + g * g, s2 + gs * gs, b2 + gb * gb
        out = Scorer((out.slots - 0.05 * g / np.sqrt(g2)).astype(np.float32), out.shapes - 0.2 * gs / np.sqrt(s2), float(out.bias - 0.2 * gb / np.sqrt(b2)))
    return out


def pattern_posteriors(voted: DataFrame) -> tuple[DataFrame, LabelModel]:
    """(votes, posterior) for each pattern that occurs, and the model. The patterns are bounded by the labellers."""
    rows = voted.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    patterns = np.array([r["votes"] for r in rows], dtype=int).reshape(len(rows), len(rows[0]["votes"]) if rows else 1)
    model = fit_label_model(patterns, np.array([r["n"] for r in rows], dtype=float))
    post = model.posterior(patterns) if len(rows) else []
    spark = voted.sparkSession
    return spark.createDataFrame([(list(map(int, p)), float(q)) for p, q in zip(patterns, post, strict=True)], "votes array<int>, posterior double"), model


def training_rows(docs: DataFrame, soft: DataFrame, most: int = SAMPLE_PER_SIDE, most_bytes: int = SIDE_BYTES) -> list[Row]:
    """(text, _shape, posterior) of at most `most` texts of each side of posterior 1/2, by a hash of the text; texts
    above TEXT_BYTES are left out. soft: (doc_id, _t, _shape, posterior)."""
    side = (F.col("posterior") >= 0.5).cast("int")
    rows = soft.select(side.alias("side"), F.xxhash64("_t", F.lit(9)).alias("key"), F.col("_shape.bytes").alias("bytes"), "doc_id", "_t", "_shape", "posterior").where(F.col("bytes") <= TEXT_BYTES)
    few = bounded_sample(rows, "side", "key", "bytes", most, most_bytes).select(F.col("doc_id").alias("_id"), F.col("_t").alias("_u"), "_shape", "posterior", "nth")
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = keyed.join(F.broadcast(few), F.col("_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("text") == F.col("_u")))
    return got.select("doc_id", "text", "_shape", "posterior", "nth").distinct().orderBy("posterior", "nth", "doc_id").collect()


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, posterior (label model), score (linear scorer), keep: the mean of both is at least 1/2."""
    shaped = with_shape(docs.select("doc_id", "text")).withColumn("votes", votes(F.col("_shape")))
    voted = stored_in_small_batches(shaped.select("doc_id", "_shape", "votes", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_t")), "votes")
    table, _ = pattern_posteriors(voted)
    rows = training_rows(docs, voted.join(F.broadcast(table), "votes"))
    scorer = fit_scorer(pd.Series([r["text"] for r in rows], dtype=object), pd.DataFrame([r["_shape"].asDict() for r in rows], columns=[x.split()[0] for x in SHAPE.split(", ")]), np.array([r["posterior"] for r in rows]))

    def run(texts: pd.Series, shape: pd.DataFrame) -> pd.Series:
        # some texts at a time: their features are held together
        parts = [scorer(texts.iloc[k : k + 200].reset_index(drop=True), shape.iloc[k : k + 200]) for k in range(0, len(texts), 200)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    got = shaped.withColumn("score", F.pandas_udf(run, "double")(F.col("text"), F.col("_shape")))
    got = stored_in_small_batches(got.select("doc_id", "votes", "score"), "scores").join(F.broadcast(table), "votes")
    return got.select("doc_id", "posterior", "score", ((F.col("posterior") + F.col("score")) / 2 >= KEEP).alias("keep"))
