"""Language identification with a byte convolutional network.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter keeps its maximum in a
window, and a softmax gives the language. The network is small, trained in numpy on a bounded sample of labelled
texts, and travels to the executors inside the task closure (its size does not depend on the data). Whole texts are
scored: all windows of a text vote with their mean log probability.

Defined cases: text that is null or has no letter is `und` with score 0; without any labelled row every other text is
`und` too. Equal texts get equal predictions; repeated rows are scored each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import bounded_sample, bucket_of_id, utf8

WINDOW = 192
WIDTHS = (2, 3, 4, 5)
FILTERS = 12  # of each width
EMBED = 6
#: Texts of each language that the fit sees at most, and windows of each of them.
SAMPLE_PER_LABEL = 240
SAMPLE_WINDOWS = 3
EPOCHS = 14


@dataclass
class ByteCNN:
    labels: list[str]
    embed: np.ndarray  # 256 x EMBED
    kernel: np.ndarray  # max width * EMBED x filters; narrow filters are zero beyond their width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        x = self.embed[windows]
        n, span = windows.shape
        wide = max(WIDTHS)
        cols = np.lib.stride_tricks.as_strided(x, (n, span - wide + 1, wide * EMBED), (x.strides[0], x.strides[1], x.itemsize))
        act = (cols.reshape(-1, wide * EMBED) @ self.kernel).reshape(n, span - wide + 1, -1)
        hidden = np.maximum(act.max(axis=1) + self.bias, 0)
        z = hidden @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def to_windows(data: bytes) -> np.ndarray:
    """All bytes of a text in consecutive windows; the last is filled with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros((n, WINDOW + max(WIDTHS) - 1), dtype=np.uint8)
    out[:, :WINDOW] = np.frombuffer(data.ljust(n * WINDOW, b"\x00"), dtype=np.uint8).reshape(n, WINDOW)
    return out


def fit(texts: list[str], labels: list[str], seed: int = 7) -> ByteCNN:
    """Adam on the cross entropy of each text's first window, labels weighted to equal shares."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    wide, total = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.zeros((wide * EMBED, total), dtype=np.float32)
    for k, w in enumerate(WIDTHS):
        mask[: w * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)),
        "kernel": rng.normal(0, 0.4, (wide * EMBED, total)) * mask,
        "bias": np.zeros(total),
        "out": rng.normal(0, 0.2, (total, max(1, len(names)))),
        "out_bias": np.zeros(max(1, len(names))),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    if not names:
        return ByteCNN([], **p)
    xs, ys = [], []
    for text, label in zip(texts, labels, strict=True):
        xs.append(to_windows(utf8(text))[:1])
        ys.append(names.index(label))
    x, y = np.concatenate(xs), np.array(ys)
    weight = (len(y) / len(names) / np.bincount(y, minlength=len(names)))[y].astype(np.float32)
    m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    span = WINDOW
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            i = order[at : at + 64]
            n = len(i)
            e = p["embed"][x[i]]
            cols = np.lib.stride_tricks.as_strided(e, (n, span, wide * EMBED), (e.strides[0], e.strides[1], e.itemsize))
            act = (cols.reshape(-1, wide * EMBED) @ p["kernel"]).reshape(n, span, total)
            best = act.argmax(axis=1)
            top = np.take_along_axis(act, best[:, None, :], 1)[:, 0] + p["bias"]
            hidden = np.maximum(top, 0)
            z = hidden @ p["out"] + p["out_bias"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(n), y[i]] -= 1
            dz = z * weight[i][:, None] / n
            g = {"out": hidden.T @ dz + 1e-4 * p["out"], "out_bias": dz.sum(axis=0)}
            dh = (dz @ p["out"].T) * (top > 0)
            g["bias"] = dh.sum(axis=0)
            picked = cols[np.arange(n)[:, None], best]  # n x filters x wide*EMBED
            g["kernel"] = np.einsum("nfk,nf->kf", picked, dh) * mask
            back = dh[:, :, None] * p["kernel"].T[None]
            bytes_at = x[i][np.arange(n)[:, None, None], best[:, :, None] + np.arange(wide)]
            g["embed"] = np.zeros_like(p["embed"])
            np.add.at(g["embed"], bytes_at.ravel(), back.reshape(-1, EMBED))
            t += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= (0.01 * (1 - epoch / EPOCHS) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return ByteCNN(names, **p)


def training_sample(docs: DataFrame, train: Column, per_label: int = SAMPLE_PER_LABEL) -> list[tuple[str, str]]:
    """At most per_label labelled texts of each language, chosen by a hash of the id; of each, SAMPLE_WINDOWS pieces from
    its start to its end, a window long. Bounded in rows and bytes, and alike in reruns; a frequent language is not
    gathered in one place."""
    n = F.greatest(F.length("text") - F.lit(WINDOW), F.lit(0))
    pieces = F.array_distinct(F.array(*[F.substr("text", (F.floor(n * k / max(1, SAMPLE_WINDOWS - 1)) + 1).cast("int"), F.lit(WINDOW)) for k in range(SAMPLE_WINDOWS)]))
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)).alias("key"), F.lit(0).alias("bytes"), pieces.alias("pieces"))
    got = bounded_sample(rows, "lang", "key", "bytes", per_label, 1).orderBy("lang", "nth").select(F.explode("pieces").alias("piece"), "lang")
    return [(r["piece"], r["lang"]) for r in got.collect()]


PREDICTED = "lang_pred string, score double"


def predict(docs: DataFrame, model: ByteCNN, text: str = "text") -> DataFrame:
    """docs with lang_pred and score added; other columns pass through."""

    def scores(texts: pd.Series) -> pd.DataFrame:
        names = np.array([*model.labels, "und"], dtype=object)
        pred, score = np.full(len(texts), len(model.labels)), np.zeros(len(texts))
        run: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            if not run:
                return
            w = [to_windows(d) for _, d in run]
            ends = np.cumsum([len(a) for a in w])
            all_windows = np.concatenate(w)
            logp = np.concatenate([model.log_probs(all_windows[a : a + 64]) for a in range(0, len(all_windows), 64)])
            mean = np.add.reduceat(logp, np.concatenate([[0], ends[:-1]]), axis=0) / np.diff(ends, prepend=0)[:, None]
            prob = np.exp(mean - mean.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            for (i, _), row in zip(run, prob, strict=True):
                pred[i] = row.argmax()
                score[i] = row.max()

        if model.labels:
            for i, t in enumerate(texts):
                data = utf8(t)
                if not data:
                    continue
                run.append((i, data))
                size += len(data)
                if size > 1 << 20:
                    flush()
                    run.clear()
                    size = 0
            flush()
        return pd.DataFrame({"lang_pred": names[pred], "score": score})

    score_udf = F.pandas_udf(scores, PREDICTED)
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    got = docs.select(F.struct(*docs.columns).alias("row"), letters.alias("letters"), score_udf(F.col(text)).alias("found"))
    return got.select("row.*", F.when(F.col("letters"), F.col("found.lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("letters"), F.col("found.score")).otherwise(F.lit(0.0)).alias("score"))


def fit_on(docs: DataFrame) -> ByteCNN:
    """Fit on rows outside the held-out fold (crc32 of doc_id modulo 5 is 0)."""
    sample = training_sample(docs, bucket_of_id(F.col("doc_id"), 5) != 0)
    return fit([t for t, _ in sample], [x for _, x in sample])


def accept(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """The pipeline's stage: documents without a language, or without a clear one, go; the others keep all columns."""
    kept = docs.select(F.struct(*docs.columns).alias("whole"), "text")
    scored = predict(kept, fit_on(docs)).where((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return scored.select("whole.*")
