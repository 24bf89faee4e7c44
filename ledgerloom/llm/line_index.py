"""Line dedup over a sharded minimal perfect hash.

A line's key is the line stripped of separators, A-Z lower-cased. All distinct keys (as 128-bit hashes) are spread over
shards; each shard builds a minimal perfect hash of its keys, which indexes compact arrays: fingerprints, counts of
documents and the largest document id. Documents don't join lines with counts: the distinct keys of a chunk of
documents probe the arrays of their shards once, and the answers go back to the chunk.

A key that a third of all documents hold costs one probe for each chunk, not for each document; chunks and shards
have about the same size however much data there is, since their numbers follow from the input's size.

Defined cases: a null or empty text is one empty line; lines with fewer than min_chars code points are kept; repeated
rows each count as a document and, sharing the largest id, each keep the line; extra columns are ignored; null ids
rank below all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import WHITESPACE, stored, utf8

MIN_CHARS = 20
MIN_DOCS = 3
#: About so many bytes of text in a chunk of documents, and distinct keys in a shard of the index.
CHUNK_BYTES = 6 << 20
SHARD_KEYS = 200_000
#: Shards at most that answer in slices.
MOST_HOT = 10_000
NO_ID = -(1 << 63)

_M = np.uint64(0x9FB21C651E98DF25)


def keys_of(text: object, min_chars: int = MIN_CHARS) -> tuple[list[bytes], list[tuple[int, int] | None]]:
    """The lines of a text, and for each that counts the two halves of its key's hash."""
    lines = utf8(text).split(b"\n")
    keys: list[tuple[int, int] | None] = []
    for line in lines:
        key = line.strip(WHITESPACE).lower()
        if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
            keys.append(None)
        else:
            h = xxhash.xxh3_128_intdigest(key)
            keys.append((h >> 64, h & (1 << 64) - 1))
    return lines, keys


# --- the minimal perfect hash: levels of bit arrays, ranked (Limasset and others, 2017)


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    x = keys ^ np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(31))) * _M
    x = (x ^ (x >> np.uint64(29))) * _M
    return (x ^ (x >> np.uint64(32))) % np.uint64(size)


class PerfectHash:
    """Maps n distinct 64-bit keys to 0 .. n-1. Other keys map anywhere or to -1: the fingerprint tells them."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels, self.ranks, below = levels, [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits, dtype=np.int64) - 1 + below)
            below += int(bits.sum())

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(keys):
            if len(levels) > 200:  # ends with likelihood one long before, unless two keys are equal
                raise ValueError(f"{len(keys)} keys aren't distinct")
            size = max(8, int(gamma * len(keys)))
            at = _slot(keys, len(levels), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[at]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = _slot(keys[todo], level, len(bits))
            hit = bits[at]
            out[todo[hit]] = ranks[at[hit]]
            todo = todo[~hit]
        return out

    def dump(self) -> bytes:
        return b"".join(len(bits).to_bytes(8, "little") + np.packbits(bits).tobytes() for bits in self.levels)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        levels, at = [], 0
        while at < len(data):
            n = int.from_bytes(data[at : at + 8], "little")
            size = (n + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data[at + 8 : at + 8 + size], dtype=np.uint8))[:n].astype(bool))
            at += 8 + size
        return cls(levels)


INDEX = "shard int, levels binary, prints binary, counts binary, last binary"


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard's arrays, from its distinct keys. Two keys with equal first halves count as different keys only if
    the second halves differ; the first half is made of both, so that the perfect hash has distinct inputs."""
    hi, lo = pdf["hi"].to_numpy(np.int64).view(np.uint64), pdf["lo"].to_numpy(np.int64).view(np.uint64)
    keys = hi ^ lo * _M
    order = PerfectHash.build(keys)
    at = order(keys)
    prints, counts, last = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint32), np.zeros(len(at), np.int64)
    prints[at], counts[at], last[at] = hi, np.minimum(pdf["n"].to_numpy(), 0xFFFFFFFF).astype(np.uint32), pdf["last"].to_numpy()
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "levels": [order.dump()], "prints": [prints.tobytes()], "counts": [counts.tobytes()], "last": [last.tobytes()]})


def probe(index: pd.DataFrame, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents that hold the key, their largest id); (0, 0) for keys that aren't in the index."""
    if not len(index):
        return np.zeros(len(hi), np.int64), np.zeros(len(hi), np.int64)
    row = index.iloc[0]
    prints, counts, last = np.frombuffer(row["prints"], np.uint64), np.frombuffer(row["counts"], np.uint32), np.frombuffer(row["last"], np.int64)
    at = PerfectHash.load(bytes(row["levels"]))(hi ^ lo * _M)
    found = (at >= 0) & (prints[at] == hi)
    return np.where(found, counts[at], 0).astype(np.int64), np.where(found, last[at], 0)


def _in_chunks(docs: DataFrame, chunk_bytes: int, min_chars: int) -> DataFrame:
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = F.lit(max(1, -(-size // chunk_bytes)))
    # a text too short for any key asks nothing, so it may be dealt anywhere: equal empty rows aren't one chunk
    short = F.coalesce(F.octet_length("text"), F.lit(0)) < min_chars
    return rows.withColumn("chunk", F.when(short, F.floor(F.rand(7) * n)).otherwise(F.pmod(F.xxhash64("doc_id", "text"), n)))


def line_index(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, shard_keys: int = SHARD_KEYS, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame]:
    """(keys of each chunk: chunk, shard, hi, lo; the index)."""

    def distinct(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(c, *k, d) for c, d, t in zip(pdf["chunk"], pdf["doc_id"], pdf["text"], strict=True) for k in {x for x in keys_of(t, min_chars)[1] if x}]
            got = pd.DataFrame(rows, columns=["chunk", "hi", "lo", "last"]).astype({"chunk": "int64", "hi": "uint64", "lo": "uint64", "last": "int64"})
            got = got.groupby(["chunk", "hi", "lo"], sort=False)["last"].agg(["size", "max"]).reset_index()
            yield pd.DataFrame({"chunk": got["chunk"], "hi": got["hi"].to_numpy().view(np.int64), "lo": got["lo"].to_numpy().view(np.int64), "n": got["size"].astype("int64"), "last": got["max"]})

    found = _in_chunks(docs, chunk_bytes, min_chars).mapInPandas(distinct, "chunk long, hi long, lo long, n long, last long")
    per_chunk = stored(found.groupBy("chunk", "hi", "lo").agg(F.sum("n").alias("n"), F.max("last").alias("last")), "line-keys")
    keys = per_chunk.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    shards = max(1, -(-per_chunk.count() // shard_keys))
    shard = F.pmod(F.xxhash64("hi", "lo"), F.lit(shards)).cast("int")
    index = stored(keys.withColumn("shard", shard).groupBy("shard").applyInPandas(build_shard, INDEX), "line-index")
    return per_chunk.select("chunk", shard.alias("shard"), "hi", "lo"), index


def _sliced(asked: DataFrame, index: DataFrame, shard_keys: int, most_hot: int = MOST_HOT) -> tuple[DataFrame, DataFrame]:
    """Both sides with `slice`: a shard that is asked far more than it has keys (a line that all chunks hold asks once a
    chunk) answers in several slices, each with a copy of its arrays, which is smaller than the slice's questions. So many
    shards at most are hot that their list can go to all tasks; any other gets 1 / most_hot of all questions at most."""
    each = asked.groupBy("shard").agg(F.count("*").alias("n"))
    bound = max(4 * shard_keys, (each.agg(F.sum("n")).first()[0] or 0) // most_hot)
    hot = F.broadcast(each.where(F.col("n") > bound).select("shard", F.ceil(F.col("n") / bound).alias("slices")))
    slices = F.coalesce("slices", F.lit(1))
    dealt = asked.join(hot, "shard", "left").withColumn("slice", F.pmod(F.xxhash64("chunk"), slices)).drop("slices")
    return dealt, index.join(hot, "shard", "left").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1))).drop("slices")


DEDUPED = "doc_id long, n_lines long, n_dropped long, kept_text string"


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, chunk_bytes: int = CHUNK_BYTES, shard_keys: int = SHARD_KEYS, digest: bool = False) -> DataFrame:
    """One row per document: lines before, lines dropped, and the kept text (or its sha256 as kept_sha256)."""
    asked, index = line_index(docs, chunk_bytes, shard_keys, min_chars)

    def answer(questions: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        n, last = probe(arrays, questions["hi"].to_numpy(np.int64).view(np.uint64), questions["lo"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"chunk": questions["chunk"], "hi": questions["hi"], "lo": questions["lo"], "last": last})[n >= min_docs]

    asked, index = _sliced(asked, index, shard_keys)
    common = asked.groupBy("shard", "slice").cogroup(index.groupBy("shard", "slice")).applyInPandas(answer, "chunk long, hi long, lo long, last long")
    out = "kept_sha256" if digest else "kept_text"

    def drop(rows: pd.DataFrame, common: pd.DataFrame) -> pd.DataFrame:
        keeps = dict(zip(zip(common["hi"].to_numpy(np.int64).view(np.uint64).tolist(), common["lo"].to_numpy(np.int64).view(np.uint64).tolist(), strict=True), common["last"].tolist(), strict=True))
        got = []
        for doc, none, text in zip(rows["doc_id"].tolist(), rows["no_id"].tolist(), rows["text"], strict=True):
            lines, keys = keys_of(text, min_chars)
            kept = [line for line, k in zip(lines, keys, strict=True) if k is None or keeps.get(k, doc) == doc]
            data = b"\n".join(kept)
            got.append((None if none else doc, len(lines), len(lines) - len(kept), hashlib.sha256(data).hexdigest() if digest else data.decode()))
        return pd.DataFrame(got, columns=["doc_id", "n_lines", "n_dropped", out]).astype({"doc_id": "Int64"})

    return _in_chunks(docs, chunk_bytes, min_chars).groupBy("chunk").cogroup(common.groupBy("chunk")).applyInPandas(drop, DEDUPED.replace("kept_text", out))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT r, doc_id, line, i, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, count(DISTINCT r) AS n, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
j AS (SELECT k.r, k.doc_id, k.line, k.i, c.key IS NULL OR c.last IS NOT DISTINCT FROM k.doc_id AS keep FROM k LEFT JOIN c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE NOT keep)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keep), '')) AS kept_sha256
FROM j GROUP BY r
"""
