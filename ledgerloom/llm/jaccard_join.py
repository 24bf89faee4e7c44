"""Exact n-gram Jaccard self-join, size-aware (after Deng, Tao, Li 2018), and its connected classes.

Light sets (few shingles) are joined by enumerating fixed-size subsets: two sets of sizes a and b link exactly if they
share a subset of the least overlap that the threshold asks of these sizes. Heavy sets are joined over inverted lists
of their prefixes: in one global order of all shingles, linked sets share one of each set's first n - ceil(3n/4) + 1.
The order puts shingles of many documents last (passages, group texts), so that lists stay short; which ones those are
is counted over all documents. The boundary between light and heavy is where the modelled rows are fewest.

Lists are split by bands of sizes, as sets of unlike sizes can't link. They are never expanded into all pairs: near_classes merges them into neighbourhoods and finds the classes. Before any
text is read, sizes and a parity sketch must allow a link: every element that two sets don't share flips one of the
sketch's bits, so a pair whose sketches differ in more bits than a link may differ in elements can't link.
Identical sets are one class from the start, and only one text of each set is read after the first pass. So no link is
lost, and a group of thousands of near copies costs a few comparisons a copy.

Lists of shingles are packed in buckets of about equal size (numpy inside tasks, Spark moves the buckets); those of
frequent shingles go through grouped joins instead, which split hot keys.

Defined cases: null and empty texts have the empty set, which links with nothing and is its own class; a text of one
to four words is one shingle; every row is a document, also where ids repeat (with the same or other texts), and ids
alone link nothing; a null id is kept, its texts link like others, and it ranks behind all ids for a class's id (a class
of null ids only has a null id); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import _mix, batches, release, shingle_sets, stored, stored_in_small_batches
from .near_classes import SKETCH_WORDS, Link, documents_of, fingerprint, least_of_each, linked_classes, one_text_each, parity, parity_words, sketch_distance, told_apart, with_classes

#: Link if 100 * intersection >= 75 * union: numerator and denominator of the overlap of two sets, 3/7 of all.
NUM, DEN = 3, 4
WIDTH = 5
#: A shingle in so many different sets is frequent; of those, the most frequent so many are ordered last.
FREQUENT, MOST_FREQUENT = 24, 1 << 19
BUCKET_TOKENS = 3 << 20
MAX_LIGHT = 10


def least_overlap(a: int, b: int) -> int:
    return -(-NUM * (a + b) // (NUM + DEN))


def may_link(a: int, b: int) -> bool:
    return DEN * min(a, b) >= NUM * max(a, b)


#: Widths of the bands of sizes: sets that may link are in one band or in two neighbouring ones. A little wider than the
#: threshold's ratio, so that rounding puts none further away.
BAND = log(1.001 * DEN / NUM)


def size_band(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / BAND).astype(np.int64)


def subset_rows(n: int, light: int) -> int:
    """Subsets that a light set of n enumerates."""
    return sum(comb(n, least_overlap(n, b)) for b in range(1, light + 1) if may_link(n, b))


def boundary(sizes: dict[int, int], list_length: float) -> int:
    """The largest size of light sets at least modelled cost: enumerated subsets against scanned postings."""

    def cost(light: int) -> float:
        rows = sum(c * subset_rows(n, light) for n, c in sizes.items() if 0 < n <= light)
        return rows + sum(c * (n // 4 + 1) * list_length for n, c in sizes.items() if DEN * n >= NUM * (light + 1))

    return min(range(MAX_LIGHT + 1), key=lambda x: (cost(x), x))


def _wide(s: np.ndarray) -> bytes | None:
    """A parity sketch of at least as many bits as elements, a power of two; None where the narrow one has as many."""
    return parity(s, 1 << (len(s) - 1).bit_length()).tobytes() if len(s) > 64 * SKETCH_WORDS else None


def _may_match(x: pd.Series, y: pd.Series, n: pd.Series) -> pd.Series:
    """Whether wide sketches of sets with n elements together allow a link; the wider one is folded."""

    def one(a: bytes | None, b: bytes | None, total: int) -> bool:
        if a is None or b is None:
            return True
        p, q = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
        while len(q) > len(p):
            q = q[: len(q) // 2] ^ q[len(q) // 2 :]
        return 7 * int(np.bitwise_count(p ^ q).sum()) <= total

    return pd.Series([one(a, b, t) for a, b, t in zip(x, y, n, strict=True)], dtype=bool)


def set_table(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, n, ref, the sketches): size of each document's set, and the fingerprint that equal sets share."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sets = [s for _, part in batches(pdf["text"], lower=True) for s in shingle_sets(part, WIDTH)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "tid": pdf["tid"], "n": np.array([len(s) for s in sets], np.int64), "ref": np.array([fingerprint(s) for s in sets], np.int64), "words": [parity_words(s) for s in sets], "wide": [_wide(s) for s in sets]})

    return told_apart(docs).mapInPandas(run, "doc_id long, tid long, n long, ref long, words array<long>, wide binary")


def _keys(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the high half, 32 bits of the token in the low half: what identifies a list."""
    return (tokens % np.uint64(buckets)).astype(np.int64) << 32 | (tokens >> np.uint64(32)).astype(np.int64)


def _packed(parts: list[np.ndarray], *columns: list[np.ndarray]) -> pd.DataFrame:
    keys = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    order = np.argsort(keys >> 32, kind="stable")
    keys, rest = keys[order], [np.concatenate(c)[order] if c else np.zeros(0, np.int64) for c in columns]
    bucket = keys >> 32
    at = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = [*at[1:], len(keys)] if len(at) else []
    out = {"bucket": bucket[at].astype(np.int32), "tokens": [(keys[a:b] & 0xFFFFFFFF).astype(np.uint32).tobytes() for a, b in zip(at, ends, strict=True)]}
    for name, c in zip(("refs", "sizes"), rest, strict=False):
        out[name] = [c[a:b].tobytes() for a, b in zip(at, ends, strict=True)]
    return pd.DataFrame(out)


def frequent_shingles(texts: DataFrame, buckets: int) -> DataFrame:
    """(key, df): shingles in at least FREQUENT different sets."""

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in frames:
            for _, part in batches(pdf["text"], lower=True):
                for s in shingle_sets(part, WIDTH):
                    held.append(_keys(s, buckets))
                    size += len(s)
                if size > 1 << 20:
                    yield counted(held)
                    held, size = [], 0
        yield counted(held)

    def counted(held: list[np.ndarray]) -> pd.DataFrame:
        """A task's own counts: a shingle of many sets travels once for each million shingles, not once for each set."""
        keys, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return _packed([keys], [n.astype(np.int32)])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["tokens"]])
        n = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["refs"]])
        order = np.argsort(t, kind="stable")
        t = t[order]
        at = np.flatnonzero(np.diff(t.astype(np.int64), prepend=-1))
        n = np.add.reduceat(n[order], at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)
        keep = n >= FREQUENT
        return pd.DataFrame({"key": t[at][keep].astype(np.int64) | int(pdf["bucket"].iloc[0]) << 32, "df": n[keep]})

    return texts.select("text").mapInPandas(emit, "bucket int, tokens binary, refs binary").groupBy("bucket").applyInPandas(count, "key long, df long")


class _Order:
    """The global order of shingles: frequent ones last, else by hash."""

    def __init__(self, frequent: np.ndarray, buckets: int, light: int):
        self.frequent, self.buckets, self.light = np.sort(frequent), buckets, light
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[self.frequent & (1 << 20) - 1] = True

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys of rare shingles, of frequent shingles) in a set's prefix."""
        keys = _keys(s, self.buckets)
        hot = self.maybe[keys & (1 << 20) - 1]
        if hot.any():
            at = np.flatnonzero(hot)
            hot[at] = self.frequent[np.minimum(np.searchsorted(self.frequent, keys[at]), len(self.frequent) - 1)] == keys[at]
        p = len(s) - -(-NUM * len(s) // DEN) + 1
        rare = keys[~hot][:p]
        return rare, keys[hot][: p - len(rare)]

    def subsets(self, s: np.ndarray) -> np.ndarray:
        """Keys of a light set's subsets, one kind for each pair of sizes."""
        n, out = len(s), []
        for b in range(1, self.light + 1):
            if may_link(n, b):
                kind = f"{min(n, b)}:{max(n, b)}:".encode()
                out += [xxhash.xxh3_64_intdigest(kind + np.array(c, np.uint64).tobytes()) for c in combinations(s.tolist(), least_overlap(n, b))]
        return _keys(np.array(out, np.uint64), self.buckets)


def _postings(texts: DataFrame, order: _Order) -> DataFrame:
    """Packed postings of rare shingles and subsets, and of frequent shingles."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[list[list[np.ndarray]], ...] = ([[], [], []], [[], [], []])  # rare, frequent: keys, refs, sizes
        size = 0

        def flush() -> Iterator[pd.DataFrame]:
            for frequent, (keys, refs, sizes) in enumerate(held):
                yield _packed(keys, refs, sizes).assign(frequent=bool(frequent))
                for x in (keys, refs, sizes):
                    x.clear()

        for pdf in frames:
            for first, part in batches(pdf["text"], lower=True):
                for ref, s in zip(pdf["ref"].iloc[first : first + len(part)], shingle_sets(part, WIDTH), strict=True):
                    found = order.prefix(s) if DEN * len(s) >= NUM * (order.light + 1) else (s[:0].view(np.int64),) * 2
                    if len(s) <= order.light:
                        found = np.concatenate([found[0], order.subsets(s)]), found[1]
                    for got, (keys, refs, sizes) in zip(found, held, strict=True):
                        if len(got):
                            keys.append(got)
                            refs.append(np.full(len(got), ref, np.int64))
                            sizes.append(np.full(len(got), len(s), np.int32))
                            size += len(got)
                if size > 1 << 19:
                    yield from flush()
                    size = 0
        yield from flush()

    return texts.mapInPandas(run, "bucket int, tokens binary, refs binary, sizes binary, frequent boolean")


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Packed postings as rows (key, ref, n)."""
    for pdf in frames:
        for bucket, tokens, refs, sizes in zip(pdf["bucket"], pdf["tokens"], pdf["refs"], pdf["sizes"], strict=True):
            key = np.frombuffer(tokens, np.uint32).astype(np.int64) | int(bucket) << 32
            yield pd.DataFrame({"key": key, "ref": np.frombuffer(refs, np.int64), "n": np.frombuffer(sizes, np.int32).astype(np.int64)})


LISTS = "lid long, ref long, n long"


def _short_lists(pdf: pd.DataFrame) -> pd.DataFrame:
    """The lists of one bucket with two sets or more, each kind of list once."""
    t = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["tokens"]])
    r = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["refs"]])
    n = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["sizes"]])
    order = np.argsort(t, kind="stable")
    t, r, n = t[order], r[order], n[order]
    twin = np.zeros(len(t), dtype=bool)  # only tokens that occur twice matter
    same = t[1:] == t[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    t, r, n = t[twin], r[twin], n[twin]
    order = np.lexsort((r, t))
    t, r, n = t[order], r[order], n[order]
    new = np.ones(len(t), dtype=bool)
    new[1:] = (t[1:] != t[:-1]) | (r[1:] != r[:-1])
    t, r, n = t[new], r[new], n[new]
    if not len(t):
        return pd.DataFrame({"lid": np.zeros(0, np.int64), "ref": r, "n": n.astype(np.int64)})
    # each list falls into those of two neighbouring bands of sizes; a set is in both of its band's
    t = t.astype(np.int64) << 8 | size_band(n)
    t, r, n = np.concatenate([t, t + 1]), np.tile(r, 2), np.tile(n, 2)
    order = np.lexsort((r, t))
    t, r, n = t[order], r[order], n[order]
    at = np.flatnonzero(np.diff(t, prepend=-1))
    size = np.diff(np.append(at, len(t)))
    sign = np.add.reduceat(_mix(r.view(np.uint64)), at).view(np.int64)
    _, first = np.unique(sign, return_index=True)
    first = first[size[first] > 1]
    keep = np.zeros(len(at), dtype=bool)
    keep[first] = True
    rows = np.repeat(keep, size)
    return pd.DataFrame({"lid": np.repeat(sign, size)[rows], "ref": r[rows], "n": n[rows].astype(np.int64)})


def candidate_lists(texts: DataFrame, sets: DataFrame) -> DataFrame:
    """(lid, ref, n): every linked pair of different sets is together in one list at least."""
    small = {r["n"]: r["c"] for r in sets.where(F.col("n") <= 2 * MAX_LIGHT).groupBy("n").agg(F.count("*").alias("c")).collect()}
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_TOKENS))
    counted = stored_in_small_batches(frequent_shingles(texts, buckets), "frequent")
    top = counted.orderBy(F.desc("df"), "key").limit(MOST_FREQUENT).toPandas()  # bounded: 8 MB of keys
    light = boundary(small, 1 + float((top["df"].astype(float) ** 2).sum()) / max(1.0, total))
    order = _Order(top["key"].to_numpy(np.int64), buckets, light)
    postings = stored_in_small_batches(_postings(texts, order), "postings")
    short = postings.where("not frequent").drop("frequent").groupBy("bucket").applyInPandas(_short_lists, LISTS)
    long = postings.where("frequent").drop("frequent").mapInPandas(_rows, "key long, ref long, n long").dropDuplicates(["key", "ref"])
    rows = long = stored_in_small_batches(long, "frequent-postings")
    band = F.floor(F.ln("n") / BAND).cast("int")  # as in _short_lists
    long = long.select(F.explode(F.array(*[F.xxhash64("key", band + k) for k in (0, 1)])).alias("key"), "ref", "n")
    kinds = long.groupBy("key").agg(F.bit_xor(F.xxhash64("ref")).alias("lid"), F.count("*").alias("c")).where("c > 1").groupBy("lid").agg(F.min("key").alias("key"))
    whole = long.join(kinds.hint("merge"), "key").select("lid", "ref", "n")
    lists = stored_in_small_batches(short.unionByName(whole).dropDuplicates(["lid", "ref"]), "lists")
    release(postings, rows, counted)
    return lists


def _may_link_columns() -> Column:
    return 7 * sketch_distance("xwords", "ywords") <= F.col("xn") + F.col("yn")


def _wide_may_link() -> Column:
    return F.pandas_udf(_may_match, "boolean")("xwide", "ywide", F.col("xn") + F.col("yn"))


LINK = Link(WIDTH, 75, ("words",), _may_link_columns, ("wide",), _wide_may_link)


def _classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(each document's set, the class of each set that isn't empty)."""
    sets = stored_in_small_batches(set_table(docs), "sets")
    texts = stored(one_text_each(docs, sets), "texts")
    linked = linked_classes(candidate_lists(texts, sets), sets, texts, LINK)
    release(texts)
    return sets, with_classes(sets, linked)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per document."""
    return documents_of(*_classified(docs))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: of each class of near duplicates the document with the least id stays (one row of it);
    documents without words stay."""
    return least_of_each(docs, *_classified(docs))
