"""Near duplicates by HyperMinHash (after Yu and Weber 2017), with links confirmed on whole sets.

Each of BUCKETS buckets has its own hash of shingles and keeps the least value of a set, compressed to 16 bits: the number
of its leading zeros (6 bits) and the MANTISSA bits behind the first one. Two sets agree in a bucket with a chance of their
Jaccard similarity, and by collision of registers besides. BANDS bands of ROWS registers each name a list of sets. A pair
that links (0.85) shares no band with a chance of (1 - 0.85^5)^32 = 7e-9. The estimate before verification takes the
expected collisions of two sets of these sizes out of the share of agreeing buckets; pairs below FLOOR, 5 standard
deviations under 0.85 at least, are not read. In front of it a parity sketch bounds the difference of two sets from below
in the JVM, which tells the many pairs a little under the threshold apart. What passes is confirmed on the whole sets. Lists aren't expanded into pairs: near_classes merges them into neighbourhoods.

Sets of any size fill all buckets, so short texts are found as surely as long ones. Equal sets are one class from the
start, and one text of each different set is read after the first pass.

Defined cases: as in the n-gram join: null and empty texts have the empty set, which links with nothing and is its own
class; a text of one or two words is one shingle; every row is a document, also where ids repeat; ids alone link nothing; a
null id ranks behind all ids for a class's id (a class of null ids only has a null id); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import _mix, batches, release, shingle_sets, stored, stored_in_small_batches
from .near_classes import Link, documents_of, fingerprint, least_of_each, linked_classes, one_text_each, parity_words, sketch_distance, told_apart, with_classes

WIDTH, PERCENT = 3, 85
#: Buckets of a sketch, in bands of rows; mantissa bits of a register.
BANDS, ROWS = 32, 5
BUCKETS = BANDS * ROWS
MANTISSA = 10
#: Pairs estimated below this similarity aren't read.
FLOOR = 0.65
#: Shingles hashed at once.
STEP = 1 << 17

_SALT = _mix(np.arange(1, BUCKETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTOR = _mix(_SALT) | np.uint64(1)


def registers(least: np.ndarray) -> np.ndarray:
    """The compressed registers of least hash values: leading zeros in the high 6 bits, then the mantissa."""
    high = np.frexp(least.astype(np.float64))[1].astype(np.int64)  # bits in use; rounding up to a power of two is mended below
    high -= (high > 0) & (least >> np.maximum(high - 1, 0).astype(np.uint64) == 0)
    zeros = np.minimum(63, 64 - high).astype(np.uint64)
    behind = (least << zeros) << np.uint64(1)
    return (zeros << np.uint64(MANTISSA) | behind >> np.uint64(64 - MANTISSA)).astype(np.uint16)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BUCKETS) registers of non-empty sets of shingle hashes."""
    sizes = np.array([len(s) for s in sets])
    least = np.full((BUCKETS, len(sets)), np.iinfo(np.uint64).max, np.uint64)
    ends, first = np.cumsum(sizes), 0
    while first < len(sets):
        upto = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + STEP, side="right")))
        own = np.concatenate(sets[first:upto])
        at = np.cumsum(sizes[first:upto]) - sizes[first:upto]
        for step in range(0, len(own), STEP) if upto - first == 1 else (0,):  # a long set goes in steps
            part = own[step : step + STEP] if upto - first == 1 else own
            for k in range(BUCKETS):
                least[k, first:upto] = np.minimum(least[k, first:upto], np.minimum.reduceat((part ^ _SALT[k]) * _FACTOR[k], at))
        first = upto
    return np.ascontiguousarray(registers(least).T)


@lru_cache(1 << 14)
def _collisions(n: float, m: float) -> float:
    """Chance that registers of two disjoint sets of n and m elements agree: over all registers, the product of both sets'
    chances to have their least value there. Mantissas are taken 16 at a time, within which the chances hardly change."""
    zeros, part = np.arange(0, 64)[:, None], np.arange(16)[None, :]
    low = 2.0 ** -(zeros + 1.0) * (1 + part / 16)
    high = low + 2.0 ** -(zeros + 1.0) / 16
    own = [np.exp(k * np.log1p(-low)) - np.exp(k * np.log1p(-np.minimum(high, 1 - 1e-16))) for k in (n, m)]
    return float((own[0] * own[1]).sum() / (1 << MANTISSA - 4))


def estimate(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from agreeing buckets, without expected collisions (sizes in steps of a fifth of an octave)."""
    steps = [np.round(5 * np.log2(np.maximum(x, 1))).astype(int) for x in (n, m)]
    by = np.array([_collisions(2 ** (min(a, b) / 5), 2 ** (max(a, b) / 5)) for a, b in zip(*steps, strict=True)])
    return np.clip((agree / BUCKETS - by) / (1 - by), 0, 1)


def _estimated(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    a, b = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, BUCKETS) for s in (x, y))
    return pd.Series(estimate((a == b).sum(axis=1), n.to_numpy(), m.to_numpy()), dtype=float)


def set_table(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, n, ref, registers, words): size of each document's set, the fingerprint that equal sets share, and the
    sketches; null where the set is empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            n, ref, regs, words = [], [], [], []
            for _, part in batches(pdf["text"], lower=True):
                sets = shingle_sets(part, WIDTH)
                n += [len(s) for s in sets]
                ref += [fingerprint(s) for s in sets]
                full = [s for s in sets if len(s)]
                got = sketches(full) if full else np.zeros((0, BUCKETS), np.uint16)
                rows = iter(got)
                regs += [next(rows).tobytes() if len(s) else None for s in sets]
                words += [parity_words(s) if len(s) else None for s in sets]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "tid": pdf["tid"], "n": np.array(n, np.int64), "ref": np.array(ref, np.int64), "registers": regs, "words": words})

    return told_apart(docs).mapInPandas(run, "doc_id long, tid long, n long, ref long, registers binary, words array<long>")


def band_lists(sets: DataFrame) -> DataFrame:
    """(lid, ref): sets that agree in all registers of a band, for lists of two sets at least; of lists with the same sets
    one is kept."""
    each = sets.where("n > 0").groupBy("ref").agg(F.min("registers").alias("registers"))
    keys = F.array(*[F.xxhash64(F.lit(k), F.substring("registers", 1 + 2 * ROWS * k, 2 * ROWS)) for k in range(BANDS)])
    rows = stored(each.select("ref", F.explode(keys).alias("band")), "bands")
    kinds = rows.groupBy("band").agg(F.bit_xor(F.xxhash64("ref")).alias("lid"), F.count("*").alias("c")).where("c > 1").groupBy("lid").agg(F.min("band").alias("band"))
    lists = stored(rows.join(kinds.hint("merge"), "band").select("lid", "ref"), "lists")
    release(rows)
    return lists


def _parity_allows() -> Column:
    """Of x + y elements at 0.85 at most 3 / 37 are in one of the sets only."""
    return 37 * sketch_distance("xwords", "ywords") <= 3 * (F.col("xn") + F.col("yn"))


def _estimate_allows() -> Column:
    return F.pandas_udf(_estimated, "double")("xregisters", "yregisters", "xn", "yn") >= FLOOR


LINK = Link(WIDTH, PERCENT, ("words",), _parity_allows, ("registers",), _estimate_allows)


def _classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(each document's set, the class of each set that isn't empty)."""
    sets = stored_in_small_batches(set_table(docs), "sets")
    texts = stored(one_text_each(docs, sets), "texts")
    linked = linked_classes(band_lists(sets), sets, texts, LINK)
    release(texts)
    return sets, with_classes(sets, linked)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per document; kept: its id names its class."""
    return documents_of(*_classified(docs)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each class the document with the least id (one row of it), with all columns; documents without words stay."""
    return least_of_each(docs, *_classified(docs))
