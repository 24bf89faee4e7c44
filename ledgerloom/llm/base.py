"""Shared pieces of the corpus operators: tables in the shared folder, text rules and word hashing.

Word hashing is vectorised: a whole Arrow batch of texts is joined into one byte buffer and hashed with a
prefix-sum polynomial, so no Python loop runs per word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import cut as stored
from ..plans.session import release as release  # noqa: PLC0414

#: Fixed by the corpus contracts: the separators of words, and what is stripped from lines.
WHITESPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes that one vectorised step handles at most (a longer single word extends it).
STEP_BYTES = 1 << 20
#: Groups (labels, languages) that a bounded sample draws from at most.
MAX_GROUPS = 1024


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored_in_small_batches(df: DataFrame, name: str, most: str = "8m") -> DataFrame:
    """`stored`, with Arrow batches of few bytes: for rows that carry texts, so that a task holds little at a time."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, most)
    try:
        return stored(df, name)
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def bucket_of_id(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def sample_threshold(most: int, rows: Column) -> Column:
    """Below it lie about twice `most` of so many rows' hashes modulo 2**30, however many rows there are."""
    return F.greatest(F.lit(1.0), F.least(F.lit(1.0), F.lit(2.0 * most + 200) / rows) * (1 << 30))


def bounded_sample(rows: DataFrame, group: str, key: str, size: str, most: int, most_bytes: int) -> DataFrame:
    """At most `most` rows of each group, by ascending `key` (a hash), whose sizes sum to at most most_bytes, with their
    rank `nth`; equal rows count once. Only rows with keys below a threshold are ranked: it follows from the group's
    count and leaves a few more than needed, so that no group is sorted in one place however large it is. The counts of
    the MAX_GROUPS largest groups go to all tasks, so rows move only after the threshold; other groups give no rows."""
    counts = rows.groupBy(group).agg(F.count("*").alias("_all")).orderBy(F.desc("_all"), group).limit(MAX_GROUPS)
    near = rows.join(F.broadcast(counts), group).where(F.pmod(key, F.lit(1 << 30)) < sample_threshold(most, F.col("_all"))).select(rows.columns).distinct()
    order = Window.partitionBy(group).orderBy(F.pmod(key, F.lit(1 << 30)), key, *[c for c in rows.columns if c not in (group, key)])
    ranked = near.withColumns({"nth": F.row_number().over(order), "_sum": F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    return ranked.where((F.col("nth") <= most) & (F.col("_sum") <= most_bytes)).drop("_sum")


def utf8(text: object) -> bytes:
    """The text as UTF-8; null (None or NaN) is empty."""
    return text.encode("utf-8") if isinstance(text, str) else b""


def batches(texts: Sequence[object], lower: bool = False, most: int = STEP_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive runs of texts of about `most` bytes each, with the index of the first; a long text stands alone."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        data = utf8(text)
        if lower:
            data = data.lower()  # bytes.lower changes A-Z only
        if run and size + len(data) > most:
            yield first, run
            first, run, size = i, [], 0
        run.append(data)
        size += len(data)
    if run:
        yield first, run


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all 64 bits depend on all others."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_ROOT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_ROOT, -1, 1 << 64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(WHITESPACE)] = True
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base to the 0 .. n-1, modulo 2**64; kept and doubled as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, dtype=np.uint64)
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        _powers[base] = have
    return have[:n]


def _hash_step(data: bytes, stem: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and start of each word of one buffer; stem: hash the first so many bytes of a word only."""
    buf = np.frombuffer(data, dtype=np.uint8)
    space = _IS_SPACE[buf]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, dtype=np.uint64), start
    if stem:
        end = np.minimum(end, start + stem)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * _power(_ROOT, len(buf)), out=total[1:])
    return _mix((total[end] - total[start]) * _power(_INVERSE, len(buf))[start]), start


def hash_words(run: Sequence[bytes], stem: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, words in each text). A text longer than a step is cut at separators, so
    memory follows the step and not the text."""
    if len(run) == 1 and len(run[0]) > 2 * STEP_BYTES:
        data, at, parts = run[0], 0, []
        while at < len(data):
            cut = at + STEP_BYTES
            while cut < len(data) and data[cut] not in WHITESPACE:
                cut += 1
            parts.append(_hash_step(data[at:cut], stem)[0])
            at = cut
        hashes = np.concatenate(parts)
        return hashes, np.array([len(hashes)])
    offsets = np.cumsum([0] + [len(x) + 1 for x in run])
    hashes, start = _hash_step(b"\n".join(run), stem)
    return hashes, np.diff(np.searchsorted(start, offsets))


def shingle_sets(run: Sequence[bytes], width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word shingles; with fewer words the whole sequence is one
    shingle; without words the set is empty."""
    hashes, counts = hash_words(run)
    rolled = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(width):
        factor = np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64))
        rolled[: max(0, len(hashes) - k)] += hashes[k:] * factor
    rolled, out, at = _mix(rolled), [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            short = sum(int(h) * pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64) for k, h in enumerate(hashes[at : at + n])) + n
            out.append(_mix(np.array([short & (1 << 64) - 1], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def crc_fold(doc_id: object, modulus: int) -> int:
    """bucket_of_id for one Python value."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus
