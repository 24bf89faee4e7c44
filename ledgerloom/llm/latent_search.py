"""Benchmark decontamination by latent semantic retrieval.

1. Passages of all documents are hashed TF-IDF vectors (document frequencies over the whole corpus).
2. A randomised SVD of the passage matrix (Halko, Martinsson, Tropp 2011) gives a latent basis: each task multiplies
   its passages with a thin random matrix, the small products are summed over tasks, and power iterations sharpen
   them. The basis is fitted on all passages of all documents and of all items.
3. All passages of all documents are projected and compared with all benchmark passages by cosine.
4. Candidates are checked on words: longest common subsequence with the item, and whether the item's answer (its last
   words) is there in order. So an edited or partly quoted item is found, and a merely similar topic is not.

One basis serves the whole benchmark. Items are compared in blocks of at most MAX_ITEMS (each another pass over the
corpus), so what goes to the executors has a fixed bound.

Defined cases: null and empty texts hold no passage; items without words are skipped; a document shorter than a
window is one passage; an empty benchmark or corpus gives no rows; repeated rows are found each; extra columns are
ignored; null ids are found like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import STEP_BYTES, WORD_PATTERN, batches, bounded_sample, hash_words, load, release, stored, stored_in_small_batches, utf8

BITS = 15
RANK = 64
#: The first components hold words that all passages share; they tell no passages apart. An eighth of the components that
#: the passages have is left out, so many at most.
SKIP = 4
#: The benchmark's own passages count so much in the fit.
OWN_WEIGHT = 3.0
#: Words of a window, of the step between a document's windows, and between an item's.
WINDOW, STEP, ITEM_STEP = 32, 16, 8
POWER_ITERATIONS = 1
#: In the fit all documents together weigh as much as so many at most.
FIT_DOCS = 2000
#: Runs of STEP rows that are gathered at once.
GATHERED = 64
#: Bounds of fit_sample: documents, the bytes of their texts, and those of a text.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_TEXT = 2000, 64 << 20, 1 << 18
#: Items compared in one pass and the bytes of their texts. In the fit all items together weigh as much as so many at most.
MAX_ITEMS, ITEM_BYTES = 4096, 16 << 20
#: Tasks' arrays that are summed in one place.
FAN_IN = 16
MIN_COSINE = 0.6
#: Share of an item window's distinct word slots that a candidate window holds at least, before words are compared.
MIN_SHARED = 0.35
#: An item counts as found if so much of its words is in common order, or less together with its answer.
MIN_LCS, MIN_LCS_WITH_ANSWER, ANSWER_WORDS = 0.7, 0.55, 6
_SLOT = np.uint64(64 - BITS)


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> _SLOT).astype(np.int64)


def word_slots(docs: DataFrame) -> DataFrame:
    """(k, n, df, slots, words), stored: of each run of texts the slots of all words, two bytes each, and the words in each
    text; of each task the number of its documents and packed counts of those that hold each slot."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(1 << BITS, dtype=np.int64), 0
        for pdf in frames:
            for _, run in batches(pdf["text"], lower=True):
                h, words = hash_words(run)
                s, doc = _slots(h), np.repeat(np.arange(len(words)), words)
                held = np.sort(doc << BITS | s)
                df += np.bincount(held[np.diff(held, prepend=-1) != 0] & (1 << BITS) - 1, minlength=1 << BITS)
                n += len(run)
                yield pd.DataFrame({"k": [None], "n": [None], "df": [None], "slots": [s.astype(np.uint16).tobytes()], "words": [words.astype(np.int64).tobytes()]})
        yield pd.DataFrame({"k": [0], "n": [n], "df": [df.tobytes()], "slots": [None], "words": [None]})

    return stored_in_small_batches(docs.select("text").mapInPandas(count, "k int, n long, df binary, slots binary, words binary"), "word-slots")


def document_frequencies(slots: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold each word slot, documents), over the whole corpus. A vector of 2**BITS counts a task is
    packed and summed, so the driver gets one vector."""
    return _summed(slots.where("df is not null").select("k", "n", "df"), np.int64)


def _summed(parts: DataFrame, dtype: type) -> tuple[np.ndarray, int]:
    """Sum of the tasks' packed arrays, in a tree: no task gathers more than FAN_IN of them."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf["df"].iloc[0]) // np.dtype(dtype).itemsize, dtype=dtype)
        for x in pdf["df"]:
            total += np.frombuffer(x, dtype=dtype)
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "n": [int(pdf["n"].sum())], "df": [total.tobytes()]})

    kept = stored_in_small_batches(parts.withColumn("k", F.spark_partition_id()), "task-arrays")
    level, n = kept, (kept.agg(F.max("k")).first()[0] or 0) + 1
    while n > 1:
        n = -(-n // FAN_IN)
        level = level.withColumn("k", F.floor(F.col("k") / FAN_IN).cast("int")).groupBy("k").applyInPandas(add, "k int, n long, df binary")
    rows = level.collect()
    release(kept)
    if not rows:
        return np.zeros(0, dtype), 0
    return sum(np.frombuffer(r["df"], dtype=dtype) for r in rows), sum(r["n"] for r in rows)


def idf_weights(df: np.ndarray, n: int) -> np.ndarray:
    """Squared, as a passage's few rare words say what it is."""
    full = np.zeros(1 << BITS) if not len(df) else df
    return (np.log((1 + n) / (1 + full)) ** 2).astype(np.float32)


def _item_windows(slots: np.ndarray) -> list[tuple[int, int]]:
    n = len(slots)
    return [(a, min(n, a + WINDOW)) for a in range(0, max(1, n - WINDOW + ITEM_STEP), ITEM_STEP)] if n else []


def _steps(starts: np.ndarray, many: np.ndarray, step: int) -> np.ndarray:
    """From each start so many positions, each a step behind the one before."""
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(starts, many) + step * nth


def _windows(words: np.ndarray) -> np.ndarray:
    """First words of the windows of texts that lie one behind the other; within a text they lie side by side, so that each
    word is in one of them."""
    return _steps(np.cumsum(words) - words, -(-words // WINDOW), WINDOW)


def _sums(values: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows values[at] from each start to the next. Runs of STEP rows are summed as products with a row of ones,
    then runs of half as many of what is left, down to one row; few are gathered at a time, which stay in the processor's
    cache."""
    cols, left, begin, step = values.shape[1], np.diff(np.append(starts, len(at))), starts.copy(), STEP
    out, held = np.zeros((len(starts), cols), np.float32), np.empty((GATHERED * STEP, cols), np.float32)
    while step:
        own, ones = np.flatnonzero(left >= step), np.ones((1, step), np.float32)
        many = left[own] // step
        first, parts = _steps(begin[own], many, step)[:, None] + np.arange(step), GATHERED * STEP // step
        runs = np.empty((len(first), cols), np.float32)
        for i in range(0, len(first), parts):
            rows = at[first[i : i + parts]]
            np.matmul(ones, np.take(values, rows, axis=0, out=held[: rows.size].reshape(*rows.shape, cols), mode="clip"), out=runs[i : i + parts, None])
        if len(own):
            out[own] += np.add.reduceat(runs, np.cumsum(many) - many, axis=0) if step == STEP else runs
        begin[own] += step * many
        left %= step
        step //= 2
    return out


def _product(s: np.ndarray, starts: np.ndarray, per_word: np.ndarray, idf: np.ndarray, out: np.ndarray) -> None:
    """out += A^T (A q) for the matrix A of normalised windows, before out's rows are weighed by idf: a window's row is the
    sum over its words. s: slots of all words; starts: the windows' first words; per_word: q's rows weighed by idf."""
    if not len(s):
        return
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(s))))
    key = np.sort(row << BITS | s)
    at = np.flatnonzero(np.diff(key, prepend=-1))
    v = np.diff(np.append(at, len(key))) * idf[key[at] & (1 << BITS) - 1]
    square = np.bincount(key[at] >> BITS, v * v, len(starts))
    y = _sums(per_word, s, starts)
    y *= np.divide(1.0, square, out=np.zeros_like(square), where=square > 0)[:, None].astype(np.float32)
    order = np.argsort(s.astype(np.uint16), kind="stable")
    s, row = s[order], row[order]
    at = np.flatnonzero(np.diff(s, prepend=-1))
    out[s[at]] += _sums(y, row, at)


def _item_words(text: str) -> list[bytes]:
    return utf8(text).lower().split()


def fit_sample(docs: DataFrame, most: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(text): the documents with the least hashes of id and text, bounded in rows and bytes at any size of the corpus; equal
    rows count once. A small extract for looking at a corpus: no step of the search reads it."""
    rows = docs.select(F.lit(0).alias("all"), F.xxhash64("doc_id", "text", F.lit(3)).alias("key"), F.octet_length("text").alias("size"), "text")
    return bounded_sample(rows.where(F.col("size") <= SAMPLE_TEXT), "all", "key", "size", most, most_bytes).select("text")


def basis(slots: DataFrame, n_docs: int, items: DataFrame, n_items: int, idf: np.ndarray, rank: int = RANK, seed: int = 1) -> np.ndarray:
    """The right singular vectors (2**BITS rows, without the first ones) of all passages of all documents and all items, by
    randomised power iteration, scaled by the root of their strength, so that strong components don't drown the others.
    Documents weigh FIT_DOCS together at most and items MAX_ITEMS, so that neither outweighs the other as it grows."""
    weights = min(1.0, FIT_DOCS / max(1, n_docs)), OWN_WEIGHT**2 * min(1.0, MAX_ITEMS / max(1, n_items))
    rows = slots.where("df is null").select("slots", "words").unionByName(items.select("text"), allowMissingColumns=True)
    # each task makes an array of its own, so there are no more tasks than keep all cores busy
    rows = rows.coalesce(2 * slots.sparkSession.sparkContext.defaultParallelism)
    rng = np.random.default_rng(seed)
    q = np.empty((1 << BITS, rank), dtype=np.float32)
    for at in range(0, 1 << BITS, 4096):  # no copy of it in double precision is made
        q[at : at + 4096] = rng.normal(size=(4096, rank))

    for _ in range(1 + POWER_ITERATIONS):

        def step(frames: Iterator[pd.DataFrame], q: np.ndarray = q) -> Iterator[pd.DataFrame]:
            per_word = idf[:, None] * q
            sums = [np.zeros((1 << BITS, rank), dtype=np.float32) for _ in weights]
            for pdf in frames:
                for s, words in zip(pdf["slots"].dropna(), pdf["words"].dropna(), strict=True):
                    _product(np.frombuffer(s, np.uint16).astype(np.int64), _windows(np.frombuffer(words, np.int64)), per_word, idf, sums[0])
                for _, run in batches(pdf["text"].dropna(), lower=True):
                    each = [_slots(hash_words([b" ".join(x.split())])[0]) for x in run]
                    each = [s[a:b] for s in each for a, b in _item_windows(s)]
                    if each:
                        _product(np.concatenate(each), np.cumsum([0, *map(len, each[:-1])]), per_word, idf, sums[1])
            sums[0] *= np.float32(weights[0])
            sums[0] += np.float32(weights[1]) * sums[1]
            yield pd.DataFrame({"k": [0], "n": [0], "df": [(idf[:, None] * sums[0]).tobytes()]})

        got, _ = _summed(rows.mapInPandas(step, "k int, n long, df binary"), np.float32)
        q, strength = _left_vectors(got.reshape(1 << BITS, rank) if len(got) else np.zeros((1 << BITS, rank), np.float32))
    skip = min(SKIP, int((strength > 0).sum()) // 8)
    return (q / np.maximum(strength, 1e-9) ** 0.25)[:, skip:].astype(np.float32)


def _left_vectors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left singular vectors and values of a tall matrix, strongest first, by its small Gram matrix: no copy of it in
    double precision is made. Values that single precision can't tell from zero are zero, with zero vectors."""
    gram = sum(part.T @ part for at in range(0, len(b), 4096) for part in [b[at : at + 4096].astype(np.float64)])
    values, right = np.linalg.eigh(gram)
    strength = np.sqrt(np.maximum(values[::-1], 0))
    strength[strength <= 1e-6 * max(strength[0], 1e-30)] = 0
    scale = np.divide(1.0, strength, out=np.zeros_like(strength), where=strength > 0)
    return b @ (right[:, ::-1] * scale).astype(np.float32), strength


def _lcs(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, with one machine word operation a word of b."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        u = row & where.get(w, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


_EDGE = b".,;:!?'\"()[]"


def _plain(words: list[bytes]) -> list[bytes]:
    return [w.strip(_EDGE) or w for w in words]


FOUND = "doc_id long, tid long, item_id long, cosine double, lcs double, answer boolean"


def search(docs: DataFrame, items: list[tuple[int, str]], idf: np.ndarray, vectors: np.ndarray, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(doc_id, tid, item_id, cosine, lcs, answer) of items found in texts: whole texts, all passages, all items."""
    items = [(i, w) for i, t in items if (w := _item_words(t))]
    per_word = idf[:, None] * vectors  # a passage's latent vector is the sum over its words
    targets, owner, own_slots = [], [], []
    for k, (_, w) in enumerate(items):
        s = _slots(hash_words([b" ".join(w)])[0])
        for a, b in _item_windows(s):
            targets.append(per_word[s[a:b]].sum(axis=0))
            owner.append(k)
            own_slots.append(frozenset(s[a:b].tolist()))
    t = np.array(targets, dtype=np.float32).reshape(-1, vectors.shape[1])
    t /= np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-9)
    owners = np.array(owner)
    plain = [_plain(w) for _, w in items]

    def check(words: list[bytes], k: int, first: int, last: int) -> tuple[float, bool]:
        near = _plain(words[max(0, first - len(plain[k])) : last + len(plain[k])])
        tail = plain[k][-ANSWER_WORDS:]
        return _lcs(plain[k], near) / len(plain[k]), _lcs(tail, near) >= 0.8 * len(tail)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found: dict[tuple[int, int], tuple] = {}
            for first, part in batches(pdf["text"], lower=True, most=STEP_BYTES // 4):
                h, words = hash_words(part)
                if not len(h):
                    continue
                s, ends = _slots(h), np.cumsum(words)
                # sums of STEP words, then of WINDOW // STEP neighbours within a document
                begins = ends - words
                blocks = -(-words // STEP)
                starts = np.concatenate([np.arange(a, e, STEP) for a, e in zip(begins, ends, strict=True)])
                doc = np.repeat(np.arange(len(part)), blocks)
                sums = _sums(per_word, s, starts)
                total = np.concatenate([np.zeros((1, sums.shape[1]), np.float32), np.cumsum(sums, axis=0, dtype=np.float64).astype(np.float32)])
                stop = np.minimum(np.arange(len(doc)) + WINDOW // STEP, np.cumsum(blocks)[doc])
                z = total[stop] - total[:-1]
                z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
                split: dict[int, list[bytes]] = {}
                begin, end = starts.tolist(), np.minimum(starts + WINDOW, ends[doc]).tolist()
                for at in range(0, len(z), 4096):
                    cos = z[at : at + 4096] @ t.T
                    i, j = np.divmod(np.flatnonzero(cos >= min_cosine), len(t))
                    best: dict[tuple[int, int], list] = {}
                    here, words_here = -1, frozenset()
                    for b, target, k, c in zip((i + at).tolist(), j.tolist(), owners[j].tolist(), cos[i, j].tolist(), strict=True):
                        if b != here:
                            here, words_here = b, frozenset(s[begin[b] : end[b]].tolist())
                        if len(own_slots[target] & words_here) < MIN_SHARED * len(own_slots[target]):
                            continue
                        best.setdefault((int(doc[b]), k), []).append((c, b))
                    for (d, k), hits in best.items():
                        spans = sorted(b for _, b in hits)
                        groups: list[list[int]] = []
                        for b in spans:
                            if groups and b - groups[-1][1] <= WINDOW // STEP:
                                groups[-1][1] = b
                            else:
                                groups.append([b, b])
                        for lo, hi in groups:
                            if d not in split:
                                split[d] = part[d].split()
                            lcs, answer = check(split[d], k, int(starts[lo] - begins[d]), int(starts[hi] - begins[d]) + WINDOW)
                            if lcs >= MIN_LCS or answer and lcs >= MIN_LCS_WITH_ANSWER:
                                was = found.get((first + d, k), (0.0, 0.0, False))
                                found[first + d, k] = (max(was[0], *(c for c, _ in hits)), max(was[1], lcs), was[2] or answer)
            at = [d for d, _ in found]
            got = pdf.iloc[at][["doc_id", "tid"]].reset_index(drop=True).astype({"doc_id": "Int64"})
            got["item_id"] = pd.array([items[k][0] for _, k in found], dtype="Int64")
            for c, name in enumerate(("cosine", "lcs", "answer")):
                got[name] = np.array([x[c] for x in found.values()], dtype=bool if c == 2 else float)
            yield got

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), "text").mapInPandas(run, FOUND)


def found_texts(docs: DataFrame, benchmark: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """(doc_id, tid, item_id, cosine, lcs, answer): each text and item found, for a benchmark of any size: blocks of
    max_items items, one basis for all."""
    known = benchmark.where(F.col("text").rlike(WORD_PATTERN)).select("item_id", "text").distinct()
    n, size = known.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    if not n:
        return docs.sparkSession.createDataFrame([], FOUND)
    slots = word_slots(docs)
    df, n_docs = document_frequencies(slots)
    idf = idf_weights(df, n_docs)
    vectors = basis(slots, n_docs, known, n, idf)
    release(slots)
    blocks, out = max(-(-n // max_items), -(-size // ITEM_BYTES)), None
    for k in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        got = search(docs, [(r["item_id"], r["text"]) for r in rows], idf, vectors)
        got = stored_in_small_batches(got, "found")
        out = got if out is None else out.unionByName(got)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """All (doc_id, item_id) found, with the best cosine and the longest common subsequence as a share of the item."""
    hits = found_texts(docs, benchmark, max_items)
    return hits.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: documents that hold a benchmark item go. A document is told by its id and text, so that
    one without an id doesn't take others along."""
    hits = found_texts(docs, load(spark, sf_dir, "benchmark"))
    gone = hits.select(F.col("doc_id").alias("_gone_id"), F.col("tid").alias("_gone_text")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_text"]), "left_anti")
