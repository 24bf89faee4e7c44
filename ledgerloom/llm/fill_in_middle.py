"""Fill-in-the-middle by overlapping chunks of texts.

A token is a run of A-Z a-z or any other single code point, so whether a token starts at a byte depends on this byte and
the one before it only: a letter after a letter starts none, nor does a byte inside a code point. Each text is cut into
chunks of CHUNK bytes that overlap by one byte. All chunks of a batch count their token starts and code points at once;
prefix sums of the counts give the number of tokens, draw both cuts, and name the chunk that owns each cut. Only these
chunks are scanned again for the byte where the cut falls. Texts stay in the task that reads them: nothing is shuffled,
and besides its text a document holds two counts a chunk.

Forms: `plain` (the text), `psm` (<P>prefix<S>suffix<M>middle) and `spm` (<S>suffix<P>prefix<M>middle). No mark can arise
where text meets a mark, as a mark's start is not its end, so `restored` finds each mark by its first occurrence.

Defined cases: a null text is empty and an empty one plain; a null id draws like the empty id; texts that hold a mark are
plain; every row counts, also where rows repeat (equal rows get equal results); an empty table gives no rows; other columns
than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import batches

#: Fixed by the contract: the marks, shares (of 100) of texts that are cut, and of those the share with the suffix first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CUT_SHARE, SUFFIX_FIRST = 90, 20
#: Bytes of a chunk, and of what is scanned at once.
CHUNK, STEP = 1 << 14, 1 << 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def draws(doc_id: Column, salt: str = "1:") -> list[Column]:
    """h1 to h4: the first four groups of 8 hexadecimal digits of the sha256 of salt and id."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def _starts(buf: np.ndarray, before: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where tokens start, where code points start) in bytes, `before` being the byte in front of them (-1: none) and
    `first` the places at which texts begin."""
    point = (buf & 0xC0) != 0x80
    letter = _LETTER[buf]
    token = point.copy()
    token[1:] &= ~(letter[1:] & letter[:-1])
    if len(buf) and before >= 0:
        token[0] &= not (letter[0] and _LETTER[before])
    token[first] = True
    return token, point


def _counts(run: list[bytes], chunk: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per chunk of all texts of a run in order: token starts and code points; per text: its chunks."""
    sizes = np.array([len(x) for x in run], np.int64)
    chunks = -(-sizes // chunk)
    if len(run) == 1:  # a long text goes step by step, each overlapping the one before by a byte
        step, parts = max(chunk, step // chunk * chunk), []
        for at in range(0, len(run[0]), step):
            buf = np.frombuffer(run[0], np.uint8, min(step, len(run[0]) - at), at)
            token, point = _starts(buf, run[0][at - 1] if at else -1, np.zeros(0 if at else 1, np.int64))
            cuts = np.arange(0, len(buf), chunk)
            parts.append((np.add.reduceat(token, cuts, dtype=np.int64), np.add.reduceat(point, cuts, dtype=np.int64)))
        both = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 2
        return both[0], both[1], chunks
    buf = np.frombuffer(b"".join(run), np.uint8)
    offset = np.cumsum(sizes) - sizes
    token, point = _starts(buf, -1, offset[sizes > 0])
    nth = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    cuts = np.repeat(offset, chunks) + nth * chunk
    if not len(cuts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), chunks
    return np.add.reduceat(token, cuts, dtype=np.int64), np.add.reduceat(point, cuts, dtype=np.int64), chunks


def _cut(text: bytes, rank: int, upto: np.ndarray, points: np.ndarray, chunk: int) -> tuple[int, int]:
    """(byte, code point) at which the token of this rank starts (the end, where there is none): upto and points are the
    counts up to each chunk's end. Scans the owning chunk only."""
    owner = int(np.searchsorted(upto, rank, side="right"))
    if owner == len(upto):
        return len(text), int(points[-1]) if len(points) else 0
    at = owner * chunk
    buf = np.frombuffer(text, np.uint8, min(chunk, len(text) - at), at)
    token, point = _starts(buf, text[at - 1] if at else -1, np.zeros(0 if at else 1, np.int64))
    inside = int(np.flatnonzero(token)[rank - (int(upto[owner - 1]) if owner else 0)])
    return at + inside, (int(points[owner - 1]) if owner else 0) + int(point[:inside].sum())


def fill_in_middle(docs: DataFrame, chunk: int = CHUNK, step: int = STEP) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): one row per document."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def one(text: bytes, h: tuple, upto: np.ndarray, points: np.ndarray) -> tuple:
        n = int(upto[-1]) if len(upto) else 0
        if not text or any(m in text for m in marks) or h[2] % 100 >= CUT_SHARE:
            return n, "plain", None, None, text
        low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        (a, a_point), (b, b_point) = (_cut(text, r, upto, points, chunk) for r in (low, high))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        first = h[3] % 100 < SUFFIX_FIRST
        parts = (marks[1], suffix, marks[0], prefix) if first else (marks[0], prefix, marks[1], suffix)
        return n, "spm" if first else "psm", a_point, b_point - a_point, b"".join((*parts, marks[2], middle))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows, h = [], pdf[["h1", "h2", "h3", "h4"]].to_numpy(np.int64).tolist()
            for first, part in batches(pdf["text"], most=step):
                tokens, points, chunks = _counts(part, chunk, step)
                ends = np.cumsum(chunks).tolist()
                for i, (text, end) in enumerate(zip(part, ends, strict=True)):
                    own = slice(end - int(chunks[i]), end)
                    rows.append(one(text, h[first + i], np.cumsum(tokens[own]), np.cumsum(points[own])))
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else [()] * 5
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "n": np.array(n, np.int64), "form": list(form), "prefix_chars": pd.array(prefix, "Int64"), "middle_chars": pd.array(middle, "Int64"), "output": [x.decode() for x in output]})

    drawn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *draws(F.col("doc_id")))
    return drawn.mapInPandas(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text, rebuilt from an output and its form alone."""
    text, end = F.col(output), F.length(output)

    def parts(first: str, second: str) -> list[Column]:
        i, j = F.instr(text, second), F.instr(text, MIDDLE)
        return [F.substr(text, F.lit(1 + len(first)), i - 1 - len(first)), F.substr(text, i + len(second), j - i - len(second)), F.substr(text, j + len(MIDDLE), end)]

    p, s, m = parts(PREFIX, SUFFIX)
    s2, p2, m2 = parts(SUFFIX, PREFIX)
    return F.when(F.col(form) == "psm", F.concat(p, m, s)).when(F.col(form) == "spm", F.concat(p2, m2, s2)).otherwise(text)


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns: outputs and rebuilt texts as sha256."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    got = fill_in_middle(docs)
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))


SQL = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, {", ".join(f"CAST('0x' || substr(d, {1 + 8 * k}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))} FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
