"""Fill-in-the-middle against a plain version token by token, with chunks down to one byte."""

import hashlib
import random
import re

import duckdb
import pytest

from ledgerloom.llm import fill_in_middle as fim
from ledgerloom.llm import queries

DOCS = "doc_id long, text string, n long, form string, output string, h1 long"


def plain(doc_id, text):
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, t
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), out


def texts():
    rng = random.Random(7)
    pieces = ["a", "Zb", "word", " ", "\n", "é", "日", "𝄞", "1", "<", ">", "S", "<P", "é́", "\t", "-"]
    made = ["".join(rng.choices(pieces, k=rng.randrange(0, 60))) for _ in range(150)]
    return [None, "", "a", "é", "<S>", "x<M>y", "<S" * 9, "S>" * 9, "<" * 30, "ab" * 400, "日本" * 300, *made]


@pytest.mark.parametrize(("chunk", "step"), [(1, 1), (2, 64), (5, 16), (1 << 14, 1 << 20)])
def test_equals_plain(spark, chunk, step):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id at all"), (7, "ids repeat"), (7, "ids repeat"), (-3, "a b c d e f")]
    docs = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], DOCS)
    got = fim.fill_in_middle(docs, chunk, step).select("*", fim.restored().alias("back")).collect()
    assert sorted([tuple(r)[:6] for r in got], key=str) == sorted([plain(*r) for r in rows], key=str)
    assert sorted(r.back for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_long_text_over_many_steps(spark):
    text = "one two, three\n" * 120_000 + "end"
    rows = [(i, text + str(i)) for i in range(3)]
    got = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain(*r) for r in rows)


def test_sql_agrees_on_odd_rows(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id"), (None, None), (7, "twice"), (7, "twice")]
    docs = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_fill_in_middle(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(fim.SQL)
    order = [c[0] for c in want.description]
    assert sorted(map(str, map(tuple, got.select(order).collect()))) == sorted(map(str, want.fetchall()))


def test_empty_table(spark):
    assert fim.digests(spark.createDataFrame([], DOCS)).collect() == []
