"""HyperMinHash: registers against big integers, estimates against known similarities, classes against all pairs."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import hyper_min_hash as hmh

DOCS = "doc_id long, text string, n long, ref string, registers long, bits string, component_id long, kept int"


def brute_classes(rows):
    """(words set size, least row number reachable) per row of (id, text)."""
    sets, where, both = [], defaultdict(list), Counter()
    for k, (_, text) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
        for g in sets[-1]:
            where[g].append(k)
    for ids in where.values():
        both.update((a, b) for a in ids for b in ids if a < b)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return [(len(s), find(k)) for k, s in enumerate(sets)]


def by_rows(rows):
    classes, members = brute_classes(rows), defaultdict(list)
    for k, (_, c) in enumerate(classes):
        members[c].append(rows[k][0])
    least = {c: min((d for d in ids if d is not None), default=None) for c, ids in members.items()}
    return sorted(((rows[k][0], n, least[c], rows[k][0] == least[c]) for k, (n, c) in enumerate(classes)), key=str)


def of(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", 2, "y", 3, 4) for r in rows], DOCS)
    return sorted((tuple(r) for r in hmh.near_duplicates(docs).collect()), key=str)


def test_registers_are_leading_zeros_and_mantissa():
    rng = np.random.default_rng(0)
    values = [*(int(v) >> int(k) for v, k in zip(rng.integers(0, 2**63, 500), rng.integers(0, 63, 500), strict=True)), 0, 1, 2**64 - 1, 2**63, 2**54 - 1, 2**53 + 1]
    for v, got in zip(values, hmh.registers(np.array(values, np.uint64)).tolist(), strict=True):
        zeros = min(63, 64 - v.bit_length())
        assert got == zeros << 10 | (v << zeros << 1 & 2**64 - 1) >> 54


@pytest.mark.parametrize(("n", "share"), [(10, 0.9), (300, 0.85), (3000, 0.5), (40_000, 0.2)])
def test_estimates_come_near(n, share):
    rng, got = np.random.default_rng(n), []
    both = round(2 * n * share / (1 + share))
    for _ in range(12):
        e = rng.integers(0, 2**64, size=2 * n, dtype=np.uint64)
        a, b = hmh.sketches([np.unique(e[:n]), np.unique(np.concatenate([e[:both], e[n : 2 * n - both]]))])
        got.append(hmh.estimate(np.array([(a == b).sum()]), np.array([n]), np.array([n]))[0])
    assert abs(np.mean(got) - both / (2 * n - both)) < 0.04


def test_expected_collisions_equal_simulated_ones():
    rng, agree = np.random.default_rng(3), 0
    for _ in range(400):
        a, b = hmh.sketches([rng.integers(0, 2**64, size=20, dtype=np.uint64) for _ in range(2)])
        agree += int((a == b).sum())
    assert 0.3 < agree / 400 / hmh.BUCKETS / hmh._collisions(20, 20) < 3


def test_a_long_set_goes_in_steps(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**64, size=k, dtype=np.uint64)) for k in (1, 500, 3, 90)]
    whole = hmh.sketches(sets)
    monkeypatch.setattr(hmh, "STEP", 64)
    assert (hmh.sketches(sets) == whole).all()


def test_equals_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted((tuple(r) for r in hmh.near_duplicates(docs).collect()), key=str) == by_rows(rows)


def test_equals_all_pairs_near_the_threshold(spark):
    """Chains of edits: many pairs a little above and below 0.85, short texts and a group of copies among them."""
    rng, rows = np.random.default_rng(2), []
    for family in range(25):
        words = [f"f{family}w{x}" for x in range(int(rng.integers(3, 120)))]
        for _ in range(12):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for at in rng.integers(0, len(words), max(1, len(words) // 50)):
                words[at] = f"n{rng.integers(10**9)}"
    rows += [(1000 + k, rows[7][1].upper()) for k in range(60)]
    assert of(spark, rows) == by_rows(rows)


def test_equals_all_pairs_in_a_large_group_that_does_not_link(spark):
    """One passage in all texts, just too short for links, so that bands agree but sets don't."""
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(80))
    rows = [(i, f"{passage} " + " ".join(f"t{x}" for x in rng.integers(0, 10**6, 10))) for i in range(300)]
    rows += [(1000 + i, t + " end") for i, t in rows[:40]]
    assert of(spark, rows) == by_rows(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    text = lambda: " ".join(f"w{x}" for x in rng.integers(0, 5000, 60))
    a, b, c = text(), text(), text()
    long = " ".join(f"w{i % 7000}" for i in range(60_000))
    rows = [(4, a), (4, b), (5, f"{a} more"), (9, c), (None, f"one {c}"), (None, "x y z q"), (4, a), (12, "x Y"), (11, "x y"), (None, None), (3, ""), (2, " \n\t"), (20, long), (21, long + " end"), (30, "one"), (31, "ONE")]
    assert of(spark, rows) == by_rows(rows)
    kept = hmh.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [2, 3, 4, 4, 9, 11, 20, 30]


def test_empty_table(spark):
    assert of(spark, []) == []
