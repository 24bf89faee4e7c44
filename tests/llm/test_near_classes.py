"""Steps of the joins of near duplicates that must not grow with the square of a group's size."""

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import jaccard_join, near_classes


def test_large_neighbourhoods_meet_in_blocks(spark, monkeypatch):
    """All pairs that sizes and sketches allow, each once, also where members fall into many blocks."""
    monkeypatch.setattr(near_classes, "BLOCK", 7)
    monkeypatch.setattr(near_classes, "OTHERS", 25)
    rng, rows = np.random.default_rng(4), []
    for a, members in ((0, 90), (1, 40)):
        common = rng.integers(0, 1 << 63, 120).astype(np.uint64)
        for k in range(members):
            s = np.unique(np.concatenate([common[rng.random(120) < 0.95], rng.integers(0, 1 << 63, rng.integers(0, 25)).astype(np.uint64)]))
            comp = int(rng.integers(0, 9))
            rows.append((a, 1000 * a + k, len(s), comp, comp > 0, members, near_classes.parity_words(s).tolist()))
    got = near_classes.met_in_blocks(spark.createDataFrame(rows, "a long, ref long, n long, comp long, minor boolean, members long, words array<long>"), jaccard_join.LINK)
    want = []
    for i, x in enumerate(rows):
        for y in rows[:i]:
            bits = sum((int(p) ^ int(q)).bit_count() if p >= 0 and q >= 0 else ((int(p) ^ int(q)) & (1 << 64) - 1).bit_count() for p, q in zip(x[6], y[6], strict=True))
            if x[0] == y[0] and x[3] != y[3] and 4 * min(x[2], y[2]) >= 3 * max(x[2], y[2]) and 7 * bits <= x[2] + y[2]:
                want.append((min(x[1], y[1]), max(x[1], y[1])))
    assert len(want) > 500 and sorted(map(tuple, got.collect())) == sorted(want)


def test_lists_hold_sets_of_like_sizes(spark):
    """Texts of unlike sizes that share a passage aren't in one list, as they can't link; those that link are."""
    passage = [f"p{i}" for i in range(40)]
    docs = [(k, " ".join(passage + [f"w{k}x{i}" for i in range(12 * (k % 50))])) for k in range(200)]
    docs += [(1000 + k, docs[k][1] + " one more") for k in range(1, 50)]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    sets = jaccard_join.set_table(docs)
    lists = jaccard_join.candidate_lists(near_classes.one_text_each(docs, sets), sets).persist()
    sizes = lists.groupBy("lid").agg(F.min("n").alias("least"), F.max("n").alias("most")).collect()
    assert sizes and all(9 * r.most <= 16.1 * r.least for r in sizes)
    ref = {r.doc_id: r.ref for r in sets.collect()}
    together = {(r.x, r.y) for r in lists.alias("p").join(lists.alias("q"), "lid").select(F.col("p.ref").alias("x"), F.col("q.ref").alias("y")).collect()}
    assert all((ref[k], ref[1000 + k]) in together for k in range(1, 50))
