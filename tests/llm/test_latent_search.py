"""The basis of the latent search against a plain version of its fit."""

import numpy as np

from ledgerloom.llm import latent_search
from ledgerloom.llm.base import hash_words


def plain_basis(docs, items, idf, rank):
    """Two steps of the power iteration over all windows of all texts, as dense matrices over the words that occur."""
    slots = [latent_search._slots(hash_words([t.encode().lower()])[0]) for t in docs]
    own = [latent_search._slots(hash_words([t.encode().lower()])[0]) for t in items]
    windows = [(s[a : a + latent_search.WINDOW], len(docs)) for s in slots for a in range(0, len(s), latent_search.WINDOW)]
    windows += [(s[a:b], 0) for s in own for a, b in latent_search._item_windows(s)]
    known = np.unique(np.concatenate([w for w, _ in windows]))
    rows = np.zeros((len(windows), len(known)))
    for row, (w, n) in zip(rows, windows, strict=True):
        np.add.at(row, np.searchsorted(known, w), idf[w])
        row *= (min(1, latent_search.FIT_DOCS / n) if n else latent_search.OWN_WEIGHT**2) ** 0.5 / np.linalg.norm(row)
    q = np.random.default_rng(1).normal(size=(1 << latent_search.BITS, rank))[known]
    for _ in range(1 + latent_search.POWER_ITERATIONS):
        u, strength, _ = np.linalg.svd(rows.T @ (rows @ q), full_matrices=False)
        q = u
    return known, (u / strength**0.25)[:, latent_search.SKIP :]


def test_basis_is_fitted_on_all_documents_and_items(spark):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(400)]
    docs = [" ".join(rng.choice(words[k % 8 * 40 : k % 8 * 40 + 120], rng.integers(1, 90))) for k in range(latent_search.FIT_DOCS + 700)]
    docs[7] = " ".join(f"long{i % 300}" for i in range(40_000))  # more bytes than a text of the sample that was read before
    items = [" ".join(rng.choice(words, 50)) for _ in range(30)]
    idf = (0.5 + rng.random(1 << latent_search.BITS)).astype(np.float32)
    tables = [spark.createDataFrame([(t,) for t in own], "text string") for own in (docs, items)]
    got = latent_search.basis(latent_search.word_slots(tables[0].repartition(5)), len(docs), tables[1], len(items), idf)
    known, want = plain_basis(docs, items, idf, latent_search.RANK)
    assert np.abs(np.delete(got, known, axis=0)).max() == 0
    both = [x[:, :20] @ x[:, :20].T for x in (got[known].astype(float), want)]  # the vectors' signs are free
    assert np.abs(both[0] - both[1]).max() < 1e-3 * np.abs(both[1]).max()
