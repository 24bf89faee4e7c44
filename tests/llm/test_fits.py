"""The trained models against plain versions of their passes, updates and posteriors, in loops over single numbers."""

import math
from itertools import product

import numpy as np
import pandas as pd

from ledgerloom.llm import byte_cnn, ftrl, weak_quality

TEXTS = ["You are a wonderful person and I thank you.", "you idiot, you horrible idiot", "Neutral words about weather", "horrible weather", "thank you", "", "idiot idiot idiot", "a b c d e"]


def test_ftrl_equals_updates_one_by_one():
    labels = [0, 1, 0, 1, 0, 0, 1, 0]
    model = ftrl.fit(TEXTS, labels)
    rows = []
    for t in TEXTS:
        keys, _ = ftrl.features([t.lower().encode()])
        rows.append(sorted({int(k) & (1 << ftrl.BITS) - 1 for k in keys}))
    z, n, rng = {}, {}, np.random.default_rng(3)

    def weight(i):
        l1 = 0.0 if i == "bias" else ftrl.L1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((ftrl.BETA + math.sqrt(n[i])) / ftrl.ALPHA + ftrl.L2)

    for _ in range(ftrl.PASSES):
        for k in rng.permutation(len(TEXTS)):
            own = [*rows[k], "bias"]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-max(-30, min(30, sum(w.values()))))) - labels[k]
            for i in own:
                was = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / ftrl.ALPHA * w[i]
                n[i] = was + g * g
    want = {i: weight(i) for i in z if i != "bias" and weight(i)}
    assert want and set(model.index.tolist()) == set(want)
    assert all(abs(w - want[i]) < 1e-9 for i, w in zip(model.index.tolist(), model.weight.tolist(), strict=True))
    assert abs(model.intercept - weight("bias")) < 1e-9


def plain_forward(model, window):
    """Class scores of one window: every filter at every place, byte by byte."""
    span, hidden = len(window) - max(byte_cnn.WIDTHS) + 1, []
    for f in range(model.kernel.shape[1]):
        width = byte_cnn.WIDTHS[f // byte_cnn.FILTERS]
        best = max(sum(float(model.embed[window[at + k], e]) * float(model.kernel[k * byte_cnn.EMBED + e, f]) for k in range(width) for e in range(byte_cnn.EMBED)) for at in range(span))
        hidden.append(max(best + float(model.bias[f]), 0.0))
    z = [sum(h * float(model.out[f, c]) for f, h in enumerate(hidden)) + float(model.out_bias[c]) for c in range(len(model.labels))]
    top = max(z)
    return [x - top - math.log(sum(math.exp(y - top) for y in z)) for x in z]


def test_network_equals_filters_one_by_one():
    model = byte_cnn.fit(["der die das und ist nicht " * 3, "the and of is not it " * 3] * 4, ["de", "en"] * 4)
    windows = byte_cnn.to_windows("the weather is not nice é".encode())
    assert np.allclose(model.log_probs(windows)[0], plain_forward(model, windows[0].tolist()), atol=1e-4)
    off = [k for f in range(model.kernel.shape[1]) for k in range(byte_cnn.WIDTHS[f // byte_cnn.FILTERS] * byte_cnn.EMBED, model.kernel.shape[0]) if model.kernel[k, f]]
    assert not off  # narrow filters stay narrow


def test_first_step_of_the_network_follows_the_numeric_gradient(monkeypatch):
    """Adam's first step is the learning rate against the gradient's sign."""
    texts, labels = ["abcab ", "xyzzy ", "abcca ", "yxzyx "], ["a", "x", "a", "x"]
    monkeypatch.setattr(byte_cnn, "EPOCHS", 0)
    start = byte_cnn.fit(texts, labels)
    monkeypatch.setattr(byte_cnn, "EPOCHS", 1)
    after = byte_cnn.fit(texts, labels)
    windows = np.concatenate([byte_cnn.to_windows(t.encode())[:1] for t in texts])
    y = [start.labels.index(x) for x in labels]

    def loss(name, at, step):
        model = byte_cnn.ByteCNN(start.labels, *[getattr(start, k).astype(np.float64).copy() for k in ("embed", "kernel", "bias", "out", "out_bias")])
        getattr(model, name)[at] += step
        return -model.log_probs(windows)[np.arange(len(y)), y].mean()

    rng, seen = np.random.default_rng(0), 0
    for name in ("out", "kernel", "embed", "bias", "out_bias"):
        values = getattr(start, name)
        for _ in range(40):
            at = tuple(int(rng.integers(0, k)) for k in values.shape) if name != "embed" else (int(rng.choice(list(b"abcxyz "))), int(rng.integers(0, byte_cnn.EMBED)))
            if name == "kernel" and not values[at]:
                continue
            slope = (loss(name, at, 1e-5) - loss(name, at, -1e-5)) / 2e-5
            if abs(slope) > 1e-3:
                seen += 1
                assert np.sign(getattr(after, name)[at] - values[at]) == -np.sign(slope), (name, at)
    assert seen > 30


def test_posteriors_and_rounds_equal_sums_over_patterns():
    rng = np.random.default_rng(4)
    patterns = np.array(list(product((-1, 0, 1), repeat=3)))
    counts = rng.integers(0, 40, len(patterns)).astype(float)
    model = weak_quality.fit_label_model(patterns, counts, rounds=3)
    good, right, opinion = 0.8, [[0.8, 0.8] for _ in range(3)], [[0.7, 0.7] for _ in range(3)]

    def posterior(p):
        both = []
        for side, sign in ((0, 1), (1, -1)):
            like = good if side == 0 else 1 - good
            for j, v in enumerate(p):
                r, o = right[j][side], opinion[j][side]
                like *= 1 - o if v == 0 else o * r if v == sign else o * (1 - r)
            both.append(like)
        return both[0] / sum(both)

    clip = lambda x, a, b: max(a, min(b, x))
    for _ in range(3):
        post = [posterior(p) for p in patterns.tolist()]
        total = [sum(c * (q if s == 0 else 1 - q) for c, q in zip(counts, post, strict=True)) for s in (0, 1)]
        new_right, new_opinion = [[0, 0] for _ in range(3)], [[0, 0] for _ in range(3)]
        for j in range(3):
            for s, sign in ((0, 1), (1, -1)):
                share = [c * (q if s == 0 else 1 - q) for c, q in zip(counts, post, strict=True)]
                has = sum(x for x, p in zip(share, patterns, strict=True) if p[j])
                hit = sum(x for x, p in zip(share, patterns, strict=True) if p[j] == sign)
                new_right[j][s] = clip((hit + 8) / (has + 10), 0.05, 0.99)
                new_opinion[j][s] = clip((has + 7) / (total[s] + 10), 0.01, 0.99)
        good, right, opinion = clip((total[0] + 4) / (sum(total) + 5), 0.02, 0.98), new_right, new_opinion
    assert abs(model.good - good) < 1e-12 and np.allclose(model.right, right) and np.allclose(model.opinion, opinion)
    assert np.allclose(model.posterior(patterns), [posterior(p) for p in patterns.tolist()])


def test_scorer_equals_steps_one_by_one():
    texts, soft = pd.Series(TEXTS), np.array([0.9, 0.1, 0.8, 0.2, 0.95, 0.4, 0.05, 0.6])
    shapes = weak_quality.shapes(texts)
    model = weak_quality.fit_scorer(texts, shapes, soft, steps=4)
    rows = []
    for t in TEXTS:
        doc, slot = weak_quality._features(pd.Series([t]))
        rows.append(slot.tolist())
    x = weak_quality._shapes(shapes)
    count = [max(1, sum(q < 0.5 for q in soft)), max(1, sum(q >= 0.5 for q in soft))]
    w, g2, v, s2, bias, b2 = {}, {}, [0.0] * weak_quality.SHAPES, [1e-6] * weak_quality.SHAPES, 0.0, 1e-6
    every = sorted({s for r in rows for s in r})

    def probability(k):
        z = sum(w.get(s, 0.0) for s in rows[k]) / math.sqrt(max(1, len(rows[k]))) + sum(a * b for a, b in zip(x[k], v, strict=True)) + bias
        return 1 / (1 + math.exp(-z))

    for _ in range(4):
        d = [(probability(k) - soft[k]) / (2 * count[int(soft[k] >= 0.5)]) for k in range(len(TEXTS))]
        grad = {s: sum(d[k] / math.sqrt(max(1, len(rows[k]))) for k in range(len(TEXTS)) if s in rows[k]) + 1e-5 * w.get(s, 0.0) for s in every}
        gs = [sum(x[k][j] * d[k] for k in range(len(TEXTS))) + 1e-4 * v[j] for j in range(len(v))]
        for s in every:
            g2[s] = g2.get(s, 1e-6) + grad[s] ** 2
            w[s] = w.get(s, 0.0) - 0.05 * grad[s] / math.sqrt(g2[s])
        s2 = [a + g * g for a, g in zip(s2, gs, strict=True)]
        v = [a - 0.2 * g / math.sqrt(q) for a, g, q in zip(v, gs, s2, strict=True)]
        b2 += sum(d) ** 2
        bias -= 0.2 * sum(d) / math.sqrt(b2)
    assert np.allclose([model.slots[s] for s in every], [w[s] for s in every], atol=1e-5)
    assert np.allclose(model.shapes, v) and abs(model.bias - bias) < 1e-9
    assert np.allclose(model(texts, shapes), [probability(k) for k in range(len(TEXTS))], atol=1e-5)
