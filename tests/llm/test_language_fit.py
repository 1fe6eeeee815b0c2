"""The language model's parts against plain Python, one number at a time."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np

from corpusflow.llm import language


def grams(text):
    """Hashed n-grams of a text and its letters: case folded, one blank between words."""
    kept, letters, before = [], 0, False
    for c in (text or "").lower() + ("\n" if text is not None else ""):
        if c.isalpha():
            kept.append(ord(c))
            letters += 1
        elif before:
            kept.append(32)
        before = c.isalpha()
    found = Counter()
    for n in language.ORDERS:
        for i in range(len(kept) - n + 1):
            h = 0
            for j, c in enumerate(kept[i : i + n], 1):
                h = (h + c + j) * 0x9E3779B97F4A7C15 % 2**64
                h ^= h >> 29
            found[h >> (64 - language.BITS)] += 1
    return found, letters


TEXTS = [None, "", "A", "?", "Hello, wörld! ÀÉ", "x1y 2z", "日本語 テキスト", "\U0001d400bc İi ǅ", " lead and trail ", "no\nbreak\n\n"]


def test_features():
    counts, letters = language.features(TEXTS)
    for row, n, text in zip(counts, letters, TEXTS):
        want, want_letters = grams(text)
        assert {int(k): int(row[k]) for k in np.flatnonzero(row)} == want and n == want_letters


def test_tf_idf():
    rng = np.random.default_rng(3)
    counts, idf = rng.integers(0, 4, (5, 7)).astype(np.float32), rng.random(7).astype(np.float32)
    counts[2] = 0
    for row, got in zip(counts.tolist(), language.tf_idf(counts.copy(), idf)):
        raw = [math.sqrt(c) * w for c, w in zip(row, idf.tolist())]
        norm = math.sqrt(sum(v * v for v in raw))
        assert np.allclose(got, [v / norm if norm else 0 for v in raw], atol=1e-6)


def plain_ftrl(rows, labels, classes):
    """Follow-the-regularised-leader with one dictionary entry per weight."""
    z, n = Counter(), Counter()

    def weight(i, k):
        if abs(z[i, k]) <= language.L1:
            return 0.0
        shrunk = z[i, k] - math.copysign(language.L1, z[i, k])
        return -shrunk / ((language.BETA + math.sqrt(n[i, k])) / language.ALPHA + language.L2)

    for _ in range(language.EPOCHS):
        for row, label in zip(rows, labels):
            row = [*row, ("bias", 1.0)]
            w = {(i, k): weight(i, k) for i, _ in row for k in range(classes)}
            scores = [math.exp(sum(v * w[i, k] for i, v in row)) for k in range(classes)]
            for k in range(classes):
                error = scores[k] / sum(scores) - (k == label)
                for i, v in row:
                    g = error * v
                    sigma = (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / language.ALPHA
                    z[i, k] += g - sigma * w[i, k]
                    n[i, k] += g * g
    return weight


def test_ftrl():
    rng = random.Random(11)
    rows = [[(i, rng.random()) for i in sorted(rng.sample(range(30), rng.randrange(1, 9)))] for _ in range(80)]
    # the last feature is too weak to get past the l1 bound
    rows = [[*row, (40, 1e-4)] for row in rows]
    labels = np.array([rng.randrange(3) for _ in rows])
    sparse = [(np.array([i for i, _ in row]), np.array([v for _, v in row])) for row in rows]
    weights, bias = language.ftrl(sparse, labels, 3)
    weight = plain_ftrl(rows, labels, 3)
    assert weights.shape == (1 << language.BITS, 3)
    for k in range(3):
        assert math.isclose(bias[k], weight("bias", k), abs_tol=1e-9)
        for i in range(50):
            assert math.isclose(weights[i, k], weight(i, k), abs_tol=1e-9)
    assert not weights[40].any() and not weights[50:].any() and weights[:30].any()


def test_temperature():
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 4, 400)
    logits = rng.normal(size=(400, 4))
    logits[np.arange(400), labels] += 1.5

    def loss(t):
        return -np.log(language.softmax(logits * 3 / t)[np.arange(400), labels]).mean()

    got = language.best_temperature(logits * 3, labels)
    grid = np.exp(np.linspace(math.log(0.02), math.log(5), 2000))
    best = min(grid, key=loss)
    assert abs(math.log(got / best)) < 0.01 and loss(got) <= loss(1.0)
    # calibrated: the scores of the best class say how often it is right
    p = language.softmax(logits * 3 / got)
    assert abs(p.max(axis=1).mean() - (p.argmax(axis=1) == labels).mean()) < 0.05
    assert language.best_temperature(np.zeros((0, 4)), labels[:0]) == 1.0


def test_document_frequencies(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS if t is not None] * 3, "text string").repartition(4)
    got, n = language.document_frequencies(rows, "text")
    want = Counter(k for t in TEXTS if t is not None for k in grams(t)[0])
    assert n == 3 * (len(TEXTS) - 1)
    assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == {k: 3 * v for k, v in want.items()}


def test_sample_takes_all_languages_alike(spark):
    rows = [(k, f"text {k}", "rare" if k % 50 == 0 else "often") for k in range(2000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = Counter(r.lang for r in language.learning_sample(table, "doc_id", "text", "lang", 200).collect())
    assert got == {"rare": 40, "often": 100}
