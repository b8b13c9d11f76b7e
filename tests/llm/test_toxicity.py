"""Noisy-or training and scoring against plain loops; the sample's bound."""

import math

import numpy as np
import pytest

from tellurion.llm import lm, toxicity

CLEAN = ["the sun is out. we walk home", "we eat bread. it is good", "home is good", "the bread is out. sun", ""]
TOXIC = ["you are vile scum. the sun is out", "vile people. we eat", "what vile scum you are", "bread. vile scum again"]


def plain_score(text, weight, bias):
    """1 minus the product of the sentences' chances of being harmless."""
    rest, some = 1.0, False
    for words in toxicity.sentence_words(text):
        some = True
        z = bias + sum(weight.get(f, 0.0) for w in words for f in toxicity.features(w))
        rest *= 1 - 1 / (1 + math.exp(-z))
    return 1 - rest if some else 0.0


def plain_loss(texts, labels, weight, bias):
    total = 0.0
    for text, y in zip(texts, labels):
        s = plain_score(text, weight, bias)
        q = min(1 - s, math.exp(-1e-9))
        total -= math.log(1 - q) if y else math.log(q)
    return total / len(texts) + toxicity.DECAY * sum(weight.values())


def plain_train(texts, labels, steps):
    """Adam over central differences of the loss."""
    docs = {}
    for d, text in enumerate(texts):
        for w in {w for words in toxicity.sentence_words(text) for w in words}:
            for f in toxicity.features(w):
                docs.setdefault(f, []).append(d)
    used = sorted(f for f, ds in docs.items() if len(ds) >= toxicity.MIN_DOCS)
    x = np.array([0.0] * len(used) + [toxicity.BIAS])
    loss = lambda v: plain_loss(texts, labels, dict(zip(used, v[:-1])), v[-1])
    m = v = np.zeros(len(x))
    for t in range(1, steps + 1):
        g = np.array([(loss(x + h) - loss(x - h)) / 2e-5 for h in np.eye(len(x)) * 1e-5])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - toxicity.RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        x[:-1] = np.maximum(x[:-1], 0)
    return dict(zip(used, x[:-1])), x[-1]


def test_training_follows_the_gradient_of_the_noisy_or():
    texts, labels = CLEAN * 2 + TOXIC * 2, [0] * 10 + [1] * 8
    got = toxicity.train(texts, labels, 6)
    weight, bias = plain_train(texts, labels, 6)
    assert got[-1] == pytest.approx(bias, abs=1e-3)
    assert {f for f in np.flatnonzero(got[:-1])} == {f for f, w in weight.items() if w > 0}
    assert all(got[f] == pytest.approx(w, abs=1e-3) for f, w in weight.items()) and max(weight.values()) > 0.5


def test_scores_are_noisy_or():
    weights = toxicity.train(CLEAN * 3 + TOXIC * 3, [0] * 15 + [1] * 12, 60)
    weight, scorer = {f: w for f, w in enumerate(weights[:-1]) if w}, toxicity.Scorer(weights)
    for text in [*CLEAN, *TOXIC, None, "vile. " * 50, "Vile, SCUM!\nsun"]:
        assert scorer.document(text) == pytest.approx(plain_score(text, weight, weights[-1]), abs=1e-12)
    assert scorer.document(TOXIC[0]) > 0.5 > scorer.document(CLEAN[0])


def test_an_id_gives_few_texts(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "a"), (2, "a"), (3, None)], "doc_id long, text string")
    ids = [i for i in (1, 2, 3, 4, 5, 6) if __import__("zlib").crc32(str(i).encode()) % 3 != 1]
    texts, labels = toxicity.training_sample(docs, spark.createDataFrame([(i, i % 2) for i in range(1, 7)], "doc_id long, toxic int"))
    assert len(texts) == len(labels) == sum({1: toxicity.PER_ID, 2: 1, 3: 1}.get(i, 0) for i in ids)


def test_the_end_is_no_word():
    assert lm.END_WORD not in {w for t in ("\x00end", " ", "a \x00end", "\t") for w in lm.words_of(t)}
