"""Weak labels and the quality scorer."""

import numpy as np

from tidewright.llm.quality import LABELLERS, estimate, posterior, score_quality, shape, votes


def test_em_finds_accuracies_and_classes():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.6])[:len(LABELLERS)]
    votes = np.where(rng.random((4000, len(LABELLERS))) < 0.2, 2, np.where(rng.random((4000, len(LABELLERS))) < right, truth[:, None], ~truth[:, None]).astype(int))
    good, bad, share = estimate(votes, np.ones(4000))
    assert abs(share - 0.8) < 0.03 and np.abs(good[:, 1] / (good[:, 0] + good[:, 1]) - right).max() < 0.05
    assert ((posterior(votes, good, bad, share) >= 0.5) == truth).mean() > 0.95


def test_quality_edges(edges, nothing):
    rows = score_quality(edges).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    assert score_quality(nothing).collect() == []


def test_repetition_in_long_texts_is_seen():
    rng = np.random.default_rng(8)
    passage = [f"w{i}" for i in range(200)]
    plain = [f"v{i}" for i in rng.zipf(1.3, 100_000) % 50_000]
    at = [x[0] for x in LABELLERS].index("distinct words")
    vote = lambda words: int(votes(shape(" ".join(words)))[at])
    assert vote(passage * 500) == 0 and vote(passage) == 1
    assert abs(shape(" ".join(plain))[at] - np.mean([shape(" ".join(plain[i:i + 400]))[at] for i in range(0, 100_000, 400)])) < 1e-9
    assert shape("a b a b")[at] == 0.5
