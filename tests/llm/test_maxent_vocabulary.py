from __future__ import annotations

import awkward
import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyframe.llm import maxent, registered


def test_every_token_of_the_vocabulary_has_a_probability():
    rng = np.random.default_rng(5)
    counts = np.sort(rng.zipf(1.3, 5_000).clip(1, 10_000))[::-1]
    hashes = rng.integers(1, 1 << 62, 5_000).astype(np.uint64)
    tree = maxent.Tree(counts, 900, 1_000)
    weights = maxent.Weights.start(counts[:tree.skipped], int(counts.sum()) + 1_000)
    weights.tree[:] = rng.standard_normal(weights.tree.shape)
    below = np.arange(tree.skipped, 5_000)
    # One token for each group, and the known tokens below the classes, all in one context.
    some = rng.integers(1, 1 << 62, 5_000).astype(np.uint64)
    _, first = np.unique(tree.group(some), return_index=True)
    assert len(first) == tree.groups
    tokens = np.concatenate((hashes[below], some[first]))
    ranks = np.concatenate((below + 1, np.zeros(len(first), int)))
    features = [np.full(len(tokens), f, np.uint64) for f in (11, 12, 13)]
    found = np.exp(maxent.outside_scores(tokens, features, ranks, tree, weights))
    assert found.sum() == pytest.approx(1.0, abs=1e-4)
    weights.tree[:] = 0
    plain = np.exp(maxent.outside_scores(tokens, features, ranks, tree, weights))
    total = counts[below].sum() + 1_000 + 0.1 * (len(below) + 900)
    assert plain[:len(below)] == pytest.approx((counts[below] + 0.1) / total, rel=1e-3)
    # One probability of a group's tokens, and no step is left without a feature.
    assert (found[:len(below)] != plain[:len(below)]).all()


@pytest.mark.parametrize("known", [1 << 18, 3])
def test_context_tells_tokens_beyond_the_most_frequent(spark, monkeypatch, known):
    """3,000 tokens, each of which follows one other token only."""
    monkeypatch.setattr(maxent, "KNOWN_TOKENS", known)
    rows = [(i, " ".join(f"{c}{(37 * i + j) % 1500}" for j in range(60) for c in "ab"), "x")
            for i in range(1_200)]
    found = maxent.score(awkward.documents(spark, rows), held_out=registered._remainder(10) == 0).where("held_out").agg(
        F.sum("base_score"), F.sum("score"), F.count("*")).first()
    assert found[2] > 50
    assert found[1] > 0.8 * found[0]
