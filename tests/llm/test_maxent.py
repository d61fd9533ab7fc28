from __future__ import annotations

import math
import zlib
from collections import Counter

import awkward
import numpy as np
import pytest
from pyspark.sql import functions as F

from surveyframe.llm import maxent, registered


@pytest.fixture
def held_out(spark):
    return registered._remainder(10) == 0


def base(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    tokens = [[*awkward.words(t), None] for _, t, _ in rows]
    counts = Counter(w for (i, _, _), ws in zip(rows, tokens) if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return sorted(((i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(
        math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6))
        for (i, _, _), ws in zip(rows, tokens)), key=str)


def test_base_scores_of_awkward_texts(spark, held_out):
    rows = awkward.texts() + [(100 + i, f"alpha beta rare{i} of", "x") for i in range(40)]
    found = maxent.score(awkward.documents(spark, rows), held_out=held_out).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens,
                    round(r.base_score, 6)) for r in found), key=str) == base(rows)
    assert all(r.score < 0 for r in found)


def test_tokens_beyond_the_lookup_are_counted_by_join(spark, monkeypatch, held_out):
    monkeypatch.setattr(maxent, "KNOWN_TOKENS", 3)
    rows = awkward.texts() + [(100 + i, f"alpha beta rare{i} of", "x") for i in range(40)]
    found = maxent.score(awkward.documents(spark, rows), held_out=held_out).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens,
                    round(r.base_score, 6)) for r in found), key=str) == base(rows)


def test_empty_table_and_nothing_to_learn(spark, held_out):
    assert maxent.score(awkward.documents(spark, []), held_out=held_out).count() == 0
    docs = awkward.documents(spark, [(1, "a b", "x"), (2, None, "x")])
    found = maxent.score(docs, held_out=F.lit(True)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in found] == [(3, 0, 0), (1, 0, 0)]
    assert [r.base_score for r in found] == pytest.approx([0.0, 0.0])
    assert [r.score for r in found] == pytest.approx([0.0, 0.0], abs=1e-6)


def test_the_model_is_a_distribution():
    rng = np.random.default_rng(3)
    counts = np.sort(rng.integers(1, 500, 300))[::-1]
    hashes = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    lookup = maxent.Lookup(hashes, counts)
    weights = maxent.Weights.start(lookup.model_counts, int(counts.sum()) + 100)
    weights.classes[:] = rng.standard_normal(weights.classes.shape)
    weights.words[:] = rng.standard_normal(weights.words.shape)
    n = len(lookup.model_counts)
    context = hashes[:2]
    total = 0.0
    for number in range(n + 1):  # 0 is every token outside the model
        tokens = np.array([*context, 12345], np.uint64)
        numbers = np.array([1, 2, number])
        total += math.exp(maxent.token_scores(tokens, np.array([0]), numbers, weights)[-1])
    assert total == pytest.approx(1.0, abs=1e-4)


def test_without_training_the_constants_are_shares_of_the_corpus():
    counts = np.array([50, 30, 20])
    weights = maxent.Weights.start(counts, 200)
    tokens = np.array([7, 8, 9], np.uint64)
    found = np.exp(maxent.token_scores(tokens, np.array([0]), np.array([1, 3, 0]), weights))
    assert found == pytest.approx([50 / 200.1, 20 / 200.1, 100.1 / 200.1], rel=1e-5)


def test_training_helps_on_held_out_texts(spark):
    found = registered.op10_maxent(spark, "/root/testdata/sf0.1").where("held_out").agg(
        F.sum("base_score"), F.sum("score"), F.count("*")).first()
    assert found[2] > 500
    assert found[1] > 0.97 * found[0]  # both are negative: 3 % fewer bits at least
