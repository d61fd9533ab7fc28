from __future__ import annotations

from collections import Counter, defaultdict

import awkward
import numpy as np
import pytest

from surveyframe.llm import mixing


def targets(sizes: dict, weights=(3, 1, 2), share=1.5, limit=2.0) -> dict:
    """By repeated sharing of the excess."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = share * sum(sizes.values())
    found = {s: total * weight[s] / sum(weight.values()) for s in names}
    capped: set = set()
    while over := [s for s in names if found[s] > limit * sizes[s] * (1 + 1e-12)]:
        capped |= set(over)
        excess = sum(found[s] - limit * sizes[s] for s in over)
        rest = [s for s in names if s not in capped]
        for s in over:
            found[s] = limit * sizes[s]
        for s in rest:
            found[s] += excess * weight[s] / sum(weight[r] for r in rest)
    return found


def sizes_of(rows) -> dict:
    sizes: dict = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(awkward.words(text))
    return sizes


def check(mixed: mixing.Mix, rows, block_words: int):
    wanted = targets(sizes_of(rows))
    sources = {r.source_no: r for r in mixed.sources.collect()}
    assert {r.source for r in sources.values()} == set(wanted)
    for r in sources.values():
        assert r.target == pytest.approx(wanted[r.source])
        assert r.source_size == sizes_of(rows)[r.source]
    draws = mixed.draws.collect()
    by_row = {r.row_id: r for r in mixed.rows.collect()}
    assert len(by_row) == len(rows)
    taken: Counter = Counter()
    for d in draws:
        taken[d.source_no] += d.words
        assert by_row[d.row_id].size > d.block * block_words
    for number, r in sources.items():
        assert abs(taken[number] - r.target) <= block_words / 2 + 1
    # Every block is drawn once in a pass, and twice at most.
    assert max(Counter((d.row_id, d.block, d.copy) for d in draws).values()) == 1
    assert max(Counter((d.row_id, d.block) for d in draws).values()) <= 2
    # Positions are dense within shards, and shards are nearly equal.
    shards = defaultdict(list)
    for d in draws:
        shards[d.shard].append(d.position)
    for places in shards.values():
        assert sorted(places) == list(range(len(places)))
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= len(shards)
    return draws


def test_awkward_texts(spark):
    rows = awkward.texts()
    docs = awkward.documents(spark)
    mixed = mixing.mix(docs, block_words=16, blocks_per_shard=200)
    draws = check(mixed, rows, 16)
    again = mixing.mix(docs, block_words=16, blocks_per_shard=200).draws.collect()
    key = lambda d: (d.shard, d.position)
    content = lambda ds: [(d.doc_id, d.block, d.copy, d.words)
                          for d in sorted(ds, key=key)]
    assert content(draws) == content(again)
    other = mixing.mix(docs, block_words=16, blocks_per_shard=200, seed=1).draws.collect()
    assert content(draws) != content(other)


def test_mixed_documents_keep_their_words(spark):
    rows = awkward.texts()
    docs = awkward.documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    mixed = mixing.mix(docs, block_words=16)
    words = Counter()
    for d in mixed.draws.collect():
        words[d.doc_id] += d.words
    found = mixing.mixed_documents(docs, block_words=16)
    assert found.columns == docs.columns
    taken = Counter()
    whole = {t for _, t, _ in rows}
    for r in found.collect():
        taken[r.doc_id] += len(awkward.words(r.text))
        assert r.n_chars == len(r.text)
        assert r.text in whole or any(set(awkward.words(r.text)) <= set(awkward.words(t))
                                      for t in whole)
    assert taken == words


def test_split_keeps_quotas():
    rng = np.random.Generator(np.random.PCG64(1))
    for quotas in ([5, 0, 7, 1], [10**10, 3, 10**9, 0], [1], [0, 0]):
        quotas = np.array(quotas, np.int64)
        wanted = int(quotas.sum()) // 3
        left = mixing.split(quotas, wanted, rng)
        assert (left >= 0).all() and (left <= quotas).all()
        assert abs(int(left.sum()) - wanted) <= max(2, 1e-6 * wanted)


def test_split_follows_the_distribution():
    rng = np.random.Generator(np.random.PCG64(2))
    quotas = np.array([30, 20, 50])
    draws = np.array([mixing.split(quotas, 40, rng) for _ in range(4_000)])
    assert np.allclose(draws.mean(axis=0), quotas * 0.4, atol=0.2)
    variance = 40 * quotas / 100 * (1 - quotas / 100) * 60 / 99
    assert np.allclose(draws.var(axis=0), variance, rtol=0.1)


def test_empty_tables(spark):
    mixed = mixing.mix(awkward.documents(spark, []))
    assert mixed.draws.count() == mixed.rows.count() == mixed.sources.count() == 0
    blank = mixing.mix(awkward.documents(spark, [(1, None, "a"), (2, "", None)]))
    assert blank.draws.count() == 0
    assert {(r.source, r.target) for r in blank.sources.collect()} == {("a", 0.0), (None, 0.0)}


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 1, "c": 1}, {"a": 1, "b": 100, "c": 100, None: 7}, {"x": 5},
    {"a": 0, "b": 0}, {"a": 10, "b": 0, "c": 3, "d": 1000, "é": 4, "z": 2}])
def test_targets_by_repeated_sharing(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    found = {r.source: r.target for r in mixing.targets(rows, (3, 1, 2), 1.5, 2.0).collect()}
    assert found == pytest.approx(targets(sizes))
