from __future__ import annotations

import random

import awkward
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from surveyframe.llm import components, minhash, words as W


def expected(rows, width, percent):
    sets = [awkward.shingles(awkward.words(t), width) for _, t, _ in rows]

    def linked(a, b):
        if rows[a][0] is None or rows[b][0] is None:
            return False
        if rows[a][0] == rows[b][0]:
            return True
        one, other = sets[a], sets[b]
        return bool(one) and bool(other) and (
            100 * len(one & other) >= percent * len(one | other))

    root = awkward.groups(len(rows), linked)
    least = {}
    for at, r in enumerate(root):
        if rows[at][0] is not None:
            least[r] = min(rows[at][0], least.get(r, rows[at][0]))
    return sorted(((i, len(s), None if i is None else least[r], i is None or i == least[r])
                   for (i, _, _), s, r in zip(rows, sets, root)), key=str)


def found(docs, **options):
    return sorted((tuple(r) for r in minhash.near_duplicates(docs, **options).collect()), key=str)


def family(rng, first: int, count: int, changes: int) -> list[tuple]:
    base = [f"w{rng.randrange(3_000)}" for _ in range(rng.randrange(60, 200))]
    out = []
    for i in range(count):
        copy = list(base)
        for _ in range(rng.randrange(changes + 1)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        out.append((first + i, " ".join(copy), "s"))
    return out


def test_families_of_near_copies(spark, monkeypatch):
    rng = random.Random(11)
    rows = []
    for size, changes in ((2, 1), (5, 3), (70, 6), (40, 12), (3, 0), (60, 4)):
        rows += family(rng, len(rows), size, changes)
    rows += [(5_000 + i, rows[20][1], "s") for i in range(50)]
    monkeypatch.setattr(minhash, "LISTED_MEMBERS", 6)
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 11)
    monkeypatch.setattr(minhash, "MEMBERS_PER_TASK_GROUP", 9)
    wanted = expected(rows, 3, 85)
    assert len({r[2] for r in wanted}) < len(wanted) / 2
    assert found(awkward.documents(spark, rows), width=3, percent=85) == wanted


def test_awkward_texts(spark):
    assert found(awkward.documents(spark), width=5, percent=80) == expected(
        awkward.texts(), 5, 80)


def test_empty_table(spark):
    assert found(awkward.documents(spark, [])) == []
    assert found(awkward.documents(spark, [(1, None, "a"), (2, "", "a")])) == [
        (1, 0, 1, True), (2, 0, 2, True)]


@pytest.mark.parametrize("similarity", [0.8, 0.85, 0.95])
def test_few_keys_make_many_tables(similarity):
    keys = minhash.keys_per_collection(similarity)
    missed = 1 - (1 - (1 - similarity ** minhash.VALUES_PER_KEY) ** keys) ** 2
    assert missed <= 2 * minhash.MISS
    assert keys <= 10


def test_intersections():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9_000, n).astype(np.uint64)) for n in (0, 1, 50, 6_000, 9_000)]
    wanted = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    shared = minhash._intersections(sets, np.array([len(s) for s in sets]))
    assert (shared - np.diag(np.diag(shared))).tolist() == (
        np.array(wanted) - np.diag(np.diag(wanted))).tolist()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.text("aAbé \t\n\x1f\xa0.", max_size=25), max_size=8),
       st.integers(1, 4))
def test_hashed_words_and_shingles_are_the_words(texts, width):
    import pyarrow as pa

    known: dict = {}
    for allowed, plain in ((W.NOT_SPACE, awkward.words), (W.LETTER_OR_DIGIT, awkward.letters)):
        hashes, bounds = W.word_hashes(pa.array(texts, pa.string()), allowed)
        for i, text in enumerate(texts):
            found = plain(text)
            assert bounds[i + 1] - bounds[i] == len(found)
            for word, value in zip(found, hashes[bounds[i]:bounds[i + 1]].tolist()):
                assert known.setdefault(word, value) == value
        runs, places = W.shingle_hashes(hashes, bounds, width)
        for i, text in enumerate(texts):
            some = runs[places[i]:places[i + 1]].tolist()
            assert len(set(some)) == len(awkward.shingles(plain(text), width))
    assert len(set(known.values())) == len(known)


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
def test_components(spark, links):
    table = spark.createDataFrame(links, "a bigint, b bigint")
    nodes = sorted({x for link in links if link[0] != link[1] for x in link})
    pairs = {frozenset(link) for link in links}
    root = awkward.groups(
        len(nodes), lambda a, b: frozenset((nodes[a], nodes[b])) in pairs)
    assert sorted(map(tuple, components.components(table).collect())) == [
        (x, nodes[r]) for x, r in zip(nodes, root)]


def test_long_chain(spark):
    links = spark.range(70).selectExpr("id AS a", "id + 1 AS b")
    assert {tuple(r) for r in components.components(links).collect()} == {
        (i, 0) for i in range(71)}


def thue_morse(letters: str, order: int) -> str:
    """A word and, with the letters changed about, another one of which sums of powers modulo
    2^64 are the same."""
    return "".join(letters[bin(i).count("1") % 2] for i in range(1 << order))


def test_long_regular_words_are_told_apart(spark):
    one, other = thue_morse("ab", 12), thue_morse("ba", 12)
    rows = [(1, f"one two {one}", "a"), (2, f"one two {other}", "a"), (3, f"one two {one}", "a"),
            (4, one, "a"), (5, other, "a")]
    found = minhash.near_duplicates(awkward.documents(spark, rows), width=3, percent=85)
    assert {r.doc_id: r.component_id for r in found.collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
