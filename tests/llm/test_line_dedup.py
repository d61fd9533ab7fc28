from __future__ import annotations

import random
from collections import defaultdict

import awkward
import numpy as np
import pytest

from surveyframe.llm import line_dedup
from surveyframe.llm.perfect_hash import PerfectHash


def key(line: str) -> str:
    return line.strip(" \t\n\v\f\r").translate(awkward.LOWER)


def expected(rows, min_chars=10):
    holders = defaultdict(set)
    for i, text, *_ in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                holders[key(line)].add(i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        left = [line for line in lines if i is None or len(key(line)) < min_chars
                or len(holders[key(line)]) < 2 or min(holders[key(line)]) == i]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in df.collect()), key=str)


def rows():
    rng = random.Random(3)
    lines = [f"a line of number {i}" for i in range(300)] + [
        "short", "", "   ", "nine char", "ten chars!", " Ten Chars! ", "\tTEN CHARS!\r", "東京東京東京東京東京",
        "ÄÖÜ äöü ÄÖÜ", "äöü äöü äöü", "\x00\x00\x00\x00\x00\x00\x00\x00\x00\x00", "a common line here",
        "inner \x1f unit \x85 separators", "no-break\xa0\xa0\xa0space "]
    made = [(1_000 + i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 30))), "x")
            for i in range(300)]
    hot = [(3_000 + i, "a common line here\nA COMMON LINE HERE", "x") for i in range(400)]
    more = [
        (50, "one line alone\none line alone", "x"), (51, "same id, other text", "x"),
        (51, "same id, other text\nand more of it", "x"), (51, "same id, other text", "x"),
        (52, "and more of it", "x"), (None, "a common line here\nonly without id", "x"),
        (None, "only without id", "x"), (0, "\n\n", "x"), (-7, "a line of number 7\n", "x"),
        (2**63 - 1, "a line of number 7", "x"), (-2**63, "a line of number 8", "x")]
    return awkward.texts() + made + hot + more


@pytest.mark.parametrize("options", [
    {}, {"shard_keys": 40}, {"shard_keys": 40, "frequent": 10}, {"frequent": 1},
    {"min_chars": 0}, {"min_chars": 17, "shard_keys": 7}])
def test_against_brute_force(spark, options):
    table = rows()
    left = line_dedup.remove_shared_lines(awkward.documents(spark, table), **options)
    assert found(left) == expected(table, options.get("min_chars", 10))


def test_equal_rows(spark):
    table = [(7, "the first line\nthe second line", "x")] * 3_000 + [
        (i, "the second line\nmy own line", "x") for i in (3, 9, 9, 9)]
    left = line_dedup.remove_shared_lines(awkward.documents(spark, table), frequent=1)
    assert found(left) == expected(table)


def test_blocks_of_probes(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "PROBES", 5)
    table = rows()
    left = line_dedup.remove_shared_lines(
        awkward.documents(spark, table), shard_keys=20, frequent=10)
    assert found(left) == expected(table)


def test_empty_tables(spark):
    assert line_dedup.remove_shared_lines(awkward.documents(spark, [])).count() == 0
    for table in ([(1, None, "x")], [(None, None, None)], [(1, "", "x"), (2, "", "x")]):
        assert found(line_dedup.remove_shared_lines(
            awkward.documents(spark, table))) == expected(table)


def keys(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(n)
    return tuple(rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(2))


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1_000, 100_000])
def test_perfect_hash(n):
    high, low = keys(n)
    hashed = PerfectHash.build(high, low)
    assert len(hashed) == n
    assert np.array_equal(np.sort(hashed.places(high, low)), np.arange(n))
    assert len(hashed.bits) * 64 <= 4 * n + 640
    other = hashed.places(low, high)
    assert ((other >= -1) & (other < max(n, 1))).all()


def test_perfect_hash_of_similar_keys():
    n = 5_000
    same, counting = np.zeros(n, np.uint64), np.arange(n, dtype=np.uint64)
    for high, low in ((same, counting), (counting, same), (counting, counting)):
        assert np.array_equal(
            np.sort(PerfectHash.build(high, low).places(high, low)), np.arange(n))
    with pytest.raises(ValueError):
        PerfectHash.build(same, same)


def test_arrays_of_a_shard():
    high, low = keys(2_000)
    counts = np.arange(2_000) % 700 + 1
    owners = np.arange(2_000) * 3 - 50
    for prints in ("<u4", "<u8"):
        shard = line_dedup.Shard.build(high.view(np.int64), low.view(np.int64), counts, owners, prints)
        n, least = shard.probe(high, low)
        assert np.array_equal(n, np.minimum(counts, 255))
        assert np.array_equal(least, np.where(counts >= 2, owners, 0))
        strangers = shard.probe(*keys(5_000))
        assert not strangers[0].any() and not strangers[1].any()
    small = line_dedup.Shard.build(high.view(np.int64), low.view(np.int64), counts, owners)
    read = line_dedup.Shard.read(small.arrays())
    assert all(np.array_equal(a, b) for a, b in zip(read.probe(high, low), small.probe(high, low)))
    assert sum(map(len, small.arrays())) < 14 * 2_000
