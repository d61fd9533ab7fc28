"""Splits by value and into several parts, totals dealt to strata, and the rows drawn for them."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import surveyframe as sf

SCHEMA = "k string, `the stratum` string, v double"


def rows(n=900, seed=3):
    rng = random.Random(seed)
    return [(f"k{i}", rng.choice(["hot"] * 6 + ["a", "b", None]),
             rng.choice([None, 1.0, 1.0, rng.gauss(0, 9)])) for i in range(n)]


def frame(spark, table, partitions=4):
    return spark.createDataFrame(table, SCHEMA).repartition(partitions)


def digest(key, seed):
    return hashlib.md5(f"{key}|{seed}".encode()).hexdigest()


@pytest.mark.parametrize("shares", [(0.5, 0.5), (0.5, 0.3, 0.2), (0.01, 0.98, 0.01), (1 / 3,) * 3])
def test_parts_have_exact_sizes_and_the_order_of_hashes(spark, shares):
    table = rows()
    found = {r.k: r.part for r in sf.stratified_parts(
        frame(spark, table), "the stratum", "k", shares, seed=9).collect()}
    assert len(found) == len(table)
    for stratum in {s for _, s, _ in table}:
        keys = sorted((k for k, s, _ in table if s == stratum), key=lambda k: (digest(k, 9), k))
        ends = [math.ceil(round(sum(shares[:i + 1]), 12) * len(keys)) for i in range(len(shares) - 1)]
        assert [found[k] for k in keys] == [
            1 + sum(place >= e for e in ends) for place in range(len(keys))]


def test_two_parts_are_the_split(spark):
    table = frame(spark, rows())
    split = sf.stratified_split(table, "the stratum", "k", proportion=0.3, seed=4)
    parts = sf.stratified_parts(table, "the stratum", "k", (0.3, 0.7), seed=4)
    assert {r.k: 2 - r.in_first for r in split.collect()} == {r.k: r.part for r in parts.collect()}


def test_parts_without_strata_and_of_large_strata(spark):
    table = spark.range(60_000).select(F.concat(F.lit("k"), "id").alias("k"))
    found = Counter(r.part for r in sf.stratified_parts(
        table, [], "k", (0.7, 0.2, 0.1)).collect())
    assert found == {1: 42_000, 2: 12_000, 3: 6_000}


def test_wrong_shares_and_keys(spark):
    table = frame(spark, rows())
    for shares in ((1.0,), (0.5, 0.4), (0.5, 0.6, -0.1)):
        with pytest.raises(ValueError):
            sf.stratified_parts(table, "the stratum", "k", shares)
    missing = frame(spark, [(None, "a", 1.0), ("x", "a", 1.0)])
    with pytest.raises(Exception, match="k must not be NULL"):
        sf.stratified_parts(missing, "the stratum", "k", (0.5, 0.5)).collect()
    repeated = frame(spark, [("x", "a", 1.0)] * 4)
    with pytest.raises(Exception, match="k must be unique"):
        sf.stratified_parts(repeated, "the stratum", "k", (0.5, 0.5)).collect()
    empty = frame(spark, [])
    assert sf.stratified_parts(empty, "the stratum", "k", (0.5, 0.5)).count() == 0


def bracketed(values, groups):
    import numpy as np
    known = [v for v in values if v is not None]
    ends = list(dict.fromkeys(np.quantile(known, [i / (groups - 1) for i in range(groups)])))
    return [None if v is None else 1 + sum(v > e for e in ends[1:-1]) for v in values]


@pytest.mark.parametrize("groups", [2, 3, 5, 9])
def test_brackets_by_value(spark, groups):
    table = rows()
    found = {r.k: r.bracket for r in sf.value_brackets(
        frame(spark, table), "v", groups=groups).collect()}
    assert [found[k] for k, _, _ in table] == bracketed([v for *_, v in table], groups)


def test_brackets_of_ties_and_of_nothing(spark):
    same = frame(spark, [("a", "s", 2.0), ("b", "s", 2.0), ("c", "s", None)])
    assert {r.k: r.bracket for r in sf.value_brackets(same, "v").collect()} == {
        "a": 1, "b": 1, "c": None}
    assert sf.value_brackets(frame(spark, []), "v").count() == 0
    nothing = frame(spark, [("a", "s", None)])
    assert sf.value_brackets(nothing, "v").first().bracket is None


def plan(sizes, spreads, total):
    """Shares no larger than the sizes, then largest remainders."""
    m = {h: n * spreads.get(h, 1.0) for h, n in sizes.items()}
    full = set()
    while True:
        left = total - sum(sizes[h] for h in full)
        weight = sum(m[h] for h in sizes if h not in full)
        level = left / weight if weight else 0.0
        more = {h for h in sizes if h not in full and m[h] > 0 and level * m[h] >= sizes[h]}
        if not more:
            break
        full |= more
    share = {h: float(sizes[h]) if h in full else level * m[h] for h in sizes}
    got = {h: math.floor(x) for h, x in share.items()}
    order = sorted((h for h in sizes if got[h] < sizes[h]), key=lambda h: (got[h] - share[h], h))
    for h in order[:total - sum(got.values())]:
        got[h] += 1
    return got


CASES = [
    ({"a": 100, "b": 50, "c": 7}, {}, 30), ({"a": 100, "b": 50, "c": 7}, {}, 157),
    ({"a": 10, "b": 10, "c": 10}, {}, 10), ({"a": 100, "b": 3, "c": 5}, {"b": 90.0, "c": 30.0}, 60),
    ({"a": 100, "b": 3, "c": 5, "d": 0}, {"a": 0.1, "b": 90.0, "c": 30.0}, 11),
    ({"a": 5, "b": 5}, {"a": 1.0, "b": 1e9}, 6), ({"a": 9}, {}, 0), ({"a": 4, "b": 4}, {}, 3)]


@pytest.mark.parametrize("sizes, spreads, total", CASES)
def test_totals_are_dealt_whole(spark, sizes, spreads, total):
    table = spark.createDataFrame(
        [(h, n, spreads.get(h, 1.0)) for h, n in sizes.items()], "h string, n bigint, s double")
    found = {r.h: r.allocated for r in sf.allocate(
        table, total, "n", by="h", spread="s" if spreads else None).collect()}
    assert sum(found.values()) == total
    assert all(0 <= found[h] <= n for h, n in sizes.items())
    assert found == plan(sizes, spreads, total)


def test_allocations_that_cannot_be(spark):
    def table(*found):
        return spark.createDataFrame(list(found), "h string, n bigint, s double")

    bad = {
        "listed twice": (table(("a", 5, 1.0), ("a", 5, 1.0)), 3, None),
        "has no size": (table(("a", None, 1.0), ("b", 5, 1.0)), 3, None),
        "larger than all strata": (table(("a", 5, 1.0)), 6, None),
        "strata with a spread hold": (table(("a", 5, 1.0), ("b", 50, 0.0)), 20, "s"),
    }
    for message, (strata, total, spread) in bad.items():
        with pytest.raises(Exception, match=message):
            sf.allocate(strata, total, "n", by="h", spread=spread).collect()
    with pytest.raises(ValueError):
        sf.allocate(table(("a", 5, 1.0)), -1, "n", by="h")
    assert sf.allocate(table(), 0, "n", by="h").count() == 0


def test_draws_are_exact_and_stay_the_same(spark):
    table = rows()
    wanted = {"hot": 200, "a": 7, None: 0, "b": 31}
    allocation = spark.createDataFrame(list(wanted.items()), "`the stratum` string, n int")
    draws = [sorted(r.k for r in sf.stratified_draw(
        frame(spark, table, parts), "the stratum", "k", allocation, "n", seed=5).collect())
        for parts in (1, 3, 11)]
    assert draws[0] == draws[1] == draws[2]
    expected = []
    for stratum, n in wanted.items():
        keys = sorted((k for k, s, _ in table if s == stratum), key=lambda k: (digest(k, 5), k))
        expected += keys[:n]
    assert draws[0] == sorted(expected)


def test_draws_that_cannot_be(spark):
    table = frame(spark, rows())

    def allocation(*found):
        return spark.createDataFrame(list(found), "`the stratum` string, n int")

    with pytest.raises(Exception, match="fewer rows than are to be drawn in stratum: absent"):
        sf.stratified_draw(
            table, "the stratum", "k", allocation(("a", 1), ("absent", 1)), "n").collect()
    with pytest.raises(Exception, match="lists a stratum twice"):
        sf.stratified_draw(
            table, "the stratum", "k", allocation(("a", 1), ("a", 2)), "n").collect()
    assert sf.stratified_draw(table, "the stratum", "k", allocation(), "n").count() == 0
