from __future__ import annotations

import random
from collections import Counter

import awkward
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from surveyframe.llm import suffix_arrays, suffix_dedup


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=200) | st.lists(st.sampled_from(b"ab\0"), max_size=200).map(bytes),
       st.integers(1, 40))
def test_suffix_array_and_common_prefixes(data, limit):
    array = np.frombuffer(data, np.uint8)
    order = suffix_arrays.suffix_array(array).tolist()
    assert order == sorted(range(len(data)), key=lambda i: data[i:])
    found = suffix_arrays.common_prefixes(array, np.array(order, np.int64), limit).tolist()
    for place in range(1, len(data)):
        one, other = data[order[place - 1]:], data[order[place]:]
        shared = 0
        while shared < min(len(one), len(other), limit) and one[shared] == other[shared]:
            shared += 1
        assert found[place] == shared


def expected(texts: list[str | None], length: int) -> list[tuple[int, int, int, bytes]]:
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def found(docs, **options) -> list[tuple]:
    rows = suffix_dedup.remove_repeats(docs, **options).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows),
                  key=str)


@pytest.mark.parametrize("options", [
    {"length": 40, "gram": 8}, {"length": 40, "gram": 8, "shard_bytes": 300, "group_pieces": 5}])
def test_awkward_texts(spark, options):
    rows = awkward.texts()
    wanted = expected([t for _, t, _ in rows], 40)
    assert found(awkward.documents(spark), **options) == sorted(
        ((i, *w) for (i, _, _), w in zip(rows, wanted)), key=str)


def test_passages_shared_by_many_texts(spark):
    """One passage in most texts, with different neighbours: one landmark, many pieces."""
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, edge = noise(120), noise(45)
    rows = [(i, noise(rng.randrange(60)) + passage[rng.randrange(40):] + noise(rng.randrange(60)),
             "s") for i in range(120)]
    rows += [(200 + i, noise(20) + edge + noise(i % 3) + edge[:rng.randrange(45)], "s")
             for i in range(60)]
    wanted = expected([t for _, t, _ in rows], 48)
    assert any(w[1] for w in wanted)
    assert found(awkward.documents(spark, rows), length=48, gram=8, shard_bytes=500,
                 group_pieces=10) == sorted(
        ((i, *w) for (i, _, _), w in zip(rows, wanted)), key=str)


def test_empty_table(spark):
    assert found(awkward.documents(spark, [])) == []


def test_kept_bytes_join_up(spark):
    docs = awkward.documents(spark)
    rows = suffix_dedup.remove_repeats(docs, length=100)
    assert rows.where(F.octet_length("kept") != F.col("n_bytes") - F.col("n_removed")).isEmpty()


def test_regular_strings_are_told_apart(spark):
    """Sums of powers modulo 2^64 are the same for these strings."""
    one, other = ("".join(x[bin(i).count("1") % 2] for i in range(1 << 11)) for x in ("ab", "ba"))
    mark = "".join(random.Random(2).choices("xyz", k=300))
    texts = [f"{mark}{one}", f"{mark}{other}", one, mark]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = sorted(suffix_dedup.remove_repeats(docs, length=1_500).collect())
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found] == expected(texts, 1_500)


def test_many_equal_rows(spark):
    text = "".join(random.Random(1).choices("abcdefgh ", k=1_000))
    docs = spark.range(20_000).select(
        F.lit(None).cast("bigint").alias("doc_id"), F.lit(text).alias("text"))
    found = suffix_dedup.remove_repeats(docs).groupBy("n_bytes", "n_removed", "n_spans").count()
    assert [tuple(r) for r in found.collect()] == [(1_000, 1_000, 1, 20_000)]
