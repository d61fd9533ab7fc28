from __future__ import annotations

import awkward
import numpy as np
from pyspark.sql import functions as F

from surveyframe.llm import cap_filters

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, task string, n string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(4)


def expected(rows, similarity=0.93):
    def linked(a, b):
        (i, x, p), (j, y, q) = rows[a], rows[b]
        if i is None or j is None or p is None or p != q or not x or not y or len(x) != len(y):
            return False
        x, y = (np.array([np.nan if c is None else np.float32(c) for c in v], np.float64)
                for v in (x, y))
        if not (np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any()):
            return False
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= similarity

    root = awkward.groups(len(rows), linked)
    least = {}
    for at, r in enumerate(root):
        if rows[at][0] is not None:
            least[r] = min(rows[at][0], least.get(r, rows[at][0]))
    out = []
    for at, (i, _, _) in enumerate(rows):
        n = sum(linked(at, other) for other in range(len(rows)) if other != at)
        component = None if i is None else least[root[at]]
        out.append((i, n, component, i is None or i == component))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in cap_filters.linked_vectors(df).collect()), key=str)


def test_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = []
    for group in range(40):
        centre = rng.standard_normal(24)
        for _ in range(rng.integers(1, 9)):
            spread = rng.uniform(0, 0.5)
            rows.append((len(rows), (centre + spread * rng.standard_normal(24)).tolist(),
                         int(group % 3)))
    rows += [(1000 + i, rows[5][1], 1) for i in range(30)]  # copies, and ties
    rows += [(2000, rows[5][1], 2), (2001, [2 * x for x in rows[5][1]], 1)]
    monkeypatch.setattr(cap_filters, "BLOCK_ROWS", 7)  # every group is cut into blocks
    got = found(table(spark, rows))
    # Lists are random: nearly every link must be found, and none else.
    wanted = expected(rows)
    assert sum(r[1] for r in got) >= 0.99 * sum(r[1] for r in wanted)
    assert got == wanted


def test_awkward_vectors(spark):
    one = [1.0, 2.0, 3.0, 4.0]
    rows = [
        (1, one, 1), (2, one, 1), (3, one, None), (4, None, 1), (5, [], 1), (6, [0.0] * 4, 1),
        (7, [1.0, None, 3.0, 4.0], 1), (8, [1.0, float("nan"), 3.0, 4.0], 1),
        (9, [float("inf"), 2.0, 3.0, 4.0], 1), (10, [1.0, 2.0, 3.0], 1), (None, one, 1),
        (11, one, 2), (12, [1e-30 * x for x in one], 1), (13, [-x for x in one], 1),
        (2, one, 1), (14, [5.0], 3), (15, [7.0], 3), (16, [-1.0], 3), (None, None, None),
        (17, [1e30, 2e30, 3e30, 4e30], 1)]
    assert found(table(spark, rows)) == expected(rows)


def test_empty_table(spark):
    assert found(table(spark, [])) == []


def test_near_vectors_share_a_filter():
    rng = np.random.default_rng(0)
    for dim in (3, 16, 64, 300):
        x = cap_filters.unit(rng.standard_normal((150, dim)))
        z = rng.standard_normal((150, dim))
        z = cap_filters.unit(z - (z * x).sum(1, keepdims=True) * x)
        y = 0.93 * x + np.sqrt(1 - 0.93 ** 2) * z
        met = [len(np.intersect1d(a, b)) > 0
               for a, b in zip(cap_filters.filters_of(x), cap_filters.filters_of(y))]
        assert np.mean(met) >= 0.99


def test_query_finds_the_pairs_of_the_table(spark, data):
    vectors = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    assert found(vectors.withColumn("extra", F.lit(1))) == expected(rows)
