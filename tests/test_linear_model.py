"""Linear models with factors and several numbers, against numpy's least squares."""

from __future__ import annotations

import random

import numpy as np
import pytest

import surveyframe as sf

SCHEMA = "y double, `x one` double, x2 double, g string, `h.2` int, w double"


def rows(n=600, centre=0.0, seed=2):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x1, x2 = rng.gauss(0, 2), rng.uniform(-1, 5)
        g, h = rng.choice("abcd"), rng.choice([1, 2, 30])
        y = centre + 2 * x1 - x2 + {"a": 0, "b": 3, "c": -1, "d": 5}[g] + h / 10 + rng.gauss(0, 1)
        out.append((y, centre + x1, x2, g, h, rng.uniform(0.2, 3)))
    return out


BAD = [(None, 1.0, 1.0, "a", 1, 1.0), (1.0, None, 1.0, "a", 1, 1.0), (1.0, 1.0, 1.0, None, 1, 1.0),
       (1.0, 1.0, 1.0, "a", None, 1.0), (1.0, 1.0, 1.0, "a", 1, None), (1.0, 1.0, 1.0, "a", 1, 0.0),
       (float("nan"), 1.0, 1.0, "a", 1, 1.0)]


def frame(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(4)


def fitted(table, weighted, shift=0.0):
    """Estimates and errors by term."""
    x = np.array([[1.0, r[1] - shift, r[2], *[r[3] == g for g in "bcd"], *[r[4] == h for h in (2, 30)]]
                  for r in table], float)
    y = np.array([r[0] - shift for r in table])
    w = np.array([r[5] if weighted else 1.0 for r in table])
    inverse = np.linalg.inv(x.T @ (x * w[:, None]))
    beta = inverse @ x.T @ (w * y)
    s2 = (w * (y - x @ beta) ** 2).sum() / (len(y) - x.shape[1])
    names = ["(Intercept)", "x one", "x2", "gb", "gc", "gd", "h.22", "h.230"]
    return dict(zip(names, zip(beta, np.sqrt(s2 * np.diag(inverse))))), len(y) - x.shape[1]


@pytest.mark.parametrize("weight", [None, "w"])
def test_against_least_squares(spark, weight):
    table = rows()
    model = sf.linear_model(
        frame(spark, table + (BAD if weight else BAD[:4])), "y", ["x one", "x2"],
        factors=["g", "h.2"], weight=weight)
    wanted, df = fitted(table, weight)
    found = {r.term: r for r in model.collect()}
    assert list(found) == list(wanted)
    for term, (estimate, error) in wanted.items():
        row = found[term]
        assert row.estimate == pytest.approx(estimate, rel=1e-9, abs=1e-10)
        assert row.std_error == pytest.approx(error, rel=1e-9)
        assert (row.df, row.aliased) == (df, False)
        assert row.conf_int_lower < row.estimate < row.conf_int_upper


def test_large_means_keep_their_digits(spark):
    table = rows(centre=1.0e7)
    found = {r.term: r for r in sf.linear_model(
        frame(spark, table), "y", ["x one", "x2"], factors=["g", "h.2"]).collect()}
    wanted, _ = fitted(table, False, shift=1.0e7)
    for term, (estimate, error) in list(wanted.items())[1:]:
        assert found[term].estimate == pytest.approx(estimate, rel=1e-6, abs=1e-7)
        assert found[term].std_error == pytest.approx(error, rel=1e-6)


@pytest.mark.parametrize("weight", [None, "weight"])
def test_two_levels_are_the_regression_on_a_dummy(lineitem, weight):
    table = lineitem.filter("l_returnflag IN ('R', 'A')").selectExpr(
        "*", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned")
    dummy = sf.linear_regression(table, "known_price", "returned", weight=weight).collect()
    for model in (sf.linear_model(table, "known_price", factors="l_returnflag", weight=weight),
                  sf.linear_model(table, "known_price", "returned", weight=weight)):
        for one, other in zip(dummy, model.collect()):
            assert list(one)[1:] == pytest.approx(list(other)[1:-1], rel=1e-8)


def test_aliased_columns_are_reported(spark):
    table = frame(spark, rows()).selectExpr(
        "*", "3 * x2 - 1 AS again", "5 AS fixed", "g IN ('b', 'c') AS both")
    model = sf.linear_model(table, "y", ["x2", "again", "fixed"], factors=["g", "both"]).collect()
    aliased = {r.term for r in model if r.aliased}
    assert aliased == {"again", "fixed", "bothtrue"}
    assert all((r.estimate is None) == r.aliased for r in model)
    plain = sf.linear_model(table, "y", "x2", factors="g").collect()
    kept = [r for r in model if not r.aliased]
    assert [r.term for r in kept] == [r.term for r in plain]
    for one, other in zip(kept, plain):
        assert list(one)[1:4] == pytest.approx(list(other)[1:4], rel=1e-9)


def test_given_levels(spark):
    table = frame(spark, rows())
    found = {r.term: r for r in sf.linear_model(
        table, "y", factors={"g": ["d", "a"]}).collect()}
    assert list(found) == ["(Intercept)", "ga"]
    kept = [r for r in rows() if r[3] in "ad"]
    means = {g: np.mean([r[0] for r in kept if r[3] == g]) for g in "ad"}
    assert found["(Intercept)"].estimate == pytest.approx(means["d"])
    assert found["ga"].estimate == pytest.approx(means["a"] - means["d"])
    assert found["ga"].df == len(kept) - 2


def test_many_levels_in_one_system(spark):
    rng = random.Random(5)
    table = [(float(i % 120) + rng.gauss(0, 1), 0.0, 0.0, f"{i % 120:03d}", 1, 1.0)
             for i in range(1_200)]
    model = sf.linear_model(frame(spark, table), "y", factors="g").collect()
    assert len(model) == 120
    means = {g: np.mean([r[0] for r in table if r[3] == g]) for g in {r[3] for r in table}}
    for row in model[1:]:
        assert row.estimate == pytest.approx(means[row.term[1:]] - means["000"], rel=1e-9)


def test_only_an_intercept_no_rows_and_too_many_levels(spark):
    table = frame(spark, rows())
    alone = sf.linear_model(table, "y").first()
    y = np.array([r[0] for r in rows()])
    assert alone.estimate == pytest.approx(y.mean())
    assert alone.std_error == pytest.approx(y.std(ddof=1) / len(y) ** 0.5)
    nothing = sf.linear_model(frame(spark, []), "y", "x2").collect()
    assert [(r.term, r.estimate, r.std_error) for r in nothing] == [
        ("(Intercept)", None, None), ("x2", None, None)]
    wide = spark.range(1_000).selectExpr("CAST(id AS DOUBLE) AS y", "id AS g")
    with pytest.raises(ValueError, match="more than 300 levels"):
        sf.linear_model(wide, "y", factors="g")
