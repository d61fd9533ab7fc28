"""Several domain columns in one reading, and reports from sums that are kept and refreshed."""

from __future__ import annotations

import random
from pathlib import Path

import compare
import pytest
from pyspark.sql import functions as F

import surveyframe as sf

SCHEMA = ("day string, `the region` string, size int, treated int, control int, a int, b int,"
          " c int, w double")
DOMAINS = ["the region", "size"]
REPORT = {"treatment": "treated", "control": "control", "first_outcome": "a",
          "second_outcome": "b", "control_outcome": "c", "weight": "w"}


def rows(days, n=400, seed=1):
    rng = random.Random(f"{seed}{days}")

    def bit():
        return rng.choice([0, 0, 1, None])

    return [(rng.choice(days), rng.choice(["north", "south", "overall", None]),
             rng.choice([1, 2, 30, None]), bit(), bit(), bit(), bit(), bit(),
             rng.choice([0.5, 1.0, 2.0, None])) for _ in range(n)]


def frame(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(3)


def plain(df):
    def short(value):
        return round(value, 9) if isinstance(value, float) else value
    return compare.rows_of(df.columns, [[short(v) for v in r] for r in df.collect()])


def test_domains_together_are_the_domains_one_by_one(spark):
    table = frame(spark, rows(["x"]))
    options = {"weight": "w", "strict": False}
    many = sf.domain_vs_overall(table, DOMAINS, "a", **options)
    single = [sf.domain_vs_overall(table, d, "a", **options) for d in DOMAINS]
    assert plain(many) == sorted(
        plain(single[0]) + plain(single[1]), key=lambda r: tuple("" if v is None else v for v in r))
    assert plain(sf.domain_vs_overall(table, DOMAINS[:1], "a", **options)) == plain(single[0])


@pytest.mark.parametrize("expanded", [False, True])
def test_report_of_several_domains(spark, expanded):
    table = frame(spark, rows(["x"], 2_000))
    many = sf.treatment_control_report(table, DOMAINS, **REPORT, expanded=expanded)
    for domain in DOMAINS:
        one = sf.treatment_control_report(table, domain, **REPORT, expanded=expanded)
        mine = many.filter(F.col("treatment_fraud_domain_var") == domain).select(one.columns)
        assert plain(mine) == plain(one)


def test_no_rows_and_wrong_names(spark):
    empty = frame(spark, [])
    found = sf.domain_vs_overall(empty, DOMAINS, "a").collect()
    assert sorted((r.domain_var, r.is_overall, r.n_weighted) for r in found) == [
        ("size", True, 0.0), ("the region", True, 0.0)]
    for domains in ([], ["size", "size"], ["size", "absent"]):
        with pytest.raises(ValueError):
            sf.domain_vs_overall(empty, domains, "a")


def test_an_outcome_that_is_not_binary_stops_the_job(spark):
    table = frame(spark, [(*r[:5], 7, *r[6:]) for r in rows(["x"], 20)])
    with pytest.raises(Exception, match="a must hold only 0, 1 or NULL"):
        sf.domain_vs_overall(table, DOMAINS, "a").collect()


def test_plan_of_several_domains(spark):
    table = frame(spark, rows(["x"]))
    plan = sf.domain_vs_overall(table, DOMAINS, "a")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def report(spark, path, **options):
    return plain(sf.report_from_sums(spark, path, DOMAINS, **options))


@pytest.mark.parametrize("expanded", [False, True])
def test_stored_sums_give_the_report_of_all_rows(spark, tmp_path, expanded):
    path = str(tmp_path / "sums")
    old, late = rows(["mon", "tue", None], 900), rows(["wed"], 500)
    corrected = rows(["tue"], 300, seed=2)
    for arrived in (old, late, corrected):
        sf.store_report_sums(frame(spark, arrived), path, DOMAINS, "day", **REPORT)
    held = [r for r in old if r[0] != "tue"] + late + corrected
    whole = sf.treatment_control_report(frame(spark, held), DOMAINS, **REPORT, expanded=expanded)
    assert report(spark, path, expanded=expanded, outcomes=("a", "b", "c")) == plain(whole)
    one = sf.treatment_control_report(frame(spark, held), "size", **REPORT, expanded=expanded)
    assert plain(sf.report_from_sums(
        spark, path, "size", expanded=expanded, outcomes=("a", "b", "c"))) == plain(one)


def test_only_parts_that_arrive_are_written(spark, tmp_path):
    path = tmp_path / "sums"

    def files():
        return {str(f): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}

    sf.store_report_sums(frame(spark, rows(["mon", "tue"])), str(path), DOMAINS, "day", **REPORT)
    before = files()
    sf.store_report_sums(frame(spark, rows(["wed"])), str(path), DOMAINS, "day", **REPORT)
    after = files()
    assert before.items() <= after.items() and len(after) > len(before)
    sf.store_report_sums(frame(spark, rows(["mon"])), str(path), DOMAINS, "day", **REPORT)
    kept = {f for f in after if "day=mon" not in f and "part=mon" not in f}
    assert {f: files()[f] for f in kept} == {f: after[f] for f in kept}
    assert not {f for f in after if "part=mon" in f} & set(files())


def test_a_part_that_loses_all_its_cases_is_replaced(spark, tmp_path):
    path = str(tmp_path / "sums")
    table = rows(["mon", "tue"], 800)
    sf.store_report_sums(frame(spark, table), path, DOMAINS, "day", **REPORT)
    none = [("tue", "north", 1, 0, 0, 1, 1, 1, 1.0)]
    sf.store_report_sums(frame(spark, none), path, DOMAINS, "day", **REPORT)
    held = [r for r in table if r[0] == "mon"]
    assert report(spark, path) == plain(
        sf.treatment_control_report(frame(spark, held), DOMAINS, **REPORT))


def test_sums_of_other_outcomes_are_refused(spark, tmp_path):
    path = str(tmp_path / "sums")
    sf.store_report_sums(
        frame(spark, rows(["mon"])), path, DOMAINS, "day", **REPORT, first="theft")
    with pytest.raises(ValueError, match="unknown column"):
        sf.report_from_sums(spark, path, DOMAINS)
