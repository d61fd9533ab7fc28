"""Survey designs: strata, clusters, finite populations, subpopulations; bad designs stop the job."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import surveyframe as sf
from surveyframe.plans.two_samples import two_sample_moments

SCHEMA = "h string, u string, size double, w double, y double, x double, g string"


def rows(seed: int = 4, lonely: bool = False) -> list[tuple]:
    rng = random.Random(seed)
    made = []
    for h, size in (("north", 40.0), ("south", 25.0), (None, 60.0)):
        for unit in range(rng.randint(4, 9)):
            for _ in range(rng.randint(1, 5)):
                made.append((h, f"u{unit}", size, rng.uniform(0.5, 3), rng.gauss(10, 3) + unit,
                             rng.uniform(1, 4), rng.choice("ab")))
    made += [("north", "u0", 40.0, 1.0, None, 2.0, "a"), ("south", "u9", 25.0, None, 1.0, 1.0, "b"),
             ("south", "u1", 25.0, 0.0, 100.0, 1.0, "a")]
    if lonely:
        made.append(("lone", "u0", 30.0, 2.0, 14.0, 3.0, "b"))
    return made


def variance(influences: list[tuple], lonely: str = "fail") -> tuple[float, int, int]:
    """(variance, strata, units) from (stratum, unit, population, influence, inside)."""
    units, used, sizes = defaultdict(float), set(), {}
    for h, u, size, z, inside in influences:
        units[h, u] += z if inside else 0.0
        sizes[h] = size
        if inside:
            used.add((h, u))
    parts, alone = [], []
    for h in {h for h, _ in units}:
        z = [v for (k, _), v in units.items() if k == h]
        n = len(z)
        f = 1 - n / sizes[h] if sizes[h] else 1.0
        if n == 1:
            alone.append({"adjust": f * z[0] ** 2, "remove": 0.0}.get(lonely))
        else:
            m = sum(z) / n
            parts.append(f * n / (n - 1) * sum((v - m) ** 2 for v in z))
    mean = sum(parts) / len(parts)
    total = sum(parts) + sum(mean if a is None else a for a in alone)
    return total, len({h for h, _ in used}), len(used)


def weighted_mean(table, inside=lambda r: True):
    mine = [r for r in table if inside(r)]
    total = sum(r[3] for r in mine)
    return sum(r[3] * r[4] for r in mine) / total, total


def frame(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(4)


def complete(table):
    return [r for r in table if r[3] is not None and r[4] is not None]


@pytest.mark.parametrize("lonely", ["remove", "adjust", "average"])
def test_clustered_mean_and_lonely_strata(spark, lonely):
    table = rows(lonely=True)
    design = sf.SurveyDesign(weight="w", strata="h", unit="u", fpc="size", lonely=lonely)
    found = sf.survey_mean(frame(spark, table), "y", design, level=0.95).first()
    used = complete(table)
    mean, total = weighted_mean(used)
    wanted, strata, units = variance(
        [(r[0], r[1], r[2], r[3] * (r[4] - mean) / total, True) for r in used], lonely)
    assert (found.n, found.strata, found.units) == (len(used), strata, units)
    assert found.df == units - strata
    assert found.mean == pytest.approx(mean, rel=1e-12)
    assert found.std_error == pytest.approx(math.sqrt(wanted), rel=1e-10)
    reach = found.conf_int_upper - found.mean
    assert reach == pytest.approx(found.mean - found.conf_int_lower) and reach > 2 * found.std_error


def test_ratio_and_subpopulation(spark):
    table = rows()
    design = sf.SurveyDesign(weight="w", strata="h", unit="u", fpc="size")
    used = [r for r in table if r[3] is not None and (r[4] is not None or r[6] != "a")]
    mine = [r for r in used if r[6] == "a" and r[4] is not None]
    total = sum(r[3] * r[5] for r in mine)
    ratio = sum(r[3] * r[4] for r in mine) / total
    wanted, strata, units = variance([
        (r[0], r[1], r[2], r[3] * (r[4] - ratio * r[5]) / total if r[6] == "a" else 0, r[6] == "a")
        for r in used])
    found = sf.survey_ratio(
        frame(spark, table), "y", "x", design, where=F.col("g") == "a").first()
    assert (found.n, found.strata, found.units) == (len(mine), strata, units)
    assert found.ratio == pytest.approx(ratio, rel=1e-12)
    assert found.std_error == pytest.approx(math.sqrt(wanted), rel=1e-10)


def test_one_unit_per_row_is_the_design_without_units(spark, lineitem):
    each = lineitem.withColumn("row", F.monotonically_increasing_id())
    plain = sf.SurveyDesign(weight="weight", strata="l_returnflag")
    single = sf.SurveyDesign(weight="weight", strata="l_returnflag", unit="row")
    for value in ("known_price", "l_tax"):
        one = sf.survey_mean(each, value, plain, level=0.95).first()
        other = sf.survey_mean(each, value, single, level=0.95).first()
        assert one.units == one.n
        assert list(one) == pytest.approx(list(other), rel=1e-12)


def test_ratio_to_one_is_the_mean(spark, lineitem):
    design = sf.SurveyDesign(weight="weight", strata="l_returnflag", unit="l_orderkey")
    table = lineitem.withColumn("one", F.lit(1.0))
    mean = sf.survey_mean(table, "known_price", design, level=0.95).first()
    for of_rows in (False, True):
        ratio = sf.survey_ratio(table, "known_price", "one", design, of_rows=of_rows).first()
        assert list(ratio) == pytest.approx(list(mean), rel=1e-12)


def test_t_test_by_design_without_strata_is_the_survey_t_test(spark, lineitem):
    one = sf.survey_t_test(lineitem, "known_price", "l_returnflag", "R", "A", "weight").first()
    design = sf.SurveyDesign(weight="weight")
    other = sf.survey_t_test_by_design(
        lineitem, "known_price", "l_returnflag", "R", "A", design).first()
    assert (other.strata, other.units) == (1, other.n_first + other.n_second)
    for name in one.asDict():
        assert one[name] == pytest.approx(other[name], rel=1e-9), name


def test_t_test_with_one_group_at_zero_is_the_mean(spark):
    """Against a group that is always 0 and in strata of its own, the difference is the mean."""
    table = complete(rows())
    zeros = [(f"z{i % 2}", f"z{i}", 50.0, 1.0, 0.0, 1.0, "zero") for i in range(8)]
    design = sf.SurveyDesign(weight="w", strata="h", unit="u", fpc="size")
    mean = sf.survey_mean(frame(spark, table), "y", design, level=0.95).first()
    both = frame(spark, [(*r[:6], "value") for r in table] + zeros)
    tested = sf.survey_t_test_by_design(both, "y", "g", "value", "zero", design).first()
    assert tested.diff_in_means == pytest.approx(-mean.mean, rel=1e-12)
    assert tested.std_error == pytest.approx(mean.std_error, rel=1e-10)
    assert tested.df == mean.df + 8 - 2 - 1


def test_t_test_by_design_against_brute_force(spark):
    table = rows()
    design = sf.SurveyDesign(weight="w", strata="h", unit="u", fpc="size")
    used = complete(table)
    of = {g: weighted_mean(used, lambda r, g=g: r[6] == g) for g in "ab"}
    wanted, strata, units = variance([
        (r[0], r[1], r[2], (1 if r[6] == "b" else -1) * r[3] * (r[4] - of[r[6]][0]) / of[r[6]][1],
         True) for r in used])
    found = sf.survey_t_test_by_design(frame(spark, table), "y", "g", "b", "a", design).first()
    assert found.diff_in_means == pytest.approx(of["b"][0] - of["a"][0], rel=1e-12)
    assert found.std_error == pytest.approx(math.sqrt(wanted), rel=1e-10)
    assert (found.strata, found.units, found.df) == (strata, units, units - strata - 1)


BAD = {
    "single sampling unit in stratum: lone": (
        [("lone", "u", 30.0, 1.0, 1.0, 1.0, "a"), ("x", "u", 30.0, 1.0, 1.0, 1.0, "a"),
         ("x", "v", 30.0, 1.0, 2.0, 1.0, "b")]),
    "population smaller than the sample in stratum: x": (
        [("x", str(i), 2.0, 1.0, float(i), 1.0, "ab"[i % 2]) for i in range(3)]),
    "different population sizes in stratum: x": (
        [("x", str(i), 20.0 + i, 1.0, float(i), 1.0, "ab"[i % 2]) for i in range(3)]),
    "different population sizes in stratum: y": (
        [("y", str(i // 2), 20.0 + i % 2, 1.0, float(i), 1.0, "ab"[i % 2]) for i in range(4)]),
    "a row names no sampling unit": (
        [("x", None if i else "u", 20.0, 1.0, float(i), 1.0, "ab"[i % 2]) for i in range(3)]),
    "w must not be below zero": (
        [("x", str(i), 20.0, float(-i), float(i), 1.0, "ab"[i % 2]) for i in range(3)]),
}


@pytest.mark.parametrize("message", sorted(BAD))
def test_bad_designs_stop_the_job(spark, message):
    design = sf.SurveyDesign(weight="w", strata="h", unit="u", fpc="size")
    table = frame(spark, BAD[message])
    for df in (sf.survey_mean(table, "y", design), sf.survey_ratio(table, "y", "x", design),
               sf.survey_t_test_by_design(table, "y", "g", "a", "b", design)):
        with pytest.raises(Exception, match=message):
            df.collect()


def test_unknown_rule_and_columns(spark):
    table = frame(spark, rows())
    with pytest.raises(ValueError, match="lonely"):
        sf.survey_mean(table, "y", sf.SurveyDesign(lonely="merge"))
    with pytest.raises(ValueError, match="unknown column"):
        sf.survey_mean(table, "y", sf.SurveyDesign(unit="cluster"))


def test_empty_design(spark):
    design = sf.SurveyDesign(weight="w", strata="h", unit="u")
    found = sf.survey_mean(frame(spark, []), "y", design, level=0.95).first()
    assert (found.n, found.units, found.mean, found.std_error) == (0, None, None, None)


def test_weights_below_zero_are_refused_everywhere(spark):
    table = spark.createDataFrame(
        [(1.0, 1.0, "a", 0.0), (2.0, -1.0, "a", 1.0), (3.0, 2.0, "b", 1.0), (5.0, 1.0, "b", 0.0)],
        "y double, w double, g string, hit double")
    for df in (
            sf.weighted_t_test(table, "y", "g", "a", "b", "w"),
            sf.survey_t_test(table, "y", "g", "a", "b", "w"),
            sf.means_of_variables(table, ["y"], "g", "a", "b", weight="w"),
            sf.linear_regression(table, "y", "hit", weight="w"),
            sf.weighted_mean(table, "y", "w"),
            sf.wilson_intervals(table, "hit", "g", weight="w"),
            sf.domain_vs_overall(table, "g", "hit", weight="w"),
            sf.compare_mean_tests(table, "y", "g", "a", "b", "w")):
        with pytest.raises(Exception, match="must not be below zero"):
            df.collect()


def test_populations_of_strata(spark):
    sample = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0)], "h string, y double")

    def sizes(*found):
        return spark.createDataFrame(list(found), "h string, size double")

    twice, small = sizes(("a", 9.0), ("a", 9.0), ("b", 5.0)), sizes(("a", 1.0), ("b", 5.0))
    for operator in (sf.stratified_proportion, sf.stratum_variances):
        with pytest.raises(Exception, match="list a stratum twice: a"):
            operator(sample, "y", "h", twice, "size").collect()
        with pytest.raises(Exception, match="smaller than the sample in stratum: a"):
            operator(sample, "y", "h", small, "size").collect()
    kept = sf.stratified_proportion(sample, "y", "h", sizes(("a", 9.0), ("b", 5.0)), "size").first()
    assert kept.n == 3 and kept.variance > 0


@pytest.mark.parametrize("centre", [0.0, 1.0e6, 1.0e9])
def test_weighted_moments_in_one_scan_keep_their_digits(spark, centre):
    rng = random.Random(11)
    table = [(centre + rng.gauss(0, 1), rng.uniform(0.2, 3), rng.choice("ab")) for _ in range(20_000)]
    df = spark.createDataFrame(table, "y double, w double, g string").repartition(6)
    found = two_sample_moments(df, ["y"], "g", "a", "b", "w").first()
    for side, level in (("x", "a"), ("y", "b")):
        mine = [(y - centre, w) for y, w, g in table if g == level]
        total = math.fsum(w for _, w in mine)
        mean = math.fsum(w * y for y, w in mine) / total
        spread = math.fsum(w * (y - mean) ** 2 for y, w in mine)
        score = math.fsum((w * (y - mean)) ** 2 for y, w in mine)
        assert found[f"{side}_wsum"] == pytest.approx(total, rel=1e-12)
        assert found[f"{side}_wmean"] - centre == pytest.approx(mean, abs=1e-5)
        assert found[f"{side}_wspread"] == pytest.approx(spread, rel=1e-6)
        assert found[f"{side}_wscore"] == pytest.approx(score, rel=1e-6)


def test_weighted_line_in_one_scan_keeps_its_digits(spark):
    rng = random.Random(12)
    table = []
    for _ in range(5_000):
        x = rng.gauss(0, 2)
        table.append((1.0e8 + 3 * x + rng.gauss(0, 1), 1.0e7 + x, rng.uniform(0.2, 3)))
    df = spark.createDataFrame(table, "y double, x double, w double").repartition(3)
    terms = {r.term: r for r in sf.linear_regression(df, "y", "x", weight="w").collect()}
    total = math.fsum(w for *_, w in table)
    mx = math.fsum(w * (x - 1.0e7) for _, x, w in table) / total
    my = math.fsum(w * (y - 1.0e8) for y, _, w in table) / total
    sxx = math.fsum(w * (x - 1.0e7 - mx) ** 2 for _, x, w in table)
    sxy = math.fsum(w * (x - 1.0e7 - mx) * (y - 1.0e8 - my) for y, x, w in table)
    syy = math.fsum(w * (y - 1.0e8 - my) ** 2 for y, _, w in table)
    slope = sxy / sxx
    assert terms["x"].estimate == pytest.approx(slope, rel=1e-6)
    assert terms["x"].std_error == pytest.approx(
        math.sqrt((syy - slope * sxy) / 4_998 / sxx), rel=1e-5)
