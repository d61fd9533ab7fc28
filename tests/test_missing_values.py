"""Missing values, empty groups and degenerate inputs."""

from __future__ import annotations

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from surveyframe.functions.columns import divide, dummy, not_in, number
from surveyframe.operators import (
    domains, means, outliers, proportions, ratios, regression, report, survey, tables,
)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def by_key(df, key):
    return {r[key]: r for r in df.collect()}


def test_outcome_missing_counts_in_the_denominator(spark):
    table = frame(spark, [("a", 1), ("a", 0), ("a", None), ("b", 0)], "d string, y int")
    rows = by_key(domains.domain_vs_overall(table, "d", "y"), "domain_var_value")
    assert (rows["a"].n_weighted, rows["a"].x_weighted) == (3.0, 1.0)
    assert rows["a"].p_weighted == pytest.approx(1 / 3)


def test_rows_without_domain_count_only_overall(spark):
    table = frame(
        spark, [("a", 1), ("a", 0), ("b", 0), ("b", 0), (None, 1), (None, 1)], "d string, y int")
    rows = by_key(domains.domain_vs_overall(table, "d", "y"), "domain_var_value")
    assert set(rows) == {"a", "b", "overall"}
    assert (rows["overall"].n_unweighted, rows["overall"].x_unweighted) == (6, 3)
    # Complement of a is b alone: share 2 / 4 of a difference of 1/2.
    assert rows["a"].diff_btw_domain_and_overall_p == pytest.approx(0.25)


def test_missing_weight_counts_as_a_row_only(spark):
    table = frame(spark, [("a", 1, 2.0), ("a", 1, None), ("b", 0, 1.0)],
                  "d string, y int, w double")
    row = by_key(domains.domain_vs_overall(table, "d", "y", weight="w"), "domain_var_value")["a"]
    assert (row.n_weighted, row.n_unweighted, row.x_weighted, row.x_unweighted) == (2.0, 2, 2.0, 2)


def test_single_domain_has_no_complement(spark):
    table = frame(spark, [("a", 1, 0.1), ("a", 0, 0.2), ("a", 1, 0.7)], "d string, y int, w double")
    row = by_key(domains.domain_vs_overall(table, "d", "y", weight="w"), "domain_var_value")["a"]
    assert row.p_weighted == pytest.approx(0.8)
    assert row.diff_btw_domain_and_overall_p is None
    assert row.diff_btw_domain_and_overall_significant is None


def test_complement_without_successes_is_exactly_zero(spark):
    rows = [("a", 1, 0.1)] * 7 + [("a", 1, 0.3)] * 9 + [("b", 0, 0.7)] * 11
    table = frame(spark, rows, "d string, y int, w double")
    row = by_key(domains.domain_vs_overall(table, "d", "y", weight="w"), "domain_var_value")["a"]
    n, others = 7 * 0.1 + 9 * 0.3, 11 * 0.7
    assert row.diff_btw_domain_and_overall_p == pytest.approx(others / (n + others), rel=1e-12)


def test_domain_of_zero_weight_is_kept_and_suppressed(spark):
    rows = [("a", 1, 0.0)] * 200 + [("b", 1, 1.0), ("b", 0, 1.0)] * 100
    table = frame(spark, rows, "d string, y int, w double")
    row = by_key(domains.domain_vs_overall(table, "d", "y", weight="w"), "domain_var_value")["a"]
    assert (row.n_unweighted, row.p_weighted, row.conf_int_lower) == (200, None, None)
    assert (row.suppressed_flag, row.unreliable_flag) == (1, 0)


def test_domain_named_overall_and_numeric_domains(spark):
    table = frame(spark, [(1, 1), (1, 0), (2, 0)], "d int, y int")
    rows = by_key(domains.domain_vs_overall(table, "d", "y"), "domain_var_value")
    assert set(rows) == {"1", "2", "overall"}


@pytest.mark.parametrize("among_known", [True, False])
def test_outcome_other_than_binary_stops(spark, among_known):
    table = frame(spark, [("a", 1), ("b", 0), ("b" if among_known else None, 2)],
                  "d string, y int")
    with pytest.raises(PySparkException, match="must hold only 0, 1 or NULL"):
        domains.domain_vs_overall(table, "d", "y").collect()


def test_binary_check_applies_to_proportions_too(spark):
    table = frame(spark, [("a", 1.0), ("b", 0.5)], "g string, y double")
    for test in (
        lambda: proportions.wilson_intervals(table, "y", "g"),
        lambda: proportions.margin_of_error(table, "y"),
        lambda: proportions.prop_test(table, "y", "g", "a", "b"),
    ):
        with pytest.raises(PySparkException, match="must hold only 0, 1 or NULL"):
            test().collect()
    found = by_key(tables.binary_violations(table, "y"), "column")
    assert found["y"].violations == 1


def test_boolean_outcome_counts_as_dummy(spark):
    table = frame(spark, [("a", True), ("a", False), ("a", None)], "g string, y boolean")
    row = proportions.grouped_proportions(table, "y", "g").first()
    assert (row.n_unweighted, row.x_unweighted) == (3, 1)


def arms(spark):
    rows = []
    for domain, t_hits, c_hits in (("a", 40, 30), ("b", 0, 60)):
        rows += [(domain, 1, 0, int(i < t_hits), 1.0) for i in range(100)]
        rows += [(domain, 0, 1, int(i < c_hits), 1.0) for i in range(100)]
    rows += [("only treatment", 1, 0, int(i < 50), 1.0) for i in range(100)]
    rows += [("only control", 0, 1, 1, 1.0) for _ in range(30)]
    rows += [(None, 1, 0, 1, 1.0), ("a", None, None, 1, 1.0), ("a", 0, 0, 1, 1.0)]
    return frame(spark, rows, "d string, t int, c int, y int, w double")


def arm_report(spark, **options):
    return by_key(report.treatment_control_report(
        arms(spark), "d", treatment="t", control="c", first_outcome="y", second_outcome="y",
        control_outcome="y", weight="w", **options), "treatment_fraud_domain_var_value")


def test_report_domains_and_sides(spark):
    rows = arm_report(spark)
    assert set(rows) == {"a", "b", "only treatment", "overall"}
    alone = rows["only treatment"]
    assert alone.control_denied_p_weighted_output is None
    assert alone.control_denied_conf_int_output is None
    assert alone.diff_btw_treatment_and_control_p_weighted_output is None
    assert alone.treatment_denied_p_weighted_output == "50.0%*"
    assert rows["b"].treatment_denied_p_weighted_output == "-"
    assert rows["b"].diff_btw_treatment_and_control_p_weighted_output == "-"
    assert rows["b"].diff_btw_treatment_and_control_denied_conf_int_output == "-"
    assert rows["a"].diff_btw_treatment_and_control_denied_conf_int_output.startswith("-- to ")


def test_expanded_report_of_a_missing_side(spark):
    row = arm_report(spark, expanded=True)["only treatment"]
    names = [c for c in row.asDict() if c.startswith("control_denied_")]
    assert len(names) == 22 + 2
    assert all(row[c] is None for c in names)
    assert row.diff_btw_treatment_and_control_denied_p_weighted_suppressed_flag == 0
    assert row.diff_btw_treatment_and_control_denied_p_weighted_unreliable_flag == 0
    assert len(row) == 24 + 22 + 22 + 8 + 6 + 4


def test_outlier_percentages_include_rows_without_value(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0, None, None, None, None, None]
    table = frame(spark, [(v,) for v in values], "v double")
    row = outliers.outlier_summary(table, "v").first()
    assert (row.upper_outlier_count, row.upper_outlier_pct) == (1, 0.1)
    assert (row.q75, row.q50) == (4.0, 3.0)
    flags = outliers.flag_outliers(table, "v").agg(F.sum("v_upper_outlier_flag")).first()[0]
    assert flags == 1


def test_single_valued_groups_have_no_outliers(spark):
    rows = [("one", 5.0), ("one", 5.0), ("one", None), ("none", None), (None, 1.0), (None, 2.0),
            (None, 3.0), (None, 50.0)]
    table = frame(spark, rows, "g string, v double")
    found = by_key(outliers.outlier_summary(table, "v", "g"), "g")
    for g in ("one", "none"):
        assert found[g].q50 is None and found[g].upper_outlier_threshold is None
        assert (found[g].lower_outlier_count, found[g].upper_outlier_count) == (0, 0)
    assert found[None].upper_outlier_threshold == pytest.approx(14.75 + 1.5 * 13.0)
    assert found[None].upper_outlier_count == 1
    cleaned = outliers.null_outliers(table, "v", "both", "g")
    assert sorted(r.v for r in cleaned.filter("g IS NULL").collect() if r.v is not None) == [
        1.0, 2.0, 3.0]
    assert [r.v for r in cleaned.filter("g = 'one'").collect()].count(5.0) == 2


def test_equal_quartiles_flag_both_sides(spark):
    table = frame(spark, [(v,) for v in [1.0] + [5.0] * 8 + [9.0]], "v double")
    row = outliers.outlier_summary(table, "v").first()
    assert (row.lower_outlier_count, row.upper_outlier_count) == (9, 9)


def test_fences_come_from_the_original_column(spark):
    table = frame(spark, [(v, v) for v in [1, 2, 3, 4, 1000, -1000]], "a int, b int")
    once = outliers.null_outliers(table, ["a", "b"], "both").collect()
    assert all(r.a == r.b for r in once)
    assert dict(outliers.null_outliers(table, "a", "upper").dtypes) == {"a": "double", "b": "int"}


def test_nan_is_missing(spark):
    table = frame(spark, [("x", 1.0), ("x", math.nan), ("x", 3.0), ("y", 2.0), ("y", 4.0)],
                  "g string, v double")
    row = means.two_sample_means(table, "v", "g", "x", "y").first()
    assert (row.x_unweighted_count, row.x_na_count, row.mean_x) == (2, 1, 2.0)
    assert [r[0] for r in table.select(number("v")).collect()].count(None) == 1


def test_t_test_without_spread_or_with_one_row_gives_null(spark):
    table = frame(spark, [("x", 1.0), ("x", 1.0), ("y", 1.0), ("y", 1.0), ("z", 3.0)],
                  "g string, v double")
    same = means.welch_t_test(table, "v", "g", "x", "y").first()
    assert (same.diff_in_means, same.t_stat, same.p_value) == (0.0, None, None)
    single = means.welch_t_test(table, "v", "g", "x", "z").first()
    assert (single.n_y, single.std_error, single.p_value) == (1, None, None)
    empty = means.welch_t_test(table, "v", "g", "x", "nobody").first()
    assert (empty.n_y, empty.diff_in_means) == (0, None)


def test_other_levels_and_missing_levels_are_left_out(spark):
    table = frame(spark, [("x", 1.0), ("x", 3.0), ("y", 2.0), ("y", 5.0), ("z", 1e9), (None, 1e9)],
                  "g string, v double")
    row = means.welch_t_test(table, "v", "g", "x", "y").first()
    assert (row.mean_x, row.mean_y) == (2.0, 3.5)


@pytest.mark.parametrize("weights, test_type, used", [
    ([2.0, 2.0, 7.0, 7.0], "t.test", (False, False)),
    ([2.0, 1.0, 7.0, 7.0], "wtd.t.test", (True, False)),
    ([2.0, None, 7.0, 7.0], "wtd.t.test", (True, False)),
    ([2.0, 2.0, 7.0, 3.0], "wtd.t.test", (False, True)),
])
def test_dispatch_on_constant_weights(spark, weights, test_type, used):
    rows = [(g, v, w) for (g, v), w in zip(
        [("x", 1.0), ("x", 4.0), ("y", 2.0), ("y", 8.0)], weights)]
    table = frame(spark, rows, "g string, v double, w double")
    row = means.two_sample_means(table, "v", "g", "x", "y", weight="w").first()
    assert (row.test_type, row.weights_x_used, row.weights_y_used) == (test_type, *used)
    if test_type == "wtd.t.test" and row.std_error is not None:
        assert row.conf_int_upper - row.diff_in_means == pytest.approx(2 * row.std_error)


def test_dummy_and_filters_with_missing_values(spark):
    table = frame(spark, [("a",), ("b",), (None,)], "k string")
    found = table.select(dummy(F.col("k") == "a").alias("d"))
    assert sorted((r.d for r in found.collect()), key=str) == [0, 1, None]
    kept = table.filter(not_in("k", ["a"])).collect()
    assert {r.k for r in kept} == {"b", None}


def test_division_by_zero_is_null(spark):
    row = spark.range(1).select(divide(F.lit(1.0), F.lit(0.0))).first()
    assert row[0] is None


def test_member_flag_matches_missing_with_missing(spark):
    left = frame(spark, [(1,), (2,), (None,)], "k int")
    with_null = frame(spark, [(1,), (1,), (None,)], "m int")
    found = by_key(ratios.member_flag(left, "k", with_null, "m", "f"), "k")
    assert {k: r.f for k, r in found.items()} == {1: True, 2: False, None: True}
    without = with_null.filter("m IS NOT NULL")
    found = by_key(ratios.member_flag(left, "k", without, "m", "f"), "k")
    assert found[None].f is False


def test_group_totals_treat_missing_keys_as_a_group(spark):
    table = frame(spark, [("a", 1.0), ("a", 3.0), (None, 2.0), (None, None), ("z", 0.0)],
                  "k string, v double")
    rows = tables.group_total(table, "v", "k", count="n", share="share").collect()
    assert sorted((str(r.k), r.group_total, r.n, r.share) for r in rows if r.v is not None) == [
        ("None", 2.0, 2, 1.0), ("a", 4.0, 2, 0.25), ("a", 4.0, 2, 0.75), ("z", 0.0, 1, None)]


def test_crosstab_looks_levels_up_and_keeps_missing_rows(spark):
    table = frame(spark, [(1, "a"), (1, "a"), (1, "b"), (None, "b")], "r int, c string")
    for levels in (None, ["a", "b"]):
        found = by_key(tables.crosstab(table, "r", "c", levels), "r")
        assert {k: (r.a, r.b) for k, r in found.items()} == {1: (2, 1), None: (0, 1)}


def test_rows_without_value_are_on_neither_side_of_the_mean(spark):
    table = frame(spark, [(1.0,), (2.0,), (3.0,), (None,)], "v double")
    for above, expected in ((True, [2.0, 3.0]), (False, [1.0])):
        kept = tables.filter_by_mean(table, "v", above=above)
        assert sorted(r.v for r in kept.collect()) == expected
    strict = tables.filter_by_mean(table, "v", inclusive=False)
    assert [r.v for r in strict.collect()] == [3.0]


def test_stacked_tables_fill_absent_columns(spark):
    stacked = tables.stack_tables({
        "x": frame(spark, [(1, "a")], "k int, only_x string"), "y": frame(spark, [(2,)], "k int")})
    assert sorted(map(tuple, stacked.collect())) == [(1, "a", "x"), (2, None, "y")]


def test_mean_of_ratios_skips_zero_denominators(spark):
    table = frame(spark, [(1.0, 2.0), (3.0, 0.0), (None, 1.0)], "a double, b double")
    row = ratios.mean_of_ratios(table, "a", "b").first()
    assert row.mean_of_ratios == 0.5


def test_lonely_stratum_stops_with_its_name(spark):
    table = frame(spark, [("north", 1.0), ("north", 2.0), ("south", 3.0)], "s string, y double")
    with pytest.raises(PySparkException, match="single row: south"):
        survey.survey_mean(table, "y", survey.SurveyDesign(strata="s")).collect()


def test_strata_overview_counts_missing_as_a_stratum(spark):
    table = frame(spark, [("n", 1.0, 1), ("s", 2.0, 0), (None, 3.0, None)],
                  "s string, w double, y int")
    row = survey.strata_overview(table, survey.SurveyDesign("w", "s"), "y").first()
    assert (row.sum_of_weights, row.strata) == (6.0, 3)
    assert row.unweighted_share == pytest.approx(1 / 3)


def test_regression_leaves_incomplete_rows_out(spark):
    table = frame(
        spark, [(1.0, 0.0, 1.0), (2.0, 1.0, 1.0), (4.0, 1.0, 1.0), (None, 1.0, 1.0),
                (9.0, None, 1.0), (50.0, 1.0, 0.0), (2.0, 0.0, 1.0)],
        "y double, x double, w double")
    rows = by_key(regression.linear_regression(table, "y", "x", weight="w"), "term")
    assert rows["x"].estimate == pytest.approx(1.5)
    assert rows["x"].df == 2


def test_share_pipeline_by_hand(spark):
    events = frame(spark, [
        (1, "d1", "drug"), (1, "d1", "drug"), (1, "d2", "drug"), (1, "d2", "theft"),
        (2, "d1", "undefined"), (2, "d1", "theft"), (3, "d1", "drug"), (4, "d1", None)],
        "id int, day string, kind string")
    listed = frame(spark, [(3,)], "id int")
    owners = frame(spark, [(1, 1, "yes"), (1, 1, "no"), (1, 0, "never"), (2, 1, "yes")],
                   "owner int, principal int, approved string")
    counts = ratios.person_category_counts(
        events, "id", "day", "kind", relabelled=listed, new_label="hidden",
        excluded_labels=["undefined"], attributes=owners, attributes_key="owner",
        attributes_filter=F.col("principal") == 1, attribute_columns=["approved"])
    # Person 1 has two sets of attributes, so every day counts once per set.
    listed_rows = ratios.listed_counts(counts)
    assert sorted((r.person, str(r.category), r.dates) for r in listed_rows.collect()) == [
        (1, "drug", 4), (1, "drug", 4), (1, "theft", 2), (1, "theft", 2), (2, "theft", 1),
        (3, "hidden", 1), (4, "None", 1)]
    shares = by_key(ratios.category_shares(counts), "category")
    assert shares["drug"].mean_share == pytest.approx(4 / 12)
    assert shares["theft"].persons == 3
    assert shares["theft"].mean_share == pytest.approx((2 / 12 + 2 / 12 + 1) / 3)
    first = ratios.listed_counts(
        ratios.person_category_counts(events, "id", "day", "kind"), first_rows=2).collect()
    assert [(r.person, r.category) for r in first] == [(1, "drug"), (1, "theft")]
