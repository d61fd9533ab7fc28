"""Small inputs with values worked out by hand or taken from textbooks."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from surveyframe.functions import distributions, intervals
from surveyframe.functions.columns import percent
from surveyframe.operators import (
    domains, means, outliers, proportions, ratios, report, survey,
)

# Fixed inputs: the samples of the textbook cases, which the golden values belong to.
SAMPLE = [1, 1, 1, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4]
WEIGHTS = [0.5] * 5 + [1.0] * 4 + [2.0] * 5


def close(value):
    """Equal to the seven decimals, or seven digits, that the values are given with."""
    return pytest.approx(value, rel=1e-7, abs=6e-8)


def counts(spark, groups):
    """Rows of a 0/1 outcome: {group: (successes, rows)}."""
    rows = [(g, int(i < x)) for g, (x, n) in groups.items() for i in range(n)]
    return spark.createDataFrame(rows, "g string, hit int")


@pytest.fixture(scope="module")
def samples(spark):
    x = [("x", float(v), w) for v, w in zip(SAMPLE, WEIGHTS)]
    y = [("y", float(v + 1), 1.0) for v in reversed(SAMPLE)]
    return spark.createDataFrame(x + y, "origin string, value double, weight double")


def summary(spark):
    return spark.createDataFrame(
        [(525.751, 373.269, 107.121, 67.498, 10, 10)],
        "m1 double, m2 double, s1 double, s2 double, n1 int, n2 int")


SUMMARY_COLUMNS = ["m1", "m2", "s1", "s2", "n1", "n2"]


def test_welch_from_summary(spark):
    row = means.t_test_from_summary(summary(spark), *SUMMARY_COLUMNS).first()
    assert row.diff_in_means == close(152.482)
    assert row.std_error == close(40.0385922)
    assert row.t_stat == close(3.8083757)
    assert row.df == close(15.1735039)
    assert row.p_value == close(0.0016820462)


def test_pooled_from_summary(spark):
    row = means.t_test_from_summary(
        summary(spark), *SUMMARY_COLUMNS, equal_variance=True).first()
    assert (row.std_error, row.t_stat, row.df) == (close(40.0385922), close(3.8083757), 18)
    assert row.p_value == close(0.0012871404)


def test_conservative_interval_from_summary(spark):
    row = means.t_test_from_summary(
        summary(spark), *SUMMARY_COLUMNS, df_rule="conservative", level=0.90).first()
    reach = 1.8331129326562334 * 40.0385922
    assert row.df == 9
    assert row.conf_int_upper == close(152.482 + reach)
    assert row.conf_int_lower == close(152.482 - reach)


def test_welch(samples):
    row = means.welch_t_test(samples, "value", "origin", "x", "y").first()
    assert (row.mean_x, row.mean_y) == (close(2.0714286), close(3.0714286))
    assert (row.t_stat, row.df, row.p_value) == (close(-2.3185184), 26, close(0.0285482967))


def test_weighted_with_mean_one(samples):
    row = means.weighted_t_test(samples, "value", "origin", "x", "y", "weight").first()
    assert (row.mean_x, row.std_error) == (close(2.6363636), close(0.4251407))
    assert (row.t_stat, row.df) == (close(-1.0233435), close(25.9778004))
    assert row.p_value == close(0.3155811842)


def test_weighted_with_weights_as_counts(samples):
    row = means.weighted_t_test(
        samples, "value", "origin", "x", "y", "weight", mean_one=False).first()
    assert row.n_x == 16.5
    assert (row.t_stat, row.df) == (close(-1.0659179), close(27.3488350))
    assert row.p_value == close(0.2957808872)


@pytest.mark.parametrize("yates, statistic, p_value, interval", [
    (False, 4.8610864, 0.0274690339, (0.0139890, 0.2159621)),
    (True, 4.4092032, 0.0357455342, (0.0085146, 0.2214365)),
])
def test_prop_test(spark, yates, statistic, p_value, interval):
    table = counts(spark, {"x": (91, 149), "y": (117, 236)})
    row = proportions.prop_test(table, "hit", "g", "x", "y", yates=yates).first()
    assert (row.p_x, row.p_y) == (close(0.6107383), close(0.4957627))
    assert (row.statistic, row.p_value) == (close(statistic), close(p_value))
    assert (row.conf_int_lower, row.conf_int_upper) == pytest.approx(interval, abs=1e-7)


def test_prop_test_of_weighted_totals_equals_that_of_rows(spark):
    table = counts(spark, {"x": (91, 149), "y": (117, 236)})
    rows = proportions.prop_test(table, "hit", "g", "x", "y").first()
    grouped = table.groupBy("g", "hit").agg(F.count("*").cast("double").alias("w"))
    totals = proportions.prop_test(grouped, "hit", "g", "x", "y", weight="w").first()
    assert tuple(totals) == pytest.approx(tuple(rows))


def test_one_sample_prop_test(spark):
    row = proportions.prop_test_one_sample(counts(spark, {"x": (30, 100)}), "hit").first()
    assert (row.statistic, row.p_value) == (close(15.21), close(9.61927e-05))
    assert (row.conf_int_lower, row.conf_int_upper) == (close(0.2145426), close(0.4010604))


def test_margin_of_error(spark):
    row = proportions.margin_of_error(counts(spark, {"x": (640, 1600)}), "hit", level=0.99).first()
    assert row.margin_of_error == close(0.0315473)
    assert (row.conf_int_lower, row.conf_int_upper) == (close(0.3684527), close(0.4315473))
    fixed = proportions.margin_of_error(counts(spark, {"x": (111, 370)}), "hit", z=1.96).first()
    assert fixed.margin_of_error == close(0.0466944)


def test_required_sample_size(spark):
    table = counts(spark, {"a": (3, 10), "b": (5, 10), "c": (4, 10)})
    sizes = {r.g: r.required_sample_size
             for r in proportions.required_sample_size(table, "hit", "g").collect()}
    assert sizes == {"a": close(322.6944), "b": close(384.16), "c": close(368.7936)}


def test_wilson(spark):
    table = counts(spark, {"a": (30, 100), "b": (0, 10)})
    found = {r.g: (r.conf_int_lower, r.conf_int_upper)
             for r in proportions.wilson_intervals(table, "hit", "g").collect()}
    assert found["a"] == (close(0.2189475), close(0.3958504))
    assert found["b"] == (pytest.approx(0, abs=1e-12), close(0.2775402))


def test_domain_against_overall(spark):
    table = counts(spark, {"domain": (40, 200), "rest": (30, 300)})
    rows = {r.domain_var_value: r
            for r in domains.domain_vs_overall(table, "g", "hit").collect()}
    row = rows["domain"]
    assert (row.conf_int_lower, row.conf_int_upper) == (close(0.1504512), close(0.2608564))
    assert row.coeff_of_variation == close(0.1401223)
    assert row.diff_btw_domain_and_overall_p == close(0.06)
    assert row.conf_int_lower_weighted_for_diff_btw_domain_and_overall_p == close(0.0221041)
    assert row.conf_int_upper_weighted_for_diff_btw_domain_and_overall_p == close(0.1004613)
    assert row.diff_btw_domain_and_overall_significant == 1
    assert rows["overall"].p_weighted == close(0.14)
    assert rows["overall"].diff_btw_domain_and_overall_p is None


def test_stratified_variance(spark):
    table = counts(spark, {"1": (1, 10), "2": (2, 10), "3": (3, 10)})
    sizes = spark.createDataFrame([(s, 100) for s in "123"], "g string, size int")
    parts = survey.stratum_variances(table, "hit", "g", sizes, "size").collect()
    assert {r.g: r.variance_h for r in parts} == {
        "1": close(0.00818182), "2": close(0.01454545), "3": close(0.01909091)}
    row = survey.stratified_proportion(table, "hit", "g", sizes, "size").first()
    assert (row.variance, row.std_error) == (close(0.0046464646), close(0.0681649813))
    assert row.margin_of_error == close(0.1336033633)


def test_mean_of_ratios(spark):
    arrests = spark.createDataFrame(
        [(1, 1), (1, 1), (1, 1), (1, 1), (1, 1000)], "drug int, every int")
    row = ratios.mean_of_ratios(arrests, "drug", "every").first()
    assert (row.mean_of_ratios, row.ratio_of_means) == (close(0.8002), close(0.00498008))
    shares = spark.createDataFrame([(1, 2), (6, 8), (5, 14)], "top int, bottom int")
    row = ratios.mean_of_ratios(shares, "top", "bottom").first()
    assert (row.mean_of_ratios, row.ratio_of_sums) == (close(0.5357142857), close(0.5))


def test_five_numbers(spark):
    table = spark.createDataFrame([(v,) for v in (1, 2, 4, 8, 9, None)], "v int")
    row = outliers.five_number_summary(table, "v").first()
    assert tuple(row)[1:] == (1, 2, 4, 8, 9)


def test_distributions(spark):
    row = spark.range(1).select(
        distributions.t_p_value(F.lit(2.2621571627982), F.lit(9.0)).alias("t"),
        distributions.t_p_value(F.lit(40.0), F.lit(9.0)).alias("tail"),
        distributions.t_p_value(F.lit(None).cast("double"), F.lit(9.0)).alias("none"),
        distributions.chi_squared_p_value(F.lit(3.841458820694124)).alias("chi"),
        *[distributions.t_quantile(p, F.lit(df)).alias(f"q{i}") for i, (p, df) in enumerate(
            [(0.975, 9.0), (0.975, 2013.0), (0.95, 9.0), (0.975, 1.0), (0.995, 1.0)])],
    ).first()
    assert row.t == close(0.05)
    assert row.tail == pytest.approx(1.9348e-11, rel=1e-3)
    assert row.none is None
    assert row.chi == close(0.05)
    assert tuple(row)[4:] == (
        close(2.2621571628), close(1.9611431569), close(1.8331129327), close(12.7062047364),
        close(63.6567411629))
    assert distributions.normal_quantile(0.975) == pytest.approx(1.959963984540054)


def test_newcombe_is_symmetric(spark):
    table = counts(spark, {"x": (40, 200), "y": (30, 300)})
    forward = proportions.newcombe_differences(table, "hit", "g", "x", "y").first()
    backward = proportions.newcombe_differences(table, "hit", "g", "y", "x").first()
    assert forward.p_diff == close(0.10)
    assert forward.conf_int_lower == close(-backward.conf_int_upper)


def test_percent_labels(spark):
    values = [0.1234, 0.12345, 1.0, 0.0, -0.0001, None]
    table = spark.createDataFrame([(v,) for v in values], "p double")
    assert [r[0] for r in table.select(F.expr(percent("p"))).collect()] == [
        "12.3%", "12.3%", "100.0%", "0.0%", "0.0%", None]


def test_wilson_bounds_stay_in_range(spark):
    grid = spark.range(0, 51).crossJoin(spark.range(1, 51).withColumnRenamed("id", "n"))
    usable = grid.filter("id <= n").select(
        F.col("n").cast("double").alias("n"), (F.col("id") / F.col("n")).alias("p"))
    lower, upper = intervals.wilson("n", "p")
    worst = usable.select(lower.alias("l"), upper.alias("u"), "p").agg(
        F.min("l"), F.max("u"), F.min(F.col("p") - F.col("l")), F.min(F.col("u") - F.col("p"))
    ).first()
    assert worst[0] > -1e-12 and worst[1] < 1 + 1e-12
    assert worst[2] > -1e-12 and worst[3] > -1e-12


# --- counts as input; fixed values of the textbook cases -----------------------

def test_counts_as_input(spark):
    counts = spark.createDataFrame(
        [(91, 149, 117, 236, 30, 100, 0.3, 0.4, 1600)],
        "x1 int, n1 int, x2 int, n2 int, x int, n int, p double, q double, m int")
    plain = proportions.prop_test_from_counts(
        counts, ["x1", "x2"], ["n1", "n2"], yates=False).first()
    assert (plain.p_x, plain.p_y) == (close(0.6107383), close(0.4957627))
    assert (plain.statistic, plain.p_value) == (close(4.8610864), close(0.0274690339))
    assert (plain.conf_int_lower, plain.conf_int_upper) == (close(0.0139890), close(0.2159621))
    yates = proportions.prop_test_from_counts(counts, ["x1", "x2"], ["n1", "n2"]).first()
    assert (yates.statistic, yates.p_value) == (close(4.4092032), close(0.0357455342))
    assert (yates.conf_int_lower, yates.conf_int_upper) == (close(0.0085146), close(0.2214365))
    one = proportions.prop_test_from_counts(counts, "x", "n").first()
    assert (one.statistic, one.p_value) == (close(15.21), close(9.61927e-05))
    assert (one.conf_int_lower, one.conf_int_upper) == (close(0.2145426), close(0.4010604))
    wilson = proportions.wilson_from_counts(counts, "n", "p").first()
    assert (wilson.conf_int_lower, wilson.conf_int_upper) == (close(0.2189475), close(0.3958504))
    margin = proportions.margin_of_error_from_counts(counts, "m", "q", level=0.99).first()
    assert margin.margin_of_error == close(0.0315473)
    assert (margin.conf_int_lower, margin.conf_int_upper) == (close(0.3684527), close(0.4315473))


def test_counts_without_rows_have_no_statistics(spark):
    counts = spark.createDataFrame(
        [(0, 0, 0.0), (None, None, None)], "x int, n int, p double")
    for row in proportions.prop_test_from_counts(counts, "x", "n").collect():
        assert (row.statistic, row.p_value) == (None, None)
    for row in proportions.wilson_from_counts(counts, "n", "p").collect():
        assert (row.conf_int_lower, row.conf_int_upper) == (None, None)
    with pytest.raises(ValueError, match="as many"):
        proportions.prop_test_from_counts(counts, ["x", "x"], "n")
    with pytest.raises(ValueError, match="already has"):
        proportions.wilson_from_counts(counts.withColumn("conf_int_lower", counts.p), "n", "p")


def test_t_quantiles_have_no_largest_value(spark):
    """Against closed forms, and the tail's leading term, which is all there is far out."""
    import math

    degrees = spark.createDataFrame([(x,) for x in (
        0.05, 0.1, 0.2, 1.0, 2.0, 4.0, 30.0, 9_999.0, 10_000.0, 1e9)], "df double")

    def quantile(p):
        return {r.df: r.t for r in degrees.select(
            "df", distributions.t_quantile(p, degrees.df).alias("t")).collect()}

    for p in (0.6, 0.75, 0.95, 0.975, 0.9995, 1 - 1e-6, 1 - 1e-8):
        found, a = quantile(p), 4 * p * (1 - p)
        exact = 1e-6 if p > 1 - 1e-5 else 1e-9  # 1 - p has lost its last digits
        assert found[1.0] == pytest.approx(1 / math.tan(math.pi * (1 - p)), rel=exact)
        assert found[2.0] == pytest.approx((2 * p - 1) * math.sqrt(2 / a), rel=exact)
        q = math.cos(math.acos(math.sqrt(a)) / 3) / math.sqrt(a)
        assert found[4.0] == pytest.approx(2 * math.sqrt(q - 1), rel=exact)
        assert found[1e9] == pytest.approx(distributions.normal_quantile(p), rel=1e-7)
        assert found[9_999.0] == pytest.approx(found[10_000.0], rel=1e-4)
        for few in (0.05, 0.1, 0.2):
            if p >= 0.975:
                half = few / 2
                log_beta = math.lgamma(half) + math.lgamma(0.5) - math.lgamma(half + 0.5)
                x = (2 * (1 - p) * half * math.exp(log_beta)) ** (1 / half)
                assert found[few] == pytest.approx(
                    math.sqrt(few * (1 / x - 1)), rel=1e-5 + x + exact / half)
    assert quantile(0.975)[0.1] > 1e12


def test_pooled_test_is_the_regression_of_independent_sums(spark, lineitem):
    rows = {r.method: r for r in means.compare_mean_tests(
        lineitem, "l_extendedprice", "l_returnflag", "R", "A", "weight").collect()}
    assert set(rows) == {
        "welch", "pooled", "ols", "wls", "weighted", "weighted_sum_n", "survey"}
    for column in ("diff_in_means", "std_error", "df", "t_stat", "p_value", "conf_int_lower"):
        assert rows["ols"][column] == pytest.approx(rows["pooled"][column], rel=1e-8)
    assert rows["wls"].diff_in_means == pytest.approx(rows["weighted"].diff_in_means, rel=1e-9)


def test_a_domain_named_overall(spark):
    table = spark.createDataFrame(
        [("overall", 1), ("overall", 0), ("b", 1), ("b", 1), (None, 0)], "d string, y int")
    rows = domains.domain_vs_overall(table, "d", "y").collect()
    assert sorted((r.domain_var_value, r.is_overall, r.n_unweighted) for r in rows) == [
        ("b", False, 2), ("overall", False, 2), ("overall", True, 5)]
    table = table.withColumn("w", table.y * 0 + 1.0).withColumn("arm", table.y * 0 + 1)
    shown = report.treatment_control_report(
        table, "d", treatment="arm", control="arm", first_outcome="y", second_outcome="y",
        control_outcome="y", weight="w").collect()
    assert sorted(r.is_overall for r in shown) == [False, False, True]


def test_levels_that_differ_by_row(spark):
    """The column forms agree with the forms for one level, from the centre to the far tails."""
    levels = [0.5 + 1e-6, 0.6, 0.75, 0.95, 0.975, 0.999, 1 - 1e-6, 1 - 1e-8]
    degrees = [0.5, 1.0, 2.0, 5.0, 30.0, 999.0, 1e4, 1e7]
    rows = spark.createDataFrame(
        [(p, df) for p in levels for df in degrees], "p double, df double").repartition(3)
    found = rows.select(
        "p", "df", distributions.t_quantile_by_row(F.col("p"), F.col("df")).alias("t"),
        distributions.normal_quantile_by_row(F.col("p")).alias("z"),
        distributions.normal_quantile_by_row(1 - F.col("p")).alias("lower"),
        distributions.inverse_error_function(2 * F.col("p") - 1).alias("inverse")).collect()
    single = spark.createDataFrame([(df,) for df in degrees], "df double").select(
        "df", *[distributions.t_quantile(p, F.col("df")).alias(str(i))
                for i, p in enumerate(levels)]).collect()
    wanted = {(p, r.df): r[str(i)] for r in single for i, p in enumerate(levels)}
    for r in found:
        z = distributions.normal_quantile(r.p)
        assert r.z == pytest.approx(z, rel=1e-12, abs=1e-15)
        assert r.lower == pytest.approx(distributions.normal_quantile(1 - r.p), rel=1e-12)
        assert r.inverse * 2 ** 0.5 == pytest.approx(z, rel=1e-7)
        assert r.t == pytest.approx(wanted[r.p, r.df], rel=1e-9)
    # Closed forms: Cauchy for one degree of freedom, and for two.
    for r in found:
        if r.df == 2:
            a = 4 * r.p * (1 - r.p)
            assert r.t == pytest.approx(2 * (r.p - 0.5) * (2 / a) ** 0.5, rel=1e-9)
        if r.df == 1:
            assert r.t == pytest.approx(1 / math.tan(math.pi * (1 - r.p)), rel=1e-9, abs=1e-12)


def test_levels_outside_their_range_have_no_quantile(spark):
    rows = spark.createDataFrame(
        [(p,) for p in (None, 0.0, 1.0, -1.0, 2.0, float("nan"))], "p double")
    found = rows.select(
        distributions.normal_quantile_by_row(F.col("p")).alias("z"),
        distributions.t_quantile_by_row(F.col("p"), F.lit(5.0)).alias("t"),
        distributions.inverse_error_function(F.col("p") * 2 - 1).alias("e")).collect()
    assert all(v is None for r in found for v in (r.z, r.t, r.e))


def test_level_column_of_summary_tests(spark):
    table = spark.createDataFrame(
        [(525.751, 373.269, 107.121, 67.498, 10, 10, level) for level in (0.90, 0.95, None, 1.0)],
        "m1 double, m2 double, s1 double, s2 double, n1 int, n2 int, `my level` double")
    found = means.t_test_from_summary(
        table, "m1", "m2", "s1", "s2", "n1", "n2", level="my level").collect()
    for row in found:
        if row["my level"] in (0.90, 0.95):
            one = means.t_test_from_summary(
                table.limit(1), "m1", "m2", "s1", "s2", "n1", "n2", level=row["my level"]).first()
            assert row.conf_int_lower == pytest.approx(one.conf_int_lower, rel=1e-10)
        else:
            assert row.conf_int_lower is None and row.p_value is not None
