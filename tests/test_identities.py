"""Different methods that must agree, and properties that must hold."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from surveyframe.operators import (
    domains, means, outliers, proportions, regression, report, survey, tables,
)

WELCH = ("diff_in_means", "std_error", "df", "t_stat", "p_value", "conf_int_lower",
         "conf_int_upper")
PRICE = ("l_extendedprice", "l_returnflag", "R", "A")


def values(row, columns):
    return [row[c] for c in columns]


def test_unit_weights_give_the_welch_test(lineitem):
    plain = means.welch_t_test(lineitem, *PRICE).first()
    unit = lineitem.withColumn("one", F.lit(1.0))
    for mean_one in (True, False):
        weighted = means.weighted_t_test(unit, *PRICE, "one", mean_one=mean_one).first()
        assert values(weighted, WELCH) == pytest.approx(values(plain, WELCH), rel=1e-9)


def test_pooled_test_is_the_regression_on_a_dummy(lineitem):
    pooled = means.pooled_t_test(lineitem, *PRICE).first()
    dummy = lineitem.filter(F.col("l_returnflag").isin("R", "A")).withColumn(
        "r", (F.col("l_returnflag") == "R").cast("int"))
    slope = regression.linear_regression(dummy, "l_extendedprice", "r").filter(
        "term = 'r'").first()
    assert slope.estimate == pytest.approx(pooled.diff_in_means, rel=1e-9)
    assert slope.std_error == pytest.approx(pooled.std_error, rel=1e-9)
    assert slope.p_value == pytest.approx(pooled.p_value, rel=1e-9)
    direct = regression.slope_standard_error(dummy, "l_extendedprice", "r").first()
    assert direct.std_error == pytest.approx(slope.std_error, rel=1e-9)


def test_weighted_regression_with_unit_weights_is_the_plain_one(orders):
    unit = orders.withColumn("one", F.lit(1.0))
    plain = regression.linear_regression(unit, "o_totalprice", "treated").collect()
    weighted = regression.linear_regression(unit, "o_totalprice", "treated", weight="one").collect()
    for p, w in zip(plain, weighted):
        assert tuple(w)[1:] == pytest.approx(tuple(p)[1:], rel=1e-9)


def test_regression_agrees_with_mllib(orders):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    table = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        orders.select(F.col("treated").cast("double").alias("x"), "o_totalprice", "weight"))
    fitted = LinearRegression(
        labelCol="o_totalprice", weightCol="weight", solver="normal").fit(table)
    rows = {r.term: r for r in regression.linear_regression(
        orders, "o_totalprice", "treated", weight="weight").collect()}
    assert rows["treated"].estimate == pytest.approx(fitted.coefficients[0], rel=1e-6)
    assert rows["(Intercept)"].estimate == pytest.approx(fitted.intercept, rel=1e-6)
    errors = fitted.summary.coefficientStandardErrors
    assert rows["treated"].std_error == pytest.approx(errors[0], rel=1e-6)
    assert rows["(Intercept)"].std_error == pytest.approx(errors[1], rel=1e-6)


def test_uncorrected_prop_test_is_the_square_of_the_pooled_test(orders):
    split = tables.split_by_mean(orders, "o_totalprice", "dear")
    t = proportions.two_proportion_test(split, "treated", "dear", 1, 0).first()
    chi = proportions.prop_test(split, "treated", "dear", 1, 0, yates=False).first()
    assert chi.statistic == pytest.approx(t.t_stat ** 2, rel=1e-9)


def test_summary_test_repeats_the_test_on_rows(lineitem):

    price, flag = F.col("l_extendedprice"), F.col("l_returnflag")
    summary = lineitem.agg(*[
        f(F.when(flag == level, price)).alias(name + side)
        for side, level in (("1", "R"), ("2", "A"))
        for name, f in (("m", F.avg), ("s", F.stddev_samp), ("n", F.count))])
    from_summary = means.t_test_from_summary(
        summary, "m1", "m2", "s1", "s2", "n1", "n2").first()
    direct = means.welch_t_test(lineitem, *PRICE).first()
    assert values(from_summary, WELCH) == pytest.approx(values(direct, WELCH), rel=1e-9)


def test_methods_side_by_side_agree_with_the_single_tests(lineitem):
    rows = {r.method: r for r in means.compare_mean_tests(lineitem, *PRICE, "weight").collect()}
    assert set(rows) == {
        "welch", "pooled", "ols", "wls", "weighted", "weighted_sum_n", "survey"}
    single = {
        "welch": means.welch_t_test(lineitem, *PRICE),
        "pooled": means.pooled_t_test(lineitem, *PRICE),
        "ols": means.pooled_t_test(lineitem, *PRICE),
        "weighted": means.weighted_t_test(lineitem, *PRICE, "weight"),
        "weighted_sum_n": means.weighted_t_test(lineitem, *PRICE, "weight", mean_one=False),
    }
    for name, test in single.items():
        assert values(rows[name], WELCH) == pytest.approx(values(test.first(), WELCH), rel=1e-9)
    design = means.survey_t_test(lineitem, *PRICE, "weight").first()
    assert rows["survey"].std_error == pytest.approx(design.std_error, rel=1e-9)
    # R comes after A, so the design-based test has the same direction.
    assert rows["survey"].diff_in_means == pytest.approx(design.diff_in_means, rel=1e-9)


def test_scaling_all_weights_changes_nothing(lineitem):
    scaled = lineitem.withColumn("scaled", F.col("weight") * 1000)
    one = means.weighted_t_test(lineitem, *PRICE, "weight").first()
    other = means.weighted_t_test(scaled, *PRICE, "scaled").first()
    assert tuple(other) == pytest.approx(tuple(one), rel=1e-9)


def test_weighted_spread_survives_a_large_mean(spark):
    """The one-pass formula would have lost every digit here."""
    rows = [(g, 1e9 + d, 1.0 + (i % 3)) for g, shift in (("x", 0), ("y", 5))
            for i, d in enumerate([shift + k for k in (0.0, 1.0, 2.0, 3.0, 4.0, 5.0)])]
    table = spark.createDataFrame(rows, "g string, v double, w double")
    high = means.weighted_t_test(table, "v", "g", "x", "y", "w").first()
    low = means.weighted_t_test(
        table.withColumn("v", F.col("v") - 1e9), "v", "g", "x", "y", "w").first()
    assert high.std_error == pytest.approx(low.std_error, rel=1e-9)


def test_many_variables_equal_one_at_a_time(lineitem):
    variables = ["l_quantity", "known_price", "l_tax"]
    many = means.means_of_variables(
        lineitem, variables, "l_returnflag", "R", "A", weight="weight").collect()
    assert [r.variable for r in sorted(many, key=lambda r: r.variable_index)] == variables
    for row in many:
        alone = means.two_sample_means(
            lineitem, row.variable, "l_returnflag", "R", "A", weight="weight").first()
        assert tuple(row)[2:9] == pytest.approx(tuple(alone)[:7], rel=1e-12)
        assert row.p_value == pytest.approx(alone.p_value, rel=1e-9)


def test_two_tables_equal_one_table_with_a_group(lineitem):
    split = {f: lineitem.filter(F.col("l_returnflag") == f) for f in ("R", "A")}
    two = means.means_of_two_tables(
        split["R"], split["A"], ["l_quantity"], x_weight="weight", y_weight="weight").first()
    one = means.means_of_variables(
        lineitem, ["l_quantity"], "l_returnflag", "R", "A", weight="weight").first()
    assert two.t_stat == pytest.approx(one.t_stat, rel=1e-12)


def test_domain_difference_is_that_from_the_overall_proportion(orders):
    found = domains.domain_vs_overall(
        orders, "o_orderpriority", "medium", weight="weight").collect()
    overall = next(r for r in found if r.domain_var_value == "overall")
    for row in found:
        if row is not overall:
            assert row.diff_btw_domain_and_overall_p == pytest.approx(
                row.p_weighted - overall.p_weighted, abs=1e-12)
    assert sum(r.n_unweighted for r in found if r is not overall) == overall.n_unweighted


def test_report_repeats_the_domain_tests_of_each_arm(orders):
    table = report.treatment_control_report(
        orders, "o_orderpriority", treatment="treated", control="control",
        first_outcome="large", second_outcome="medium", control_outcome="medium",
        weight="weight", expanded=True)
    rows = {r.treatment_fraud_domain_var_value: r for r in table.collect()}
    for side, arm, outcome in (("treatment_fraud", "treated", "large"),
                               ("treatment_denied", "treated", "medium"),
                               ("control_denied", "control", "medium")):
        alone = domains.domain_vs_overall(
            orders.filter(F.col(arm) == 1), "o_orderpriority", outcome, weight="weight",
            strict=False, confidential=False)
        for row in alone.collect():
            for column in domains.STATISTICS:
                expected = row[column]
                if isinstance(expected, float):
                    expected = pytest.approx(expected, rel=1e-9, abs=1e-12)
                assert rows[row.domain_var_value][f"{side}_{column}"] == expected, (side, column)


def test_survey_mean_with_one_stratum_and_equal_weights_is_the_plain_error(orders):
    plain = orders.agg(
        F.avg("o_totalprice").alias("m"),
        (F.stddev_samp("o_totalprice") / F.sqrt(F.count("*"))).alias("se")).first()
    design = survey.survey_mean(orders, "o_totalprice", survey.SurveyDesign()).first()
    assert (design.mean, design.std_error) == (
        pytest.approx(plain.m, rel=1e-12), pytest.approx(plain.se, rel=1e-9))


@pytest.mark.parametrize("which", ["both", "upper", "lower"])
def test_nulling_outliers_keeps_rows_columns_and_the_inside(spark, data, which):
    events = spark.read.parquet(f"{data}/events.parquet").drop("ts")
    cleaned = outliers.null_outliers(events, "value", which, "event_type")
    assert cleaned.columns == events.columns
    assert cleaned.count() == events.count()
    summary = outliers.outlier_summary(events, "value", "event_type").agg(
        F.sum("lower_outlier_count").alias("lower"),
        F.sum("upper_outlier_count").alias("upper")).first()
    gone = {"both": summary.lower + summary.upper, "upper": summary.upper,
            "lower": summary.lower}[which]
    assert cleaned.filter("value IS NULL").count() == gone
    flagged = outliers.flag_outliers(events, "value", "event_type").agg(
        F.sum("value_lower_outlier_flag").alias("lower"),
        F.sum("value_upper_outlier_flag").alias("upper")).first()
    assert tuple(flagged) == tuple(summary)


def test_histogram_counts_every_value(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    bins = outliers.outlier_histogram(events, "value").groupBy("version").agg(
        F.sum("n").alias("n"), F.max("bin").alias("last")).collect()
    found = {r.version: r for r in bins}
    assert found["before"].n == events.count()
    assert found["after"].n == events.count() - outliers.outlier_summary(
        events, "value").first().upper_outlier_count
    assert max(r.last for r in bins) <= 29


@pytest.mark.parametrize("name", [
    "weighted_t_test", "domain_vs_overall_weighted", "outlier_summary_grouped",
    "stratified_split", "treatment_control_report_expanded", "survey_mean_stratified"])
def test_partitioning_does_not_change_results(spark, data, name, monkeypatch):
    import compare
    from workload import queries

    read = queries.read_table
    found = []
    for parts in (1, 8):
        monkeypatch.setattr(
            queries, "read_table", lambda s, f, t, n=parts: read(s, f, t).repartition(n))
        found.append(compare.spark_rows(queries.all_queries()[name](spark, data)))
    assert found[0] == found[1]


def test_flags_by_rules_are_those_of_each_call(orders):
    rules = {"strict": {}, "loose": {"strict": False, "confidential": False},
             "all": {"confidential": False, "kind": "population"}}
    many = proportions.suppression_flags_by_rules(orders, "medium", rules, "priority", weight="weight")
    for name, options in rules.items():
        one = proportions.suppression_flags(orders, "medium", "priority", weight="weight", **options)
        wanted = {r.priority: (r.suppressed_flag, r.unreliable_flag) for r in one.collect()}
        assert wanted == {
            r.priority: (r[f"{name}_suppressed"], r[f"{name}_unreliable"]) for r in many.collect()}
