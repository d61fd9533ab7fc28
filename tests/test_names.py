"""Every operator on columns whose names hold dots and spaces or are its own helpers' names."""

from __future__ import annotations

import inspect
import tempfile

import pytest
from pyspark.sql import functions as F

import surveyframe as sf

VALUE, GROUP, ONE, OTHER, WEIGHT, KEY = "p.value", "my col", "q0", "n", "low0", "key"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.range(200).select(
        (F.col("id") % 17 + F.col("id") / 100).alias(VALUE),
        F.when(F.col("id") % 3 == 0, "a b").otherwise("c.d").alias(GROUP),
        (F.col("id") % 2).cast("int").alias(ONE), (F.col("id") % 5 > 1).cast("int").alias(OTHER),
        (1 + F.col("id") % 4).cast("double").alias(WEIGHT), F.col("id").alias(KEY),
        F.lit(900.0).alias("slope"), F.lit(100.0).alias("q.100"))


SIDES = ("a b", "c.d")
DESIGN = sf.SurveyDesign(weight=WEIGHT, strata=GROUP, fpc="slope")
CLUSTERS = sf.SurveyDesign(weight=WEIGHT, strata=GROUP, fpc="slope", unit=KEY)



def stored_sums(d):
    path = tempfile.mkdtemp()
    sf.store_report_sums(
        d, path, [GROUP, VALUE], KEY, treatment=ONE, control=OTHER, first_outcome=OTHER,
        second_outcome=ONE, control_outcome=ONE, weight=WEIGHT)
    return d.sparkSession.read.parquet(path)


def stored_sketches(d):
    path = tempfile.mkdtemp()
    sf.store_sketches(d, path, [VALUE, ONE], [GROUP, OTHER], part=KEY)
    return d.sparkSession.read.parquet(path)


def strata_sizes(d):
    return d.groupBy(f"`{GROUP}`", ONE).agg(
        F.count("*").alias("q.100"), F.lit(2.0).alias("slope"))


CALLS = {
    "domain_vs_overall": lambda d: sf.domain_vs_overall(d, GROUP, ONE, weight=WEIGHT),
    "compare_mean_tests": lambda d: sf.compare_mean_tests(d, VALUE, GROUP, *SIDES, WEIGHT),
    "means_of_two_tables": lambda d: sf.means_of_two_tables(
        d, d.filter(F.col(KEY) > 20), [VALUE, ONE], x_weight=WEIGHT),
    "means_of_variables": lambda d: sf.means_of_variables(
        d, [VALUE, OTHER], GROUP, *SIDES, weight=WEIGHT),
    "pooled_t_test": lambda d: sf.pooled_t_test(d, VALUE, GROUP, *SIDES),
    "survey_t_test": lambda d: sf.survey_t_test(d, VALUE, GROUP, *SIDES, WEIGHT),
    "t_test": lambda d: sf.t_test(d, VALUE, GROUP, SIDES),
    "t_test_from_summary": lambda d: sf.t_test_from_summary(
        d, VALUE, WEIGHT, WEIGHT, WEIGHT, "slope", "q.100"),
    "two_sample_means": lambda d: sf.two_sample_means(d, VALUE, GROUP, *SIDES),
    "weighted_t_test": lambda d: sf.weighted_t_test(d, VALUE, GROUP, *SIDES, WEIGHT),
    "welch_t_test": lambda d: sf.welch_t_test(d, VALUE, GROUP, *SIDES),
    "five_number_summary": lambda d: sf.five_number_summary(d, [VALUE, ONE], [GROUP, OTHER]),
    "flag_outliers": lambda d: sf.flag_outliers(d, [VALUE, OTHER], [GROUP, ONE]),
    "null_outliers": lambda d: sf.null_outliers(d, VALUE, "both", [GROUP, ONE, OTHER]),
    "outlier_histogram": lambda d: sf.outlier_histogram(d, VALUE),
    "outlier_summary": lambda d: sf.outlier_summary(d, [VALUE, ONE], [GROUP, OTHER]),
    "store_sketches": lambda d: stored_sketches(d).select("part"),
    "outlier_summary_from_sketches": lambda d: sf.outlier_summary_from_sketches(
        d, stored_sketches(d).inputFiles()[0].rsplit("/", 2)[0], [VALUE, ONE], [GROUP, OTHER]),
    "quantiles_long": lambda d: sf.quantiles_long(d, VALUE, [GROUP], buffer_rows=20),
    "compare_proportion_tests": lambda d: sf.compare_proportion_tests(
        d, ONE, GROUP, *SIDES, WEIGHT),
    "grouped_proportions": lambda d: sf.grouped_proportions(d, ONE, GROUP, weight=WEIGHT),
    "margin_of_error": lambda d: sf.margin_of_error(d, ONE, GROUP),
    "margin_of_error_from_counts": lambda d: sf.margin_of_error_from_counts(d, "q.100", ONE),
    "newcombe_differences": lambda d: sf.newcombe_differences(
        d, ONE, GROUP, *SIDES, by="q.100", weight=WEIGHT),
    "newcombe_from_counts": lambda d: sf.newcombe_from_counts(
        d, "q.100", ONE, "slope", OTHER),
    "prop_test": lambda d: sf.prop_test(d, ONE, GROUP, *SIDES),
    "prop_test_from_counts": lambda d: sf.prop_test_from_counts(
        d, [ONE, OTHER], ["q.100", "slope"]),
    "prop_test_one_sample": lambda d: sf.prop_test_one_sample(d, ONE, GROUP),
    "proportion_cv": lambda d: sf.proportion_cv(d, ONE, GROUP),
    "required_sample_size": lambda d: sf.required_sample_size(d, ONE, GROUP),
    "suppression_flags_by_rules": lambda d: sf.suppression_flags_by_rules(
        d, ONE, {"one": {}, "two": {"strict": False}}, GROUP),
    "suppression_flags": lambda d: sf.suppression_flags(d, ONE, GROUP),
    "two_proportion_test": lambda d: sf.two_proportion_test(d, ONE, GROUP, *SIDES),
    "wilson_from_counts": lambda d: sf.wilson_from_counts(d, "q.100", ONE),
    "wilson_intervals": lambda d: sf.wilson_intervals(d, ONE, GROUP),
    "category_shares": lambda d: sf.category_shares(
        sf.person_category_counts(d, KEY, VALUE, GROUP)),
    "listed_counts": lambda d: sf.listed_counts(
        sf.person_category_counts(d, KEY, VALUE, GROUP, attributes=d, attributes_key=KEY,
                                  attribute_columns=["q.100"])),
    "mean_of_ratios": lambda d: sf.mean_of_ratios(d, VALUE, WEIGHT, GROUP),
    "member_flag": lambda d: sf.member_flag(d, VALUE, d, "q.100", "is.member"),
    "person_category_counts": lambda d: sf.person_category_counts(d, KEY, VALUE, GROUP),
    "linear_model": lambda d: sf.linear_model(d, VALUE, ONE, factors=[GROUP, OTHER], weight=WEIGHT),
    "factor_levels": lambda d: d.sparkSession.createDataFrame([(sf.factor_levels(d, GROUP),)]),
    "linear_regression": lambda d: sf.linear_regression(d, VALUE, ONE, weight=WEIGHT),
    "predictions": lambda d: sf.predictions(d, VALUE, ONE),
    "slope_standard_error": lambda d: sf.slope_standard_error(d, VALUE, ONE),
    "treatment_control_report": lambda d: sf.treatment_control_report(
        d, GROUP, treatment=ONE, control=OTHER, first_outcome=OTHER, second_outcome=ONE,
        control_outcome=ONE, weight=WEIGHT, expanded=True),
    "store_report_sums": lambda d: stored_sums(d).select("part"),
    "report_from_sums": lambda d: sf.report_from_sums(
        d.sparkSession, stored_sums(d).inputFiles()[0].rsplit("/", 2)[0], [GROUP, VALUE]),
    "grid_weight": lambda d: d.select(sf.grid_weight(VALUE, 1).alias("w")),
    "stratified_parts": lambda d: sf.stratified_parts(d, [GROUP, ONE], KEY, (0.5, 0.25, 0.25)),
    "value_brackets": lambda d: sf.value_brackets(d, VALUE),
    "allocate": lambda d: sf.allocate(strata_sizes(d), 20, "q.100", by=[GROUP, ONE], spread="slope"),
    "stratified_draw": lambda d: sf.stratified_draw(
        d, [GROUP, ONE], KEY, strata_sizes(d).withColumn("q.100", F.lit(3)), "q.100"),
    "stratified_split": lambda d: sf.stratified_split(d, [GROUP, ONE], KEY),
    "strata_overview": lambda d: sf.strata_overview(d, DESIGN, ONE),
    "stratified_proportion": lambda d: sf.stratified_proportion(
        d, ONE, GROUP, d.select(GROUP, F.lit(900).alias("N")).distinct(), "N"),
    "stratum_variances": lambda d: sf.stratum_variances(
        d, ONE, GROUP, d.select(GROUP, F.lit(900).alias("N")).distinct(), "N"),
    "survey_mean": lambda d: sf.survey_mean(d, VALUE, DESIGN),
    "survey_ratio": lambda d: sf.survey_ratio(d, VALUE, WEIGHT, CLUSTERS),
    "survey_t_test_by_design": lambda d: sf.survey_t_test_by_design(
        d, VALUE, GROUP, *SIDES, CLUSTERS),
    "binary_violations": lambda d: sf.binary_violations(d, [VALUE, ONE]),
    "crosstab": lambda d: sf.crosstab(d, VALUE, GROUP, list(SIDES)),
    "filter_by_mean": lambda d: sf.filter_by_mean(d, VALUE),
    "frequency_table": lambda d: sf.frequency_table(d, [GROUP, VALUE]),
    "group_moments": lambda d: sf.group_moments(d, VALUE, [GROUP, ONE]),
    "group_total": lambda d: sf.group_total(d, VALUE, GROUP, share="the.share"),
    "pivot_group_means": lambda d: sf.pivot_group_means(d, VALUE, GROUP, SIDES),
    "split_by_mean": lambda d: sf.split_by_mean(d, VALUE),
    "stack_tables": lambda d: sf.stack_tables({"one": d, "two": d}),
    "weighted_mean": lambda d: sf.weighted_mean(d, VALUE, WEIGHT, GROUP),
}

def test_every_exported_operator_is_called():
    exported = {n for n in sf.__all__ if inspect.isfunction(getattr(sf, n))}
    assert exported - {"read_table"} == set(CALLS)


@pytest.mark.parametrize("name", sorted(CALLS))
def test_odd_names(odd, name):
    assert CALLS[name](odd).collect()


def test_a_group_named_like_a_result_is_refused(odd):
    for operator in (sf.five_number_summary, sf.outlier_summary):
        with pytest.raises(ValueError, match="rename grouping"):
            operator(odd, VALUE, ONE)
