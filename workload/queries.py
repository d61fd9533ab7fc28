"""Every registered query: an operator applied to whole tables of the test data.

Doubles are rounded here, because the order of summation differs from engine to
engine.  The tables hold no missing values, so some queries blank out values or
group keys first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from surveyframe.functions import columns as C
from surveyframe.operators import (
    domains, means, outliers, proportions, ratios, regression, report, sampling, survey, tables,
)
from surveyframe.plans import store
from surveyframe.sources import read_table

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles to ``digits`` decimals (``other`` names exceptions), without negative zero."""
    return df.select([
        (F.round(f.name, other.get(f.name, digits)) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


# --- inputs ------------------------------------------------------------------

def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Prices with a weight, and a price that is missing for goods shipped in 1998."""
    table = read_table(spark, sf, "lineitem")
    return table.withColumns({
        "weight": 1 + F.col("l_linenumber") / F.lit(10.0),
        "known_price": F.when(F.year("l_shipdate") != 1998, F.col("l_extendedprice")),
    })


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as survey cases: arms, 0/1 outcomes (``large`` missing in 1996) and a weight."""
    price = F.col("o_totalprice")
    return read_table(spark, sf, "orders").withColumns({
        "treated": C.dummy(F.col("o_orderstatus") == "F"),
        "control": C.dummy(F.col("o_orderstatus") == "O"),
        "large": F.when(F.year("o_orderdate") != 1996, C.dummy(price > 450000)),
        "medium": C.dummy(price > 300000),
        "weight": 1 + (F.col("o_orderkey") % 5) / F.lit(4.0),
        "priority": F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")),
    })


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with a type that is missing for errors and a value missing from 3 to 4 o'clock."""
    return read_table(spark, sf, "events").withColumns({
        "kind": F.nullif(F.col("event_type"), F.lit("error")),
        "known_value": F.when(F.hour("ts") != 3, F.col("value")),
        "negative_value": -F.col("value"),
    })


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts by brand, with a rare 0/1 outcome: small domains."""
    return read_table(spark, sf, "part").withColumn("oversized", C.dummy(F.col("p_size") > 45))


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "customer").withColumn(
        "in_debt", C.dummy(F.col("c_acctbal") < 0))


def languages(spark: SparkSession, sf: str) -> DataFrame:
    """All documents per language: the population the labelled ones are drawn from."""
    return read_table(spark, sf, "documents").groupBy("lang").agg(
        F.count("*").alias("population"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled documents as a sample stratified by language."""
    documents = read_table(spark, sf, "documents").select("doc_id", "lang")
    sample = read_table(spark, sf, "labels").join(documents, "doc_id")
    drawn = sample.groupBy("lang").agg(F.count("*").alias("drawn"))
    sizes = languages(spark, sf).join(drawn, "lang").select(
        "lang", "population", (F.col("population") / F.col("drawn")).alias("weight"))
    return sample.join(sizes, "lang")


DESIGN = survey.SurveyDesign(weight="weight", strata="lang", fpc="population")


# --- columns, filters, joins -------------------------------------------------

def dummy_from_predicate(spark, sf):
    made = orders(spark, sf).withColumn("rush", C.dummy(F.col("priority") == "1-URGENT"))
    return made.groupBy("priority", "rush").agg(F.count("*").alias("n"))


def filter_not_in_keep_null(spark, sf):
    left = events(spark, sf).filter(C.not_in("kind", ["click", "view"]))
    return left.groupBy("kind").agg(F.count("*").alias("n"))


def filter_vs_global_mean(spark, sf):
    split = tables.split_by_mean(orders(spark, sf), "o_totalprice")
    side = F.when(F.col("high") == 1, "at_least").otherwise("below").alias("side")
    return rounded(split.groupBy(side).agg(
        F.count("*").alias("n"), F.min("o_totalprice").alias("lowest"),
        F.max("o_totalprice").alias("highest")))


def binary_contract_violations(spark, sf):
    checked = read_table(spark, sf, "labels").join(
        read_table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return tables.binary_violations(checked, ["quality", "toxic", "n_chars"])


def membership_flag(spark, sf):
    debtors = customers(spark, sf).filter("in_debt = 1")
    flagged = ratios.member_flag(events(spark, sf), "user_id", debtors, "c_custkey", "in_debt")
    return flagged.select("event_id", "user_id", "in_debt")


def percent_label(spark, sf):
    found = proportions.grouped_proportions(orders(spark, sf), "medium", "o_orderpriority")
    return found.select(
        "o_orderpriority", F.expr(C.percent("p_weighted")).alias("label"),
        F.expr(C.percent("p_weighted - 0.5D", 0)).alias("off_half"))


def union_samples(spark, sf):
    o = orders(spark, sf)
    stacked = tables.stack_tables({
        "treatment": o.filter("treated = 1").select("o_orderkey", "o_totalprice", "large"),
        "control": o.filter("control = 1").select("o_orderkey", "o_totalprice"),
    })
    return rounded(stacked.groupBy("origin").agg(
        F.count("*").alias("n"), F.count("large").alias("n_large"),
        F.avg("o_totalprice").alias("mean_price")))


# --- summaries ---------------------------------------------------------------

def group_moments(spark, sf):
    found = tables.group_moments(
        lineitem(spark, sf), ["known_price", "l_quantity"], ["l_returnflag", "l_linestatus"])
    return rounded(found, known_price_sum=2, l_quantity_sum=2)


def prefixed_columns(spark, sf):
    found = tables.group_moments(lineitem(spark, sf), "l_quantity", "l_returnflag")
    return rounded(C.prefixed(found, "lines_", keep=["l_returnflag"]), lines_l_quantity_sum=2)


def weighted_mean_by_group(spark, sf):
    return rounded(tables.weighted_mean(
        lineitem(spark, sf), "known_price", "weight", "l_returnflag"), weight_sum=2)


def frequency_table(spark, sf):
    return rounded(tables.frequency_table(events(spark, sf), "kind"))


def crosstab(spark, sf):
    return tables.crosstab(lineitem(spark, sf), "l_returnflag", "l_linestatus", ["F", "O"])


def pivot_group_means(spark, sf):
    return rounded(tables.pivot_group_means(
        lineitem(spark, sf), "l_extendedprice", "l_returnflag", ["R", "A"]))


def group_total_window(spark, sf):
    placed = tables.group_total(events(spark, sf), "value", "user_id", count="group_rows")
    return rounded(placed.select("event_id", "user_id", "value", "group_total", "group_rows"))


def share_of_group_total(spark, sf):
    placed = tables.group_total(events(spark, sf), "known_value", "kind", share="share")
    return rounded(placed.select("event_id", "kind", "known_value", "share"), 9)


def mean_of_ratios_vs_ratio_of_means(spark, sf):
    return rounded(ratios.mean_of_ratios(
        lineitem(spark, sf), "l_discount", "l_tax", "l_returnflag"))


def _event_counts(spark, sf):
    people = customers(spark, sf)
    return ratios.person_category_counts(
        events(spark, sf).withColumn("day", F.to_date("ts")), "user_id", "day", "kind",
        relabelled=people.filter("in_debt = 1"), relabelled_key="c_custkey",
        new_label="unable to extract", excluded_labels=["signup", "undefined"],
        attributes=people, attributes_key="c_custkey",
        attributes_filter=F.col("c_mktsegment") != "BUILDING",
        attribute_columns=["c_nationkey", "c_mktsegment"])


def charge_counts(spark, sf):
    return ratios.listed_counts(_event_counts(spark, sf))


def charge_counts_first_rows(spark, sf):
    return ratios.listed_counts(_event_counts(spark, sf), first_rows=10)


def charge_shares(spark, sf):
    return rounded(ratios.category_shares(_event_counts(spark, sf)))


def charge_shares_many_attributes(spark, sf):
    """The same with orders as attributes: each person has several sets of them."""
    cases = orders(spark, sf).select("o_custkey", "o_orderstatus", "priority")
    counts = ratios.person_category_counts(
        events(spark, sf).withColumn("day", F.to_date("ts")), "user_id", "day", "kind",
        attributes=cases, attributes_key="o_custkey",
        attribute_columns=["o_orderstatus", "priority"])
    return rounded(ratios.category_shares(counts))


# --- quantiles and outliers --------------------------------------------------

def five_number_summary(spark, sf):
    return rounded(outliers.five_number_summary(
        events(spark, sf), ["known_value", "user_id"], "kind"))


def quantiles_long(spark, sf):
    return rounded(outliers.quantiles_long(lineitem(spark, sf), "l_extendedprice"))


def outlier_summary(spark, sf):
    return rounded(outliers.outlier_summary(events(spark, sf), "known_value"))


def outlier_summary_grouped(spark, sf):
    return rounded(outliers.outlier_summary(events(spark, sf), "known_value", "kind"))


def outlier_summary_many_vars(spark, sf):
    table = lineitem(spark, sf).withColumn("constant", F.lit(42.0))
    return rounded(outliers.outlier_summary(
        table, ["l_extendedprice", "l_quantity", "constant"], "l_linestatus"))


def outlier_summary_from_sketches(spark, sf):
    """The outliers of all lines, with sketches kept by ship year of which one was corrected."""
    table = lineitem(spark, sf).withColumns({
        "constant": F.lit(42.0), "year": F.year("l_shipdate")})
    path = f"{store.folder(spark)}/sketches-{uuid.uuid4().hex}"
    variables = ["l_extendedprice", "l_quantity", "constant"]
    first_seen = table.filter("year <> 1994 OR l_orderkey % 3 <> 0")
    for arrived in (first_seen, table.filter("year = 1994")):
        outliers.store_sketches(arrived, path, variables, "l_linestatus", part="year")
    return rounded(outliers.outlier_summary_from_sketches(
        table, path, variables, "l_linestatus"))


def _without_outliers(spark, sf, variable, which, by=None):
    cleaned = outliers.null_outliers(events(spark, sf), variable, which, by)
    return rounded(cleaned.select("event_id", "kind", variable))


def null_outliers_both(spark, sf):
    return _without_outliers(spark, sf, "known_value", "both")


def null_outliers_upper(spark, sf):
    return _without_outliers(spark, sf, "value", "upper")


def null_outliers_lower(spark, sf):
    return _without_outliers(spark, sf, "negative_value", "lower")


def null_outliers_grouped(spark, sf):
    return _without_outliers(spark, sf, "known_value", "both", "kind")


def flag_outliers(spark, sf):
    flagged = outliers.flag_outliers(events(spark, sf), ["known_value", "negative_value"], "kind")
    return flagged.select("event_id", *flagged.columns[-4:])


FEW_ROWS = 200  # so that the groups of the smallest tables are bracketed


def quantiles_long_brackets(spark, sf):
    return rounded(outliers.quantiles_long(
        lineitem(spark, sf), "l_extendedprice", buffer_rows=FEW_ROWS))


def outlier_summary_grouped_brackets(spark, sf):
    return rounded(outliers.outlier_summary(
        events(spark, sf), "known_value", "kind", buffer_rows=FEW_ROWS))


def null_outliers_brackets(spark, sf):
    cleaned = outliers.null_outliers(
        events(spark, sf), "known_value", "both", "kind", buffer_rows=FEW_ROWS)
    return rounded(cleaned.select("event_id", "kind", "known_value"))


def histogram_before_after(spark, sf):
    return rounded(outliers.outlier_histogram(events(spark, sf), "known_value"))


# --- tests of means ----------------------------------------------------------

def welch_t_test(spark, sf):
    return rounded(means.welch_t_test(
        lineitem(spark, sf), "l_extendedprice", "l_returnflag", "R", "A"))


def pooled_t_test(spark, sf):
    return rounded(means.pooled_t_test(
        lineitem(spark, sf), "l_extendedprice", "l_returnflag", "R", "A"))


def _line_summaries(spark, sf):
    """Mean, deviation and count of returned and accepted lines, per line number."""
    price, flag = F.col("l_extendedprice"), F.col("l_returnflag")
    sides = [("1", flag == "R"), ("2", flag == "A")]
    return lineitem(spark, sf).groupBy("l_linenumber").agg(*[
        measure(F.when(here, price)).alias(name + side)
        for side, here in sides
        for name, measure in (("m", F.avg), ("s", F.stddev_samp), ("n", F.count))
    ])


def t_test_from_summary(spark, sf):
    return rounded(means.t_test_from_summary(
        _line_summaries(spark, sf), "m1", "m2", "s1", "s2", "n1", "n2", null_difference=100.0))


def t_test_from_summary_pooled(spark, sf):
    return rounded(means.t_test_from_summary(
        _line_summaries(spark, sf), "m1", "m2", "s1", "s2", "n1", "n2", equal_variance=True))


def t_ci_conservative_df(spark, sf):
    return rounded(means.t_test_from_summary(
        _line_summaries(spark, sf), "m1", "m2", "s1", "s2", "n1", "n2",
        df_rule="conservative", level=0.90))


def t_ci_level_per_row(spark, sf):
    """Intervals from 50 to 99.999999 %, a level for each line number."""
    levels = F.array(*[F.lit(p) for p in (0.5, 0.8, 0.9, 0.95, 0.99, 0.9999, 0.99999999)])
    table = _line_summaries(spark, sf).withColumn(
        "level", F.get(levels, F.col("l_linenumber").cast("int") - 1))
    return rounded(means.t_test_from_summary(
        table, "m1", "m2", "s1", "s2", "n1", "n2", level="level"), 5, level=9)


def t_test_ordered_groups(spark, sf):
    return rounded(means.t_test(
        lineitem(spark, sf), "known_price", "l_returnflag", ("A", "R")))


def weighted_t_test(spark, sf):
    return rounded(means.weighted_t_test(
        lineitem(spark, sf), "known_price", "l_returnflag", "R", "A", "weight"))


def weighted_t_test_sum_n(spark, sf):
    return rounded(means.weighted_t_test(
        lineitem(spark, sf), "known_price", "l_returnflag", "R", "A", "weight", mean_one=False))


def survey_t_test(spark, sf):
    return rounded(means.survey_t_test(
        lineitem(spark, sf), "known_price", "l_returnflag", "R", "A", "weight"))


def two_sample_means(spark, sf):
    return rounded(means.two_sample_means(
        lineitem(spark, sf), "known_price", "l_returnflag", "R", "A", weight="weight"))


def two_sample_means_equal_variance(spark, sf):
    table = lineitem(spark, sf).withColumn("flat", F.lit(2.5))
    return rounded(means.two_sample_means(
        table, "known_price", "l_returnflag", "R", "A", weight="flat", equal_variance=True))


MANY = ["l_quantity", "known_price", "l_discount", "l_tax"]


def means_of_many_vars(spark, sf):
    return rounded(means.means_of_variables(
        lineitem(spark, sf), MANY, "l_linestatus", "F", "O"))


def means_of_many_vars_weighted(spark, sf):
    return rounded(means.means_of_variables(
        lineitem(spark, sf), MANY, "l_linestatus", "F", "O", weight="weight"))


def means_of_two_tables(spark, sf):
    o = orders(spark, sf)
    return rounded(means.means_of_two_tables(
        o.filter("treated = 1"), o.filter("control = 1"), ["o_totalprice", "large"],
        x_weight="weight"))


def mean_test_method_comparison(spark, sf):
    return rounded(means.compare_mean_tests(
        lineitem(spark, sf), "l_extendedprice", "l_returnflag", "R", "A", "weight"))


# --- regression --------------------------------------------------------------

def _returned_or_accepted(spark, sf):
    table = lineitem(spark, sf).filter(F.col("l_returnflag").isin("R", "A"))
    return table.withColumn("returned", C.dummy(F.col("l_returnflag") == "R"))


def ols_dummy(spark, sf):
    return rounded(regression.linear_regression(
        _returned_or_accepted(spark, sf), "known_price", "returned"))


def wls_dummy(spark, sf):
    return rounded(regression.linear_regression(
        _returned_or_accepted(spark, sf), "known_price", "returned", weight="weight"))


def ols_factor(spark, sf):
    return rounded(regression.linear_model(
        lineitem(spark, sf), "known_price", factors="l_linenumber"))


def wls_factor(spark, sf):
    return rounded(regression.linear_model(
        lineitem(spark, sf), "known_price",
        factors={"l_returnflag": ["R", "A", "N"]}, weight="weight"))


def ols_factors_and_number(spark, sf):
    """A number and two factors, of which the second is settled by the first."""
    table = lineitem(spark, sf).withColumn("open", F.col("l_returnflag") == "N")
    return rounded(regression.linear_model(
        table, "known_price", "l_quantity", factors=["l_returnflag", "open"]))


def _finished_by_price(spark, sf):
    return tables.split_by_mean(orders(spark, sf), "o_totalprice", "dear", inclusive=False)


def ols_predictions(spark, sf):
    fitted = regression.predictions(_finished_by_price(spark, sf), "treated", "dear")
    return rounded(
        fitted.withColumn("predicted", F.round("predicted", 9))
        .groupBy("predicted", "dear").agg(
            F.count("*").alias("n"),
            F.sum(F.col("residual") * F.col("residual")).alias("squared_residuals")))


def ols_slope_se_from_residuals(spark, sf):
    return rounded(regression.slope_standard_error(
        _finished_by_price(spark, sf), "treated", "dear"), 9)


# --- proportions -------------------------------------------------------------

def _by_price(spark, sf):
    return tables.split_by_mean(orders(spark, sf), "o_totalprice", "dear")


def two_proportion_pooled(spark, sf):
    return rounded(proportions.two_proportion_test(_by_price(spark, sf), "treated", "dear", 1, 0))


def two_proportion_pooled_weighted(spark, sf):
    return rounded(proportions.two_proportion_test(
        _by_price(spark, sf), "treated", "dear", 1, 0, weight="weight"))


def prop_test(spark, sf):
    return rounded(proportions.prop_test(
        _by_price(spark, sf), "treated", "dear", 1, 0, yates=False))


def prop_test_yates(spark, sf):
    return rounded(proportions.prop_test(_by_price(spark, sf), "treated", "dear", 1, 0))


def prop_test_weighted_totals(spark, sf):
    return rounded(proportions.prop_test(
        _by_price(spark, sf), "treated", "dear", 1, 0, weight="weight", yates=False))


def prop_test_one_sample(spark, sf):
    split = _by_price(spark, sf)
    return rounded(proportions.prop_test_one_sample(split, "dear", "o_orderpriority"))


def proportion_margin_of_error(spark, sf):
    return rounded(proportions.margin_of_error(
        customers(spark, sf), "in_debt", "c_mktsegment", level=0.99))


def required_sample_size(spark, sf):
    return rounded(proportions.required_sample_size(orders(spark, sf), "large", "priority"))


def wilson_interval(spark, sf):
    return rounded(proportions.wilson_intervals(
        orders(spark, sf), "large", "priority", weight="weight"))


def newcombe_difference(spark, sf):
    return rounded(proportions.newcombe_differences(
        orders(spark, sf), "large", "o_orderstatus", "F", "O", by="priority", weight="weight"))


def proportion_cv(spark, sf):
    return rounded(proportions.proportion_cv(parts(spark, sf), "oversized", "p_brand", z=1.645))


RULES = [
    ("strict_confidential", dict(strict=True, confidential=True, kind="sample")),
    ("strict_open_sample", dict(strict=True, confidential=False, kind="sample")),
    ("strict_open_population", dict(strict=True, confidential=False, kind="population")),
    ("loose_confidential", dict(strict=False, confidential=True, kind="sample")),
    ("loose_open", dict(strict=False, confidential=False, kind="sample")),
]


def suppression_flags(spark, sf):
    """Every set of rules on the same proportions."""
    flags = [f"{name}_{flag}" for name, _ in RULES for flag in ("suppressed", "unreliable")]
    found = proportions.suppression_flags_by_rules(
        parts(spark, sf), "oversized", dict(RULES), "p_brand")
    return rounded(found.select(
        "p_brand", "n_unweighted", "x_unweighted", "coeff_of_variation", *flags))


def _priority_counts(spark, sf):
    """Rows, dear orders and their share, per priority, of finished and of open orders."""
    split = _by_price(spark, sf)
    return split.groupBy("o_orderpriority").agg(
        *[F.count_if(F.col(arm) == 1).alias(f"n_{arm}") for arm in ("treated", "control")],
        *[F.count_if((F.col(arm) == 1) & (F.col("dear") == 1)).alias(f"x_{arm}")
          for arm in ("treated", "control")]).withColumns({
        f"p_{arm}": F.col(f"x_{arm}") / F.col(f"n_{arm}") for arm in ("treated", "control")})


def wilson_interval_from_counts(spark, sf):
    return rounded(proportions.wilson_from_counts(
        _priority_counts(spark, sf), "n_treated", "p_treated").select(
        "o_orderpriority", "n_treated", "p_treated", "conf_int_lower", "conf_int_upper"))


def newcombe_difference_from_counts(spark, sf):
    return rounded(proportions.newcombe_from_counts(
        _priority_counts(spark, sf), "n_treated", "p_treated", "n_control", "p_control").select(
        "o_orderpriority", "p_diff", "conf_int_lower", "conf_int_upper"))


def prop_test_two_counts(spark, sf):
    return rounded(proportions.prop_test_from_counts(
        _priority_counts(spark, sf).select(
            "o_orderpriority", "x_treated", "n_treated", "x_control", "n_control"),
        ["x_treated", "x_control"], ["n_treated", "n_control"]))


def prop_test_one_count(spark, sf):
    return rounded(proportions.prop_test_from_counts(
        _priority_counts(spark, sf).select("o_orderpriority", "x_treated", "n_treated"),
        "x_treated", "n_treated", yates=False))


def margin_of_error_counts(spark, sf):
    return rounded(proportions.margin_of_error_from_counts(
        _priority_counts(spark, sf).select("o_orderpriority", "n_treated", "p_treated"),
        "n_treated", "p_treated", level=0.99))


def proportion_test_method_comparison(spark, sf):
    return rounded(proportions.compare_proportion_tests(
        _by_price(spark, sf), "treated", "dear", 1, 0, "weight"))


# --- domains and report ------------------------------------------------------

def domain_vs_overall(spark, sf):
    return rounded(domains.domain_vs_overall(orders(spark, sf), "priority", "large"))


def domain_vs_overall_weighted(spark, sf):
    return rounded(domains.domain_vs_overall(
        orders(spark, sf), "priority", "large", weight="weight", z=1.645,
        strict=False, confidential=False, kind="population"))


def domain_vs_overall_small_domains(spark, sf):
    return rounded(domains.domain_vs_overall(
        parts(spark, sf), "p_brand", "oversized", strict=False))


def domain_vs_overall_many_domains(spark, sf):
    table = orders(spark, sf).withColumn("year", F.year("o_orderdate"))
    return rounded(domains.domain_vs_overall(
        table, ["priority", "year", "o_orderstatus"], "large", weight="weight"))


REPORT = {
    "treatment": "treated", "control": "control", "first_outcome": "large",
    "second_outcome": "medium", "control_outcome": "medium", "weight": "weight"}


def _report(spark, sf, domain, **options):
    return report.treatment_control_report(orders(spark, sf), domain, **REPORT, **options)


def treatment_control_report_many_domains(spark, sf):
    table = orders(spark, sf).withColumn("quarter", F.quarter("o_orderdate"))
    return rounded(report.treatment_control_report(
        table, ["priority", "quarter"], **REPORT, expanded=True))


def treatment_control_report_refreshed(spark, sf):
    """The report from stored sums by year, after more years arrived and one was corrected."""
    table = orders(spark, sf).withColumn("year", F.year("o_orderdate"))
    path = f"{store.folder(spark)}/report-sums-{uuid.uuid4().hex}"
    first_seen = table.filter("year < 1996 AND (year <> 1994 OR o_orderkey % 3 <> 0)")
    for arrived in (first_seen, table.filter("year >= 1996"), table.filter("year = 1994")):
        report.store_report_sums(arrived, path, "priority", "year", **REPORT)
    return report.report_from_sums(spark, path, "priority")


def treatment_control_report(spark, sf):
    return _report(spark, sf, "priority")


def treatment_control_report_expanded(spark, sf):
    return rounded(_report(spark, sf, "priority", expanded=True))


def treatment_control_report_small_domains(spark, sf):
    """Domains of a few cases each, one per customer nation, with suppressed cells."""
    nations = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    table = orders(spark, sf).join(nations, "o_custkey")
    return report.treatment_control_report(
        table, "c_nationkey", treatment="treated", control="control",
        first_outcome="large", second_outcome="medium", control_outcome="medium",
        weight="weight")


# --- survey design -----------------------------------------------------------

def stratified_proportion_moe(spark, sf):
    return rounded(survey.stratified_proportion(
        labelled(spark, sf), "toxic", "lang", languages(spark, sf), "population"), 9)


def stratum_variances(spark, sf):
    return rounded(survey.stratum_variances(
        labelled(spark, sf), "toxic", "lang", languages(spark, sf), "population"), 9)


def survey_mean_stratified(spark, sf):
    return rounded(survey.survey_mean(labelled(spark, sf), "toxic", DESIGN), 9)


def survey_mean_unstratified(spark, sf):
    return rounded(survey.survey_mean(
        lineitem(spark, sf), "known_price", survey.SurveyDesign(weight="weight")))


def clustered_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as clusters by customer inside each priority, out of all customers."""
    everyone = read_table(spark, sf, "customer").agg(F.count("*").alias("n")).select("n").scalar()
    return orders(spark, sf).withColumn("customers", everyone)


CLUSTERED = survey.SurveyDesign(
    weight="weight", strata="o_orderpriority", unit="o_custkey", fpc="customers")
BY_ORDER = survey.SurveyDesign(weight="weight", strata="l_returnflag", unit="l_orderkey")


def survey_mean_clustered(spark, sf):
    return rounded(survey.survey_mean(
        clustered_orders(spark, sf), "large", CLUSTERED, level=0.95), 9)


def survey_mean_subpopulation(spark, sf):
    return rounded(survey.survey_mean(
        clustered_orders(spark, sf), "o_totalprice", CLUSTERED, where=F.col("treated") == 1,
        level=0.9), 4)


def survey_ratio(spark, sf):
    return rounded(survey.survey_ratio(
        lineitem(spark, sf), "known_price", "l_quantity", BY_ORDER))


def survey_mean_of_ratios(spark, sf):
    return rounded(survey.survey_ratio(
        lineitem(spark, sf), "l_tax", "l_discount", BY_ORDER, of_rows=True))


def survey_t_test_stratified(spark, sf):
    return rounded(survey.survey_t_test_by_design(
        clustered_orders(spark, sf), "o_totalprice", "o_orderstatus", "O", "F", CLUSTERED), 4,
        t_stat=6, p_value=6)


def strata_overview(spark, sf):
    return rounded(survey.strata_overview(labelled(spark, sf), DESIGN, "toxic"))


# --- sampling ----------------------------------------------------------------

def stratified_split(spark, sf):
    split = sampling.stratified_split(customers(spark, sf), "c_mktsegment", "c_custkey", seed=123)
    return split.select("c_custkey", "c_mktsegment", "in_first")


def stratified_split_numeric(spark, sf):
    table = sampling.value_brackets(customers(spark, sf), "c_acctbal")
    split = sampling.stratified_split(table, "bracket", "c_custkey", seed=123)
    return split.select("c_custkey", "bracket", "in_first")


def stratified_split_three_parts(spark, sf):
    split = sampling.stratified_parts(
        customers(spark, sf), "c_mktsegment", "c_custkey", (0.5, 0.3, 0.2), seed=123)
    return split.select("c_custkey", "c_mktsegment", "part")


def _segments(spark, sf):
    return customers(spark, sf).groupBy("c_mktsegment", "in_debt").agg(
        F.count("*").alias("size"), F.stddev_samp("c_acctbal").alias("spread"))


SEGMENT = ["c_mktsegment", "in_debt"]


def stratum_allocation(spark, sf):
    """75 customers dealt by size, and by size and spread."""
    strata = _segments(spark, sf)
    plain = sampling.allocate(strata, 75, "size", by=SEGMENT)
    best = sampling.allocate(
        strata, 75, "size", by=SEGMENT, spread="spread", allocated="by_spread")
    return plain.join(best, SEGMENT)


def stratified_draw(spark, sf):
    allocation = sampling.allocate(
        _segments(spark, sf), 75, "size", by=SEGMENT, spread="spread")
    drawn = sampling.stratified_draw(
        customers(spark, sf), SEGMENT, "c_custkey", allocation, "allocated", seed=7)
    return drawn.select("c_custkey", *SEGMENT)


def grid_weights(spark, sf):
    return rounded(events(spark, sf).select(
        "event_id", sampling.grid_weight("event_id", 123).alias("weight")))


def all_queries() -> dict[str, Query]:
    """Name to query, in the order of this file."""
    return {f.__name__: f for f in (
        dummy_from_predicate, filter_not_in_keep_null, filter_vs_global_mean,
        binary_contract_violations, membership_flag, percent_label, union_samples,
        group_moments, weighted_mean_by_group, frequency_table, crosstab, pivot_group_means,
        group_total_window, share_of_group_total, mean_of_ratios_vs_ratio_of_means,
        charge_counts, charge_counts_first_rows, charge_shares,
        charge_shares_many_attributes, prefixed_columns,
        five_number_summary, quantiles_long, outlier_summary, outlier_summary_grouped,
        outlier_summary_many_vars, outlier_summary_from_sketches, null_outliers_both, null_outliers_upper,
        null_outliers_lower, null_outliers_grouped, flag_outliers, histogram_before_after,
        quantiles_long_brackets, outlier_summary_grouped_brackets, null_outliers_brackets,
        welch_t_test, pooled_t_test, t_test_from_summary, t_test_from_summary_pooled,
        t_ci_conservative_df, t_ci_level_per_row, t_test_ordered_groups, weighted_t_test, weighted_t_test_sum_n,
        survey_t_test, two_sample_means, two_sample_means_equal_variance,
        means_of_many_vars, means_of_many_vars_weighted, means_of_two_tables,
        mean_test_method_comparison, ols_dummy, wls_dummy, ols_factor, wls_factor,
        ols_factors_and_number, ols_predictions,
        ols_slope_se_from_residuals, two_proportion_pooled, two_proportion_pooled_weighted,
        prop_test, prop_test_yates, prop_test_weighted_totals, prop_test_one_sample,
        proportion_margin_of_error, required_sample_size, wilson_interval,
        newcombe_difference, proportion_cv, suppression_flags, wilson_interval_from_counts,
        newcombe_difference_from_counts, prop_test_two_counts, prop_test_one_count,
        margin_of_error_counts, proportion_test_method_comparison,
        domain_vs_overall, domain_vs_overall_weighted, domain_vs_overall_small_domains,
        domain_vs_overall_many_domains, treatment_control_report_many_domains,
        treatment_control_report_refreshed,
        treatment_control_report, treatment_control_report_expanded,
        treatment_control_report_small_domains, stratified_proportion_moe,
        stratum_variances, survey_mean_stratified, survey_mean_unstratified,
        strata_overview, survey_mean_clustered, survey_mean_subpopulation, survey_ratio,
        survey_mean_of_ratios, survey_t_test_stratified, stratified_split, stratified_split_numeric, stratified_split_three_parts,
        stratum_allocation, stratified_draw, grid_weights,
    )}
