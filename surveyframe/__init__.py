"""Survey statistics over Spark DataFrames.

Every operator takes a DataFrame and column names and returns a DataFrame.
"""

from .operators.domains import domain_vs_overall
from .operators.means import (
    compare_mean_tests, means_of_two_tables, means_of_variables, pooled_t_test, survey_t_test,
    t_test, t_test_from_summary, two_sample_means, weighted_t_test, welch_t_test,
)
from .operators.outliers import (
    five_number_summary, flag_outliers, null_outliers, outlier_histogram, outlier_summary,
    outlier_summary_from_sketches, quantiles_long, store_sketches,
)
from .operators.proportions import (
    compare_proportion_tests, grouped_proportions, margin_of_error, margin_of_error_from_counts,
    newcombe_differences, newcombe_from_counts, prop_test, prop_test_from_counts,
    prop_test_one_sample, proportion_cv, required_sample_size, suppression_flags,
    suppression_flags_by_rules,
    two_proportion_test, wilson_from_counts, wilson_intervals,
)
from .operators.ratios import (
    category_shares, listed_counts, mean_of_ratios, member_flag, person_category_counts,
)
from .operators.regression import (
    factor_levels, linear_model, linear_regression, predictions, slope_standard_error,
)
from .operators.report import (
    report_from_sums, store_report_sums, treatment_control_report,
)
from .operators.sampling import (
    allocate, grid_weight, stratified_draw, stratified_parts, stratified_split, value_brackets,
)
from .operators.survey import (
    SurveyDesign, strata_overview, stratified_proportion, stratum_variances, survey_mean,
    survey_ratio, survey_t_test_by_design,
)
from .operators.tables import (
    binary_violations, crosstab, filter_by_mean, frequency_table, group_moments, group_total,
    pivot_group_means, split_by_mean, stack_tables, weighted_mean,
)
from .sources import read_table

__all__ = [name for name in dir() if not name.startswith("_")]
