"""Proportion of each domain against the whole table.

One aggregate per domain carries everything: the totals are sums of its few
rows, and the complement of a domain is the total minus the domain.  So the cost
does not depend on the number of domains.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import (
    ColumnNames, checked_binary, col, names as listed, require, require_number,
)
from ..functions.intervals import (
    Z_95, coefficient_of_variation, newcombe, standard_error_of_interval, wilson,
)
from ..functions.reliability import KINDS, publication_flags
from ..plans.attach import with_only_row
from ..plans.proportion_sums import SUMS, checked, proportion_sums

OVERALL = "overall"

# Fixed names of the published table.
STATISTICS = [
    "n_weighted", "n_unweighted", "x_weighted", "x_unweighted", "p_weighted", "p_unweighted",
    "conf_int_lower", "conf_int_upper", "standard_error", "coeff_of_variation",
    "strict_suppression", "confidentiality_concerns", "sample_or_population",
    "unreliable_flag", "suppressed_flag", "diff_btw_domain_and_overall_p",
    "conf_int_lower_weighted_for_diff_btw_domain_and_overall_p",
    "conf_int_upper_weighted_for_diff_btw_domain_and_overall_p",
    "diff_btw_domain_and_overall_significant",
]
COLUMNS = ["domain_var", "domain_var_value", "is_overall", "stat_var", "stat", *STATISTICS]


@dataclass(frozen=True)
class Rules:
    """Multiplier of the intervals and the publication rules."""

    z: float = Z_95
    strict: bool = True
    confidential: bool = True
    kind: str = "sample"

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}, not {self.kind!r}")


@dataclass(frozen=True)
class Measure:
    """An outcome over the rows where the 0/1 column ``among`` is 1 (all without it).

    Its columns carry the prefix.
    """

    outcome: str
    among: str | None = None
    prefix: str = ""

    def holds(self) -> Column | None:
        return None if self.among is None else F.coalesce(col(self.among) == 1, F.lit(False))


def domain_vs_overall(
    df: DataFrame, domain: ColumnNames, outcome: str, *, weight: str | None = None,
    z: float = Z_95, strict: bool = True, confidential: bool = True, kind: str = "sample",
) -> DataFrame:
    """Test each domain's proportion against the overall one.

    One row per value of ``domain`` and one, named ``overall``, for the table;
    ``is_overall`` tells it from a domain of that name.  Several domain columns each give
    such rows, told apart by ``domain_var``, from one reading of the table.
    Rows without a domain count only in the overall row.  The difference is that
    of the domain and its complement, with Newcombe's interval, scaled by the
    complement's share; it is significant when the interval leaves out 0.  The
    standard error always divides the interval by 2 x 1.96, whatever ``z`` is.
    """
    measure, rules = Measure(outcome), Rules(z, strict, confidential, kind)
    found = domain_statistics(df, domain, [measure], weight, rules)
    return found.select(
        "domain_var", "domain_var_value", "is_overall",
        F.lit(outcome).alias("stat_var"), F.lit("proportion").alias("stat"), *STATISTICS,
    )


def domain_statistics(
    df: DataFrame, domain: ColumnNames, measures: Sequence[Measure], weight: str | None,
    rules: Rules,
) -> DataFrame:
    """All statistics of all measures, one row per domain and one for the whole."""
    if isinstance(domain, str):
        return _finished(_one_domain(df, domain, measures, weight), measures, rules)
    return statistics_of_sums(
        domain_sums(df, domain, measures, weight), listed(domain), measures, rules)


def statistics_of_sums(
    sums: DataFrame, domains: Sequence[str], measures: Sequence[Measure], rules: Rules,
) -> DataFrame:
    """The same from the sums by domain (see :func:`domain_sums`)."""
    return _finished(_several_domains(sums, domains, measures), measures, rules)


def _finished(placed: DataFrame, measures: Sequence[Measure], rules: Rules) -> DataFrame:
    return _with_statistics(placed, [m.prefix for m in measures], rules).select(
        "domain_var", "domain_var_value", "is_overall",
        *[m.prefix + s for m in measures for s in STATISTICS])


def _aggregates(
    df: DataFrame, domains: Sequence[str], measures: Sequence[Measure], weight: str | None,
) -> list[Column]:
    require(df, *domains)
    require_number(df, weight, *[m.outcome for m in measures], *[m.among for m in measures])
    return [
        a for m in measures for a in proportion_sums(m.outcome, weight, m.holds(), m.prefix)]


def _totals(columns: Sequence[str]) -> list[Column]:
    """Totals of all domains, and of those with a value."""
    return [
        *[F.sum(col(c)).alias(f"all_{c}") for c in columns],
        *[F.sum(F.when(F.col("known"), col(c))).alias(f"known_{c}") for c in columns]]


def sum_columns(measures: Sequence[Measure]) -> list[str]:
    return [m.prefix + s for m in measures for s in SUMS]


def domain_sums(
    df: DataFrame, domains: ColumnNames, measures: Sequence[Measure], weight: str | None,
    part: str | None = None,
) -> DataFrame:
    """(domain_var, value, sums, known): the sums of each value of each domain column, in one scan.

    A row becomes one per domain column, and these are added up per task first.  Sums over different
    rows can be added, so ``part`` keeps them apart by one more column, to be merged later.
    """
    domains = listed(domains)
    if len(set(domains)) != len(domains) or not domains:
        raise ValueError("name one or several different domain columns")
    aggregates = _aggregates(df, domains, measures, weight)
    needed = dict.fromkeys(c for m in measures for c in (m.outcome, m.among) if c is not None)
    if weight:
        needed[weight] = None
    kept = ["__part"] if part else []
    rows = df.select(
        *[col(c) for c in needed], *([col(part).cast("string").alias("__part")] if part else []),
        F.posexplode(F.array(*[col(d).cast("string") for d in domains])).alias(
            "__number", "__value"))
    # As an aggregate the flag's filter stays behind the grouping: every use of the sums then reads
    # the same shuffled rows.
    sums = rows.groupBy(*kept, "__number", "__value").agg(
        *aggregates, F.max(F.col("__value").isNotNull()).alias("known"))
    names = F.array(*[F.lit(d) for d in domains])
    return sums.select(
        F.get(names, F.col("__number")).alias("domain_var"), F.col("__value").alias("value"),
        *[F.col(c).alias("part") for c in kept], *[col(c) for c in sum_columns(measures)], "known")


def merged_sums(sums: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    """Sums of several parts added up."""
    return sums.groupBy("domain_var", "value").agg(
        F.max("known").alias("known"), *[F.sum(col(c)).alias(c) for c in sum_columns(measures)])


def _several_domains(
    sums: DataFrame, domains: Sequence[str], measures: Sequence[Measure],
) -> DataFrame:
    """Per domain column as :func:`_one_domain`.

    The totals are one row, with an entry for each domain column; it comes from a subquery that both
    branches share and Spark runs once.
    """
    totals = sums.groupBy("domain_var").agg(*_totals(sum_columns(measures)))
    of_each = F.map_from_entries(F.collect_list(F.struct(
        "domain_var", F.struct(*[col(c) for c in totals.columns[1:]]))))
    totals = totals.agg(of_each.alias("__totals"))
    every = sums.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(d) for d in domains])).alias("domain_var"))

    def with_totals(rows: DataFrame) -> DataFrame:
        placed = with_only_row(rows, totals).withColumn(
            "__of", F.try_element_at("__totals", F.col("domain_var")))
        return placed.select(*[col(c) for c in rows.columns], "__of.*")

    return _placed(with_totals(sums.filter("known")), with_totals(every), measures)


def _one_domain(
    df: DataFrame, domain: str, measures: Sequence[Measure], weight: str | None,
) -> DataFrame:
    """Per domain and for the whole: the sums and those of the complement."""
    aggregates = _aggregates(df, [domain], measures, weight)
    # The flag is an aggregate so that its filter stays behind the grouping: every
    # use below then reads the same shuffled sums.
    sums = df.groupBy(col(domain).alias("value")).agg(
        *aggregates, F.max(col(domain).isNotNull()).alias("known"))
    totals = sums.agg(*_totals(sum_columns(measures)))

    # Both branches take the totals from the same subquery, which runs once.
    name = F.lit(domain)
    return _placed(
        with_only_row(sums.filter("known"), totals).withColumn("domain_var", name),
        with_only_row(df.sparkSession.range(1), totals).withColumn("domain_var", name), measures)


def _placed(
    of_domains: DataFrame, overall: DataFrame, measures: Sequence[Measure],
) -> DataFrame:
    """Domains and wholes, both with their totals, as rows of one shape."""
    domain_columns, overall_columns = [], []
    for m in measures:
        p = m.prefix

        def left(name: str) -> Column:
            return col(f"known_{p}{name}") - col(f"{p}{name}")

        present = col(f"{p}n_unweighted") > 0
        others, other_hits = left("n_unweighted") > 0, left("x_unweighted") > 0
        domain_columns += [
            F.when(present, checked(m.outcome, p)).alias(f"{p}n_weighted"),
            *[F.when(present, col(p + s)).alias(p + s) for s in SUMS[1:4]],
            # Counts decide what is left; a difference of weights may miss 0 by a little.
            F.when(others, left("n_weighted")).alias(f"{p}other_n"),
            F.when(others & other_hits, left("x_weighted")).when(others, 0.0)
            .alias(f"{p}other_x"),
            present.alias(f"{p}present"),
        ]
        every = F.coalesce(col(f"all_{p}n_weighted"), F.lit(0.0))
        nothing = F.lit(None).cast("double")
        overall_columns += [
            checked_binary(m.outcome, every, col(f"all_{p}bad_rows")).alias(f"{p}n_weighted"),
            *[col(f"all_{p}{s}").alias(p + s) for s in SUMS[1:4]],
            nothing.alias(f"{p}other_n"), nothing.alias(f"{p}other_x"),
            F.lit(True).alias(f"{p}present"),
        ]
    return of_domains.select(
        "domain_var", F.col("value").cast("string").alias("domain_var_value"),
        F.lit(False).alias("is_overall"), *domain_columns,
    ).unionByName(overall.select(
        "domain_var", F.lit(OVERALL).alias("domain_var_value"), F.lit(True).alias("is_overall"),
        *overall_columns))


def _with_statistics(df: DataFrame, prefixes: Sequence[str], rules: Rules) -> DataFrame:
    """Every statistic of every measure, each step for all measures at once."""
    for step in (_proportions, _intervals, _errors, _variations, _flags_and_differences,
                 _significance):
        df = df.withColumns({
            prefix + name: column
            for prefix in prefixes
            for name, column in step(lambda name, p=prefix: f"`{p}{name}`", rules).items()
        })
    return df


Names = Callable[[str], str]


def _proportions(c: Names, rules: Rules) -> dict[str, Column]:
    def setting(value) -> Column:
        return F.expr(f"CASE WHEN {c('present')} THEN {value!r} END")

    return {
        "p_weighted": F.expr(f"try_divide({c('x_weighted')}, {c('n_weighted')})"),
        "p_unweighted": F.expr(
            f"try_divide(double({c('x_unweighted')}), {c('n_unweighted')})"),
        "other_p": F.expr(f"try_divide({c('other_x')}, {c('other_n')})"),
        "strict_suppression": setting(rules.strict),
        "confidentiality_concerns": setting(rules.confidential),
        "sample_or_population": setting(rules.kind),
    }


def _intervals(c: Names, rules: Rules) -> dict[str, Column]:
    lower, upper = wilson(c("n_weighted"), c("p_weighted"), rules.z)
    other_lower, other_upper = wilson(c("other_n"), c("other_p"), rules.z)
    return {"conf_int_lower": lower, "conf_int_upper": upper,
            "other_lower": other_lower, "other_upper": other_upper}


def _errors(c: Names, rules: Rules) -> dict[str, Column]:
    return {"standard_error": standard_error_of_interval(
        c("conf_int_lower"), c("conf_int_upper"))}


def _variations(c: Names, rules: Rules) -> dict[str, Column]:
    return {"coeff_of_variation": coefficient_of_variation(
        c("standard_error"), c("p_weighted"))}


def _flags_and_differences(c: Names, rules: Rules) -> dict[str, Column]:
    """Publication flags, and the difference from the complement scaled to the whole."""
    suppressed, unreliable = publication_flags(
        c("x_unweighted"), c("n_unweighted"), c("coeff_of_variation"),
        strict=rules.strict, confidential=rules.confidential, kind=rules.kind)
    share = f"try_divide({c('other_n')}, {c('n_weighted')} + {c('other_n')})"
    low, high = newcombe(
        c("p_weighted"), c("conf_int_lower"), c("conf_int_upper"),
        c("other_p"), c("other_lower"), c("other_upper"), scale=share)
    present = F.expr(c("present"))
    return {
        "unreliable_flag": F.when(present, unreliable),
        "suppressed_flag": F.when(present, suppressed),
        "diff_btw_domain_and_overall_p": F.expr(
            f"{share} * ({c('p_weighted')} - {c('other_p')})"),
        "conf_int_lower_weighted_for_diff_btw_domain_and_overall_p": low,
        "conf_int_upper_weighted_for_diff_btw_domain_and_overall_p": high,
    }


def _significance(c: Names, rules: Rules) -> dict[str, Column]:
    low = c("conf_int_lower_weighted_for_diff_btw_domain_and_overall_p")
    high = c("conf_int_upper_weighted_for_diff_btw_domain_and_overall_p")
    return {"diff_btw_domain_and_overall_significant": F.expr(
        f"CASE WHEN {low} IS NULL OR {high} IS NULL THEN NULL"
        f" WHEN least({low}, {high}) > 0 OR greatest({low}, {high}) < 0 THEN 1 ELSE 0 END")}
