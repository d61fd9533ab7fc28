"""Treatment and control publication table.

Per domain: two outcomes of the treatment arm and one of the control arm, each
tested against its own arm's overall proportion, and the difference between the
arms.  All sums come from one aggregate over the rows of the two arms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.columns import (
    ColumnNames, col, names, percent, require, require_number,
)
from ..functions.intervals import Z_95, newcombe
from .domains import (
    Measure, Rules, STATISTICS, domain_statistics, domain_sums, merged_sums, statistics_of_sums,
    sum_columns,
)

# Fixed texts of the published table.
SUPPRESSED = "-"
SIGNIFICANT = "*"
UNRELIABLE = "X"
NEGATIVE = "--"
BETWEEN = " to "

_RULES = Rules(z=Z_95, strict=False, confidential=False, kind="sample")


def treatment_control_report(
    df: DataFrame, domain: ColumnNames, *, treatment: str, control: str,
    first_outcome: str, second_outcome: str, control_outcome: str, weight: str,
    first: str = "fraud", second: str = "denied", expanded: bool = False,
) -> DataFrame:
    """The published table, or with ``expanded`` every statistic behind it.

    ``treatment`` and ``control`` are 0/1 columns naming the arms.  ``first`` and
    ``second`` name the outcomes in the output columns.  Domains found only in
    the control arm do not appear; where the control arm lacks a domain its side
    is NULL.  ``is_overall`` marks the row of the whole table.  Several domain columns
    are reported from one reading of the table, told apart by the domain_var of the first side.
    """
    require(df, *names(domain))
    sides, measures = _sides(
        treatment, control, first_outcome, second_outcome, control_outcome, first, second)
    arms = _arms(df, treatment, control, measures, weight)
    table = domain_statistics(arms, domain, measures, weight, _RULES)
    return _published_table(table, sides, measures, second, expanded, not isinstance(domain, str))


def store_report_sums(
    df: DataFrame, path: str, domains: ColumnNames, part: str, *, treatment: str, control: str,
    first_outcome: str, second_outcome: str, control_outcome: str, weight: str,
    first: str = "fraud", second: str = "denied",
) -> None:
    """Write the sums behind the report to the folder ``path``, apart by the column ``part``.

    A part is what arrives and is corrected as one: a day, or a file.  Parts that ``df`` holds replace
    what the folder has of them, all others stay; a row without a part belongs to a part of its own.
    Only ``df`` is read, so a report on grown data costs its new parts.
    """
    require(df, part, *names(domains))
    _, measures = _sides(
        treatment, control, first_outcome, second_outcome, control_outcome, first, second)
    arms = _arms(df, treatment, control, measures, weight)
    # A part whose rows are in neither arm still replaces the old one, with sums of nothing.
    sums = domain_sums(arms, domains, measures, weight, part)
    empty = df.select(col(part).cast("string").alias("part")).distinct().select(
        F.lit(names(domains)[0]).alias("domain_var"), F.lit(None).cast("string").alias("value"),
        F.lit(False).alias("known"), "part",
        *[F.lit(0).cast(sums.schema[c].dataType).alias(c) for c in sum_columns(measures)])
    both = sums.unionByName(empty)
    both.repartition("part").write.partitionBy("part").mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").parquet(path)


def report_from_sums(
    spark: SparkSession, path: str, domains: ColumnNames, *, first: str = "fraud",
    second: str = "denied", expanded: bool = False, outcomes: tuple[str, str, str] = (
        "first outcome", "second outcome", "control outcome"),
) -> DataFrame:
    """:func:`treatment_control_report` from the sums in the folder ``path``.

    ``first`` and ``second`` are as they were when the sums were written; ``outcomes`` names the
    three outcome columns in messages and in the expanded table.
    """
    sides, measures = _sides("treatment", "control", *outcomes, first, second)
    stored = spark.read.parquet(path)
    require(stored, *sum_columns(measures))
    wanted = stored.filter(F.col("domain_var").isin(names(domains)))
    table = statistics_of_sums(merged_sums(wanted, measures), names(domains), measures, _RULES)
    return _published_table(table, sides, measures, second, expanded, not isinstance(domains, str))


def _sides(
    treatment: str, control: str, first_outcome: str, second_outcome: str, control_outcome: str,
    first: str, second: str,
) -> tuple[list[str], list[Measure]]:
    sides = [f"treatment_{first}", f"treatment_{second}", f"control_{second}"]
    return sides, [
        Measure(outcome, arm, f"{side}_")
        for side, outcome, arm in zip(
            sides, (first_outcome, second_outcome, control_outcome),
            (treatment, treatment, control))
    ]


def _arms(
    df: DataFrame, treatment: str, control: str, measures: list[Measure], weight: str,
) -> DataFrame:
    require_number(df, treatment, control, *[m.outcome for m in measures], weight)
    return df.filter((col(treatment) == 1) | (col(control) == 1))


def _published_table(
    table: DataFrame, sides: list[str], measures: list[Measure], second: str, expanded: bool,
    several: bool,
) -> DataFrame:
    table = table.filter(col(f"{sides[0]}_n_unweighted").isNotNull())
    gap = f"diff_btw_treatment_and_control_{second}"
    table = _with_gap(table, gap, sides[1], sides[2])
    table = _with_labels(table, sides, gap)

    key = [F.col("domain_var_value").alias(f"{sides[0]}_domain_var_value"), "is_overall"]
    var = [F.col("domain_var").alias(f"{sides[0]}_domain_var")] if several else []
    gap_label = "diff_btw_treatment_and_control_p_weighted_output"
    if not expanded:
        return table.select(
            *var, *key,
            *[f"{s}_{label}_output" for s in sides for label in ("p_weighted", "conf_int")],
            gap_label, f"{gap}_conf_int_output",
        )
    described = []
    for side, measure in zip(sides, measures):
        present = col(f"{side}_n_unweighted").isNotNull()

        def fixed(name: str, text: Column) -> Column:
            return F.when(present, text).alias(f"{side}_{name}")

        described += [
            fixed("domain_var", F.col("domain_var")), *(key if side == sides[0] else []),
            fixed("stat_var", F.lit(measure.outcome)), fixed("stat", F.lit("proportion")),
            *[f"{side}_{s}" for s in STATISTICS],
        ]
    return table.select(
        *described,
        *[f"{gap}_{c}" for c in _GAP_COLUMNS],
        *[f"{s}_{label}_output" for s in sides for label in ("p_weighted", "conf_int")],
        gap_label, *[f"{gap}_conf_int_{c}output" for c in ("lower_", "upper_", "")],
    )


# Fixed names of the published table.
_GAP_COLUMNS = [
    "p_weighted", "conf_int_lower", "conf_int_upper",
    "p_weighted_suppressed_flag", "conf_int_suppressed_flag",
    "conf_int_lower_negative_flag", "conf_int_upper_negative_flag",
    "p_weighted_unreliable_flag",
]


def _flag(condition: str) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.expr(f"CASE WHEN {condition} THEN 1 ELSE 0 END")


def _with_gap(table: DataFrame, gap: str, one: str, other: str) -> DataFrame:
    """The difference between the arms, its interval and its flags."""
    def of(side: str) -> list[str]:
        return [f"`{side}_{c}`" for c in ("p_weighted", "conf_int_lower", "conf_int_upper")]

    lower, upper = newcombe(*of(one), *of(other))
    table = table.withColumns({
        f"{gap}_p_weighted": F.expr(f"{of(one)[0]} - {of(other)[0]}"),
        f"{gap}_conf_int_lower": lower,
        f"{gap}_conf_int_upper": upper,
    })

    def either(flag: str) -> str:
        return " OR ".join(f"coalesce(`{side}_{flag}`, 0) = 1" for side in (one, other))

    hidden = either("suppressed_flag")
    below = f"coalesce(`{gap}_conf_int_lower` < 0, false)"
    return table.withColumns({
        f"{gap}_p_weighted_suppressed_flag": _flag(hidden),
        f"{gap}_conf_int_suppressed_flag": _flag(hidden),
        f"{gap}_conf_int_lower_negative_flag": _flag(below),
        f"{gap}_conf_int_upper_negative_flag": _flag(f"`{gap}_conf_int_upper` < 0"),
        f"{gap}_p_weighted_unreliable_flag": _flag(
            f"NOT ({hidden}) AND ({either('unreliable_flag')} OR {below})"),
    })


def _published(shown: str, suppressed: str, unreliable: str | None = None) -> Column:
    """The text to print: a dash when suppressed, a trailing mark when unreliable."""
    marked = f"WHEN `{unreliable}` = 1 THEN concat({shown}, '{UNRELIABLE}')" if unreliable else ""
    return F.expr(f"CASE WHEN `{suppressed}` = 1 THEN '{SUPPRESSED}' {marked} ELSE {shown} END")


def _with_labels(table: DataFrame, sides: list[str], gap: str) -> DataFrame:
    labels = {}
    for side in sides:
        value = percent(f"`{side}_p_weighted`")
        significant = f"`{side}_diff_btw_domain_and_overall_significant` = 1"
        starred = f"CASE WHEN {significant} THEN concat({value}, '{SIGNIFICANT}') ELSE {value} END"
        interval = (f"concat({percent(f'`{side}_conf_int_lower`')}, '{BETWEEN}',"
                    f" {percent(f'`{side}_conf_int_upper`')})")
        suppressed = f"{side}_suppressed_flag"
        labels[f"{side}_p_weighted_output"] = _published(
            starred, suppressed, f"{side}_unreliable_flag")
        labels[f"{side}_conf_int_output"] = _published(interval, suppressed)

    labels["diff_btw_treatment_and_control_p_weighted_output"] = _published(
        percent(f"`{gap}_p_weighted`"), f"{gap}_p_weighted_suppressed_flag",
        f"{gap}_p_weighted_unreliable_flag")
    for end in ("lower", "upper"):
        labels[f"{gap}_conf_int_{end}_output"] = F.expr(
            f"CASE WHEN `{gap}_conf_int_{end}_negative_flag` = 1 THEN '{NEGATIVE}'"
            f" ELSE {percent(f'`{gap}_conf_int_{end}`')} END")
    table = table.withColumns(labels)
    return table.withColumn(f"{gap}_conf_int_output", _published(
        f"concat(`{gap}_conf_int_lower_output`, '{BETWEEN}', `{gap}_conf_int_upper_output`)",
        f"{gap}_conf_int_suppressed_flag"))
