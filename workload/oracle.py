"""The registered queries as DuckDB SQL, written independently of the library.

DuckDB has neither a t nor a normal distribution: p-values come from Simpson's
rule on the density, t quantiles from the Cornish-Fisher series (the degrees of
freedom here are in the hundreds at least).
"""

from __future__ import annotations

from statistics import NormalDist

Z95 = "1.959963984540054e0"
Z99 = "2.5758293035489004e0"
Z90 = "1.6448536269514722e0"


# --- building blocks ---------------------------------------------------------

def rounded(sql: str, columns: str, digits: int = 6) -> str:
    """``sql`` with the named columns rounded and without negative zero."""
    fixed = ", ".join(f"round({c}, {digits}) + 0 AS {c}" for c in columns.split())
    return f"SELECT * REPLACE ({fixed}) FROM ({sql})"


def simpson(density: str, upper: str) -> str:
    """Integral of ``density`` (of ``u``) from 0 to ``upper``, in 2000 steps."""
    weight = "(CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    at = density.replace("(u)", f"(i * ({upper}) / 2000e0)")
    return (f"(list_sum(list_transform(range(0, 2001), lambda i: {weight} * {at}))"
            f" * ({upper}) / 6000e0)")


def t_p(t: str, df: str) -> str:
    """Two-sided p-value of t; beyond 40 the tail is 0 to all printed digits."""
    upper = f"least(abs({t}), 40e0)"
    constant = f"exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(({df}) * pi())"
    density = f"pow(1 + (u) * (u) / ({df}), -(({df}) + 1) / 2)"
    return (f"CASE WHEN ({t}) IS NOT NULL AND ({df}) > 0 THEN "
            f"greatest(0e0, 1 - 2 * {constant} * {simpson(density, upper)}) END")


def chi_p(statistic: str) -> str:
    """Upper tail of chi-squared with one degree of freedom."""
    upper = f"least(sqrt({statistic}), 40e0)"
    density = "exp(-(u) * (u) / 2)"
    return (f"CASE WHEN ({statistic}) IS NOT NULL THEN "
            f"greatest(0e0, 1 - 2 / sqrt(2 * pi()) * {simpson(density, upper)}) END")


def t_q(z: str, df: str) -> str:
    """Quantile of t at the level of the normal quantile ``z``."""
    return (
        f"({z} + (pow({z}, 3) + {z}) / (4 * ({df}))"
        f" + (5 * pow({z}, 5) + 16 * pow({z}, 3) + 3 * {z}) / (96 * pow({df}, 2))"
        f" + (3 * pow({z}, 7) + 19 * pow({z}, 5) + 17 * pow({z}, 3) - 15 * {z})"
        f" / (384 * pow({df}, 3))"
        f" + (79 * pow({z}, 9) + 776 * pow({z}, 7) + 1482 * pow({z}, 5)"
        f" - 1920 * pow({z}, 3) - 945 * {z}) / (92160 * pow({df}, 4)))"
    )


def wilson(n: str, p: str, sign: str, z: str = "1.96e0") -> str:
    """One bound of Wilson's interval."""
    return (f"((2 * {n} * {p} + {z} * {z}) {sign} {z} * sqrt(4 * {n} * {p} * (1 - {p})"
            f" + {z} * {z})) / (2 * ({n} + {z} * {z}))")


def percent(p: str) -> str:
    return f"printf('%.1f', round(100 * ({p}), 1) + 0) || '%'"


LINEITEM = """
li AS (
  SELECT *, 1 + l_linenumber / 10e0 AS weight,
         CASE WHEN year(l_shipdate) <> 1998 THEN l_extendedprice END AS known_price
  FROM lineitem)"""

ORDERS = """
o AS (
  SELECT *,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS treated,
         CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS control,
         CASE WHEN year(o_orderdate) <> 1996
              THEN CASE WHEN o_totalprice > 450000 THEN 1 ELSE 0 END END AS large,
         CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END AS medium,
         1 + (o_orderkey % 5) / 4e0 AS weight,
         nullif(o_orderpriority, '5-LOW') AS priority
  FROM orders)"""

EVENTS = """
ev AS (
  SELECT *, nullif(event_type, 'error') AS kind,
         CASE WHEN hour(ts) <> 3 THEN value END AS known_value,
         -value AS negative_value
  FROM events)"""

PARTS = """
pa AS (SELECT *, CASE WHEN p_size > 45 THEN 1 ELSE 0 END AS oversized FROM part)"""

LABELLED = """
pop AS (SELECT lang, count(*) AS population FROM documents GROUP BY lang),
drawn AS (SELECT lang, count(*) AS drawn FROM labels JOIN documents USING (doc_id) GROUP BY lang),
sample AS (
  SELECT l.*, d.lang, population, population / drawn AS weight
  FROM labels l JOIN documents d USING (doc_id)
  JOIN pop ON pop.lang = d.lang JOIN drawn ON drawn.lang = d.lang)"""

TEST = "diff_in_means std_error df t_stat p_value conf_int_lower conf_int_upper"


# --- t tests -----------------------------------------------------------------

def tested(moments: str, rule: str = "welch", z: str = Z95, null: str = "0", keep: str = "") -> str:
    """t test from a relation with m1 m2 v1 v2 n1 n2 (variances of values, sizes)."""
    if rule == "pooled":
        se = "sqrt((1 / n1 + 1 / n2) * ((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))"
        df = "(n1 + n2 - 2)"
    else:
        se = "sqrt(v1 / n1 + v2 / n2)"
        df = ("(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1)"
              " + pow(v2 / n2, 2) / (n2 - 1)))")
    if rule == "conservative":
        df = "(least(n1, n2) - 1)"
    keep = keep + "," if keep else ""
    return f"""
    SELECT {keep} diff_in_means, std_error, df, t_stat, {t_p('t_stat', 'df')} AS p_value,
           diff_in_means - {t_q(z, 'df')} * std_error AS conf_int_lower,
           diff_in_means + {t_q(z, 'df')} * std_error AS conf_int_upper
    FROM (SELECT *, (diff_in_means - {null}) / std_error AS t_stat
          FROM (SELECT *, m1 - m2 AS diff_in_means, {se} AS std_error,
                       CAST({df} AS DOUBLE) AS df FROM ({moments})))"""


def plain_moments(value: str, group: str, x: str, y: str, source: str) -> str:
    return f"""
    SELECT count({value}) FILTER ({group} = {x}) AS n1, count({value}) FILTER ({group} = {y}) AS n2,
           avg({value}) FILTER ({group} = {x}) AS m1, avg({value}) FILTER ({group} = {y}) AS m2,
           var_samp({value}) FILTER ({group} = {x}) AS v1,
           var_samp({value}) FILTER ({group} = {y}) AS v2
    FROM {source}"""


def weighted_moments(
    value: str, group: str, x: str, y: str, weight: str, source: str, mean_one: bool = True,
) -> str:
    size = "count(*)" if mean_one else "sum(w)"
    return f"""
    SELECT max(n) FILTER (side = 1) AS n1, max(n) FILTER (side = 2) AS n2,
           max(m) FILTER (side = 1) AS m1, max(m) FILTER (side = 2) AS m2,
           max(v) FILTER (side = 1) AS v1, max(v) FILTER (side = 2) AS v2
    FROM (SELECT side, {size} AS n, any_value(m) AS m,
                 sum(w * pow(y - m, 2)) / sum(w) * {size} / ({size} - 1) AS v
          FROM (SELECT *, sum(w * y) OVER (PARTITION BY side)
                          / sum(w) OVER (PARTITION BY side) AS m
                FROM (SELECT CASE WHEN {group} = {x} THEN 1 ELSE 2 END AS side,
                             CAST({value} AS DOUBLE) AS y, {weight} AS w
                      FROM {source} WHERE {group} IN ({x}, {y}) AND {value} IS NOT NULL))
          GROUP BY side)"""


def simple_t_test(value: str, x: str, y: str, rule: str = "welch") -> str:
    sql = tested(plain_moments(value, "l_returnflag", x, y, "li"), rule,
                 keep="n1 AS n_x, n2 AS n_y, m1 AS mean_x, m2 AS mean_y")
    return rounded(f"WITH {LINEITEM} {sql}", "mean_x mean_y " + TEST)


def weighted_test(mean_one: bool) -> str:
    moments = weighted_moments(
        "known_price", "l_returnflag", "'R'", "'A'", "weight", "li", mean_one)
    sql = tested(moments, keep="CAST(n1 AS DOUBLE) AS n_x, CAST(n2 AS DOUBLE) AS n_y,"
                               " m1 AS mean_x, m2 AS mean_y")
    return rounded(f"WITH {LINEITEM} {sql}", "n_x n_y mean_x mean_y " + TEST)


SUMMARIES = """
SELECT l_linenumber,
       avg(l_extendedprice) FILTER (l_returnflag = 'R') AS m1,
       stddev_samp(l_extendedprice) FILTER (l_returnflag = 'R') AS s1,
       count(*) FILTER (l_returnflag = 'R') AS n1,
       avg(l_extendedprice) FILTER (l_returnflag = 'A') AS m2,
       stddev_samp(l_extendedprice) FILTER (l_returnflag = 'A') AS s2,
       count(*) FILTER (l_returnflag = 'A') AS n2
FROM lineitem GROUP BY l_linenumber"""


def summary_test(rule: str, z: str = Z95, null: str = "0") -> str:
    source = f"SELECT *, s1 * s1 AS v1, s2 * s2 AS v2 FROM ({SUMMARIES})"
    keep = "l_linenumber, m1, s1, n1, m2, s2, n2"
    return rounded(tested(source, rule, z, null, keep), "m1 s1 m2 s2 " + TEST)


LEVELS = (0.5, 0.8, 0.9, 0.95, 0.99, 0.9999, 0.99999999)


def level_per_row() -> str:
    def by_line(values) -> str:
        cases = " ".join(f"WHEN {i} THEN {v!r}::DOUBLE" for i, v in enumerate(values, 1))
        return f"(CASE l_linenumber {cases} END)"

    z = by_line([NormalDist().inv_cdf((1 + level) / 2) for level in LEVELS])
    source = f"""
    SELECT *, s1 * s1 AS v1, s2 * s2 AS v2, {by_line(LEVELS)} AS level FROM ({SUMMARIES})"""
    keep = "l_linenumber, m1, s1, n1, m2, s2, n2, level"
    return rounded(rounded(tested(source, "welch", z, keep=keep), "m1 s1 m2 s2 " + TEST, 5),
                   "level", 9)


def survey_scores(
    value: str, x: str, y: str, group: str = "l_returnflag", source: str = "li",
) -> str:
    """n, means and linearised variance of two weighted groups."""
    return f"""
    SELECT count(*) FILTER (side = 1) AS n1, count(*) FILTER (side = 2) AS n2,
           max(m) FILTER (side = 1) AS m1, max(m) FILTER (side = 2) AS m2,
           count(*) / (count(*) - 1) * sum(pow(w * (y - m) / total, 2)) AS variance
    FROM (SELECT *, sum(w * y) OVER (PARTITION BY side) / sum(w) OVER (PARTITION BY side) AS m,
                 sum(w) OVER (PARTITION BY side) AS total
          FROM (SELECT CASE WHEN {group} = {x} THEN 1 ELSE 2 END AS side,
                       {value} AS y, weight AS w
                FROM {source} WHERE {group} IN ({x}, {y}) AND {value} IS NOT NULL))"""


def finished(source: str, keep: str) -> str:
    """t test of columns diff_in_means, std_error and df."""
    return f"""
    SELECT {keep}, diff_in_means, std_error, df, t_stat, {t_p('t_stat', 'df')} AS p_value,
           diff_in_means - {t_q(Z95, 'df')} * std_error AS conf_int_lower,
           diff_in_means + {t_q(Z95, 'df')} * std_error AS conf_int_upper
    FROM (SELECT *, diff_in_means / std_error AS t_stat FROM ({source}))"""


def design_based(
    source: str, estimate: str, *, stratum: str, unit: str, population: str | None,
    totals: str, influence: str, keep: str, lost: int = 0, z: str = Z95, test: bool = False,
) -> str:
    """An estimate with the variance of its rows' influences under strata of clusters.

    ``totals`` are aggregates of the rows, which ``influence`` and ``estimate`` may use.
    """
    unsampled = f"(1 - n_h / any_value({population}))" if population else "1"
    size = f", any_value({population}) AS {population}" if population else ""
    p_value = f"{t_p('t_stat', 'df')} AS p_value," if test else ""
    t_stat = "t_stat," if test else ""
    return f"""
    WITH rows AS ({source}), whole AS (SELECT {totals} FROM rows),
    units AS (SELECT {stratum} AS h, {unit} AS u, sum({influence}) AS z,
                     max(inside::INT) AS used {size}
              FROM rows, whole GROUP BY 1, 2),
    strata AS (SELECT h, count(*) AS n_h, sum(used) AS used_h,
                      {unsampled} * n_h * var_samp(z) AS v FROM units GROUP BY h),
    added AS (SELECT CAST(count(*) FILTER (used_h > 0) AS BIGINT) AS strata,
                     CAST(sum(used_h) AS BIGINT) AS units, sqrt(sum(v)) AS std_error FROM strata)
    SELECT {keep}, strata, units, estimate AS {estimate}, std_error, df, {t_stat} {p_value}
           estimate - {t_q(z, 'df')} * std_error AS conf_int_lower,
           estimate + {t_q(z, 'df')} * std_error AS conf_int_upper
    FROM (SELECT *, estimate / std_error AS t_stat,
                 CAST(units - strata - {lost} AS DOUBLE) AS df FROM added, whole)"""


def factor_model(
    source: str, y: str, factor: str, base: str, weight: str = "1e0", x: str | None = None,
    aliased: str | None = None,
) -> str:
    """Least squares on a factor, and on one number inside its levels, in closed form."""
    xs = x or "0"
    line = f"""
    SELECT coalesce(sum(sxy) / nullif(sum(sxx), 0), 0) AS b, sum(sxx) AS sxx,
           sum(syy) - coalesce(sum(sxy) * sum(sxy) / nullif(sum(sxx), 0), 0) AS sse,
           sum(n) - count(*) - {1 if x else 0} AS df FROM levels"""
    number = "" if x is None else f"""
    UNION ALL SELECT '{x}', b, sqrt(sse / df / sxx), df, false FROM line"""
    alias = "" if aliased is None else f"""
    UNION ALL SELECT '{aliased}', NULL, NULL, df, true FROM line"""
    return f"""
    WITH rows AS (SELECT CAST({factor} AS VARCHAR) AS g, CAST({y} AS DOUBLE) AS y,
                         CAST({xs} AS DOUBLE) AS x, CAST({weight} AS DOUBLE) AS w
                  FROM ({source}) WHERE {y} IS NOT NULL),
    means AS (SELECT g, sum(w * y) / sum(w) AS my, sum(w * x) / sum(w) AS mx FROM rows GROUP BY g),
    levels AS (SELECT g, count(*) AS n, sum(w) AS total, any_value(my) AS my, any_value(mx) AS mx,
                      sum(w * pow(x - mx, 2)) AS sxx, sum(w * (x - mx) * (y - my)) AS sxy,
                      sum(w * pow(y - my, 2)) AS syy FROM rows JOIN means USING (g) GROUP BY g),
    line AS ({line}), first AS (SELECT * FROM levels WHERE g = '{base}'),
    terms AS (
    SELECT '(Intercept)' AS term, f.my - b * f.mx AS estimate,
           sqrt(sse / df * (1 / f.total + coalesce(f.mx * f.mx / nullif(line.sxx, 0), 0)))
           AS std_error, df, false AS aliased FROM first f, line
    UNION ALL
    SELECT '{factor}' || l.g, l.my - f.my - b * (l.mx - f.mx),
           sqrt(sse / df * (1 / l.total + 1 / f.total
                + coalesce(pow(l.mx - f.mx, 2) / nullif(line.sxx, 0), 0))), df, false
    FROM levels l, first f, line WHERE l.g <> f.g {number} {alias})
    SELECT term, estimate, std_error, df, statistic, {t_p('statistic', 'df')} AS p_value,
           estimate - {t_q(Z95, 'df')} * std_error AS conf_int_lower,
           estimate + {t_q(Z95, 'df')} * std_error AS conf_int_upper, aliased
    FROM (SELECT term, estimate, std_error, CAST(df AS DOUBLE) AS df,
                 estimate / std_error AS statistic, aliased FROM terms)"""


TERMS = "estimate std_error statistic p_value conf_int_lower conf_int_upper"


def factor_queries(li: str) -> dict[str, str]:
    source = f"{li} SELECT * FROM li"
    return {
        "ols_factor": rounded(factor_model(source, "known_price", "l_linenumber", "1"), TERMS),
        "wls_factor": rounded(factor_model(
            source, "known_price", "l_returnflag", "R", "weight"), TERMS),
        "ols_factors_and_number": rounded(factor_model(
            source, "known_price", "l_returnflag", "A", x="l_quantity", aliased="opentrue"), TERMS),
    }


SURVEY_CI = "std_error conf_int_lower conf_int_upper"


def clustered_queries(o: str, li: str) -> dict[str, str]:
    customers = f"{o} SELECT *, (SELECT count(*) FROM customer) AS customers"
    by_customer = {
        "stratum": "o_orderpriority", "unit": "o_custkey", "population": "customers"}
    by_order = {"stratum": "l_returnflag", "unit": "l_orderkey", "population": None}
    mean_of = ("count(*) FILTER (inside) AS n, sum(weight) FILTER (inside) AS total,"
               " sum(weight * y) FILTER (inside) / total AS estimate")
    off_mean = "CASE WHEN inside THEN weight * (y - estimate) / total ELSE 0 END"
    side = ("count(*) FILTER ({0}) AS n_{1}, sum(weight) FILTER ({0}) AS total_{1},"
            " sum(weight * y) FILTER ({0}) / total_{1} AS mean_{1}")
    return {
        "survey_mean_clustered": rounded(design_based(
            f"{customers}, large AS y, true AS inside FROM o WHERE large IS NOT NULL", "mean",
            **by_customer, totals=mean_of, influence=off_mean, keep="n"), "mean " + SURVEY_CI, 9),
        "survey_mean_subpopulation": rounded(design_based(
            f"{customers}, o_totalprice AS y, treated = 1 AS inside FROM o", "mean",
            **by_customer, totals=mean_of, influence=off_mean, keep="n", z=Z90),
            "mean " + SURVEY_CI, 4),
        "survey_ratio": rounded(design_based(
            f"{li} SELECT *, true AS inside FROM li WHERE known_price IS NOT NULL", "ratio",
            **by_order, keep="n",
            totals="count(*) AS n, sum(weight * l_quantity) AS total,"
                   " sum(weight * known_price) / total AS estimate",
            influence="weight * (known_price - estimate * l_quantity) / total"),
            "ratio " + SURVEY_CI),
        "survey_mean_of_ratios": rounded(design_based(
            f"{li} SELECT *, l_tax / l_discount AS y, true AS inside FROM li"
            " WHERE l_discount <> 0", "ratio",
            **by_order, totals=mean_of, influence=off_mean, keep="n"), "ratio " + SURVEY_CI),
        "survey_t_test_stratified": rounded(rounded(design_based(
            f"{customers}, o_totalprice AS y, true AS inside FROM o"
            " WHERE o_orderstatus IN ('F', 'O')", "diff_in_means", **by_customer,
            totals=side.format("o_orderstatus = 'F'", "first") + ", "
            + side.format("o_orderstatus = 'O'", "second")
            + ", mean_second - mean_first AS estimate",
            influence="CASE WHEN o_orderstatus = 'O' THEN weight * (y - mean_second) / total_second"
                      " ELSE -weight * (y - mean_first) / total_first END",
            keep="n_first, n_second, mean_first, mean_second", lost=1, test=True),
            "mean_first mean_second diff_in_means " + SURVEY_CI, 4), "t_stat p_value"),
    }


def survey_t_test() -> str:
    source = f"""
    SELECT *, m2 - m1 AS diff_in_means, sqrt(variance) AS std_error,
           CAST(n1 + n2 - 2 AS DOUBLE) AS df
    FROM ({survey_scores('known_price', "'A'", "'R'")})"""
    keep = "n1 AS n_first, n2 AS n_second, m1 AS mean_first, m2 AS mean_second"
    return rounded(f"WITH {LINEITEM} {finished(source, keep)}", "mean_first mean_second " + TEST)


def method_comparison() -> str:
    value = "l_extendedprice"
    plain = plain_moments(value, "l_returnflag", "'R'", "'A'", "li")
    weighted = weighted_moments(value, "l_returnflag", "'R'", "'A'", "weight", "li")
    ols = f"""
    SELECT slope AS diff_in_means,
           sqrt((syy - slope * slope * sxx) / (n - 2) / sxx) AS std_error,
           CAST(n - 2 AS DOUBLE) AS df
    FROM (SELECT regr_slope({value}, x) AS slope, regr_sxx({value}, x) AS sxx,
                 regr_syy({value}, x) AS syy, count(*) AS n
          FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS x
                FROM li WHERE l_returnflag IN ('R', 'A')))"""
    survey = f"""
    SELECT m1 - m2 AS diff_in_means, sqrt(variance) AS std_error,
           CAST(n1 + n2 - 2 AS DOUBLE) AS df
    FROM ({survey_scores(value, "'R'", "'A'")})"""
    counted = weighted_moments(value, "l_returnflag", "'R'", "'A'", "weight", "li", False)
    pairs = PAIRS.replace("known_price", value)
    wls_line = f"""
    SELECT 'wls' AS method, estimate AS diff_in_means, std_error, df, statistic AS t_stat, p_value,
           conf_int_lower, conf_int_upper
    FROM ({line_terms(wls_sums(pairs))}) WHERE term = 'returned'"""
    parts = [
        tested(plain, "welch", keep="'welch' AS method"),
        tested(plain, "pooled", keep="'pooled' AS method"),
        finished(ols, "'ols' AS method"), wls_line,
        tested(weighted, "welch", keep="'weighted' AS method"),
        tested(counted, "welch", keep="'weighted_sum_n' AS method"),
        finished(survey, "'survey' AS method"),
    ]
    return rounded(f"WITH {LINEITEM} " + " UNION ALL ".join(parts), TEST)


MEANS = "mean_x mean_y diff_in_means t_stat p_value std_error conf_int_lower conf_int_upper"


def means_row(
    variable: str, group: str, x: str, y: str, source: str, *, weight: str | None = None,
    weights_used: str = "false, false", rule: str = "welch", index: int | None = None,
    name: str | None = None,
) -> str:
    """One row of the dispatching test: weighted when ``weight`` is given."""
    counted = f"""
    SELECT count({variable}) FILTER ({group} = {x}) AS c1, count({variable}) FILTER ({group} = {y})
           AS c2, count(*) FILTER ({group} = {x} AND {variable} IS NULL) AS k1,
           count(*) FILTER ({group} = {y} AND {variable} IS NULL) AS k2 FROM {source}"""
    if weight:
        moments = weighted_moments(variable, group, x, y, weight, source)
        kind, lower = "'wtd.t.test'", "2 * std_error"
    else:
        moments = plain_moments(variable, group, x, y, source)
        kind, lower = "'t.test'", "(conf_int_upper - diff_in_means)"
    used_x, used_y = (u.strip() for u in weights_used.split(","))
    label = "" if index is None else f"{index} AS variable_index, '{name or variable}' AS variable,"
    return f"""
    SELECT {label} c1 AS x_unweighted_count, k1 AS x_na_count, c2 AS y_unweighted_count,
           k2 AS y_na_count, mean_x, mean_y, diff_in_means, {used_x} AS weights_x_used,
           {used_y} AS weights_y_used, {kind} AS test_type, t_stat, p_value, std_error,
           {'true' if rule == 'pooled' else 'false'} AS equal_variance,
           diff_in_means - {lower} AS conf_int_lower, diff_in_means + {lower} AS conf_int_upper
    FROM ({tested(moments, rule, keep='m1 AS mean_x, m2 AS mean_y')}), ({counted})"""


MANY = ["l_quantity", "known_price", "l_discount", "l_tax"]


def many_means(weight: str | None) -> str:
    used = "true, true" if weight else "false, false"
    rows = [
        means_row(v, "l_linestatus", "'F'", "'O'", "li", weight=weight, weights_used=used, index=i)
        for i, v in enumerate(MANY)
    ]
    return rounded(f"WITH {LINEITEM} " + " UNION ALL ".join(rows), MEANS)


def two_tables() -> str:
    source = "(SELECT *, CASE WHEN treated = 1 THEN weight ELSE 1 END AS w2 FROM o)"
    rows = [
        means_row(v, "o_orderstatus", "'F'", "'O'", source, weight="w2",
                  weights_used="true, false", index=i)
        for i, v in enumerate(["o_totalprice", "large"])
    ]
    return rounded(f"WITH {ORDERS} " + " UNION ALL ".join(rows), MEANS)


# --- regression --------------------------------------------------------------

def line_terms(sums: str) -> str:
    """Two rows of terms from n, total, mx, my, sxx, sxy, syy."""
    base = f"""
    SELECT *, sxy / sxx AS slope, my - sxy / sxx * mx AS intercept,
           (syy - sxy * sxy / sxx) / (n - 2) AS s2, CAST(n - 2 AS DOUBLE) AS df
    FROM ({sums})"""
    rows = f"""
    SELECT '(Intercept)' AS term, intercept AS estimate,
           sqrt(s2 * (1 / total + mx * mx / sxx)) AS std_error, df FROM ({base})
    UNION ALL
    SELECT 'returned', slope, sqrt(s2 / sxx), df FROM ({base})"""
    return f"""
    SELECT term, estimate, std_error, df, statistic, {t_p('statistic', 'df')} AS p_value,
           estimate - {t_q(Z95, 'df')} * std_error AS conf_int_lower,
           estimate + {t_q(Z95, 'df')} * std_error AS conf_int_upper
    FROM (SELECT *, estimate / std_error AS statistic FROM ({rows}))"""


LINE = "estimate std_error df statistic p_value conf_int_lower conf_int_upper"
PAIRS = """(
  SELECT known_price AS y, CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END AS x, weight AS w
  FROM li WHERE l_returnflag IN ('R', 'A') AND known_price IS NOT NULL)"""


def ols() -> str:
    sums = f"""
    SELECT count(*) AS n, count(*) AS total, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx,
           regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy FROM {PAIRS}"""
    return rounded(f"WITH {LINEITEM} {line_terms(sums)}", LINE)


def wls_sums(pairs: str) -> str:
    return f"""
    SELECT count(*) AS n, sum(w) AS total, any_value(mx) AS mx, any_value(my) AS my,
           sum(w * pow(x - mx, 2)) AS sxx, sum(w * (x - mx) * (y - my)) AS sxy,
           sum(w * pow(y - my, 2)) AS syy
    FROM {pairs}, (SELECT sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM {pairs})"""


def wls() -> str:
    return rounded(f"WITH {LINEITEM} {line_terms(wls_sums(PAIRS))}", LINE)


DEAR = f"""{ORDERS},
d AS (SELECT o.*, CASE WHEN o_totalprice >= m THEN 1 ELSE 0 END AS dear,
             CASE WHEN o_totalprice > m THEN 1 ELSE 0 END AS dearer
      FROM o, (SELECT avg(o_totalprice) AS m FROM o))"""

FITTED = f"""WITH {DEAR},
line AS (SELECT regr_slope(treated, dearer) AS b, regr_intercept(treated, dearer) AS a FROM d)
"""


# --- proportions -------------------------------------------------------------

def two_groups(weight: str = "1e0") -> str:
    """Sizes, weights and proportions of treated orders, dear against cheap."""
    return f"""
    SELECT n_x, n_y, w_x, w_y, h_x / w_x AS p_x, h_y / w_y AS p_y,
           (h_x + h_y) / (w_x + w_y) AS pooled_p
    FROM (SELECT count(*) FILTER (dear = 1) AS n_x, count(*) FILTER (dear = 0) AS n_y,
                 sum({weight}) FILTER (dear = 1) AS w_x, sum({weight}) FILTER (dear = 0) AS w_y,
                 sum({weight}) FILTER (dear = 1 AND treated = 1) AS h_x,
                 sum({weight}) FILTER (dear = 0 AND treated = 1) AS h_y
          FROM d)"""


def two_proportions_of(weight: str = "1e0") -> str:
    return f"""
    SELECT n_x, n_y, p_x, p_y, pooled_p, p_diff, std_error, df, t_stat,
           {t_p('t_stat', 'df')} AS p_value,
           p_diff - {t_q(Z95, 'df')} * std_error AS conf_int_lower,
           p_diff + {t_q(Z95, 'df')} * std_error AS conf_int_upper
    FROM (SELECT *, p_diff / std_error AS t_stat
          FROM (SELECT *, p_x - p_y AS p_diff, CAST(n_x + n_y - 2 AS DOUBLE) AS df,
                       sqrt(pooled_p * (1 - pooled_p) * (1 / n_x + 1 / n_y)) AS std_error
                FROM ({two_groups(weight)})))"""


def two_proportions(weight: str = "1e0") -> str:
    return rounded(f"WITH {DEAR} {two_proportions_of(weight)}",
                   "p_x p_y pooled_p p_diff std_error df t_stat p_value"
                   " conf_int_lower conf_int_upper")


def prop_test(weight: str = "1e0", yates: bool = False) -> str:
    correction = "least(0.5e0, abs(delta) / k)" if yates else "0e0"
    sql = f"""
    SELECT w_x AS n_x, w_y AS n_y, p_x, p_y, delta AS p_diff, statistic,
           {chi_p('statistic')} AS p_value,
           greatest(-1e0, delta - reach) AS conf_int_lower,
           least(1e0, delta + reach) AS conf_int_upper
    FROM (SELECT *, pow(abs(delta) - c * k, 2) / (pooled_p * (1 - pooled_p) * k) AS statistic,
                 {Z95} * sqrt(p_x * (1 - p_x) / w_x + p_y * (1 - p_y) / w_y) + c * k AS reach
          FROM (SELECT *, {correction} AS c
                FROM (SELECT *, p_x - p_y AS delta, 1 / w_x + 1 / w_y AS k
                      FROM ({two_groups(weight)}))))"""
    return rounded(f"WITH {DEAR} {sql}",
                   "n_x n_y p_x p_y p_diff statistic p_value conf_int_lower conf_int_upper")


def one_sample() -> str:
    sql = f"""
    SELECT o_orderpriority, n, successes, proportion, statistic, {chi_p('statistic')} AS p_value,
           CASE WHEN lo <= 0 THEN 0e0 ELSE {wilson('n', 'lo', '-', Z95)} END AS conf_int_lower,
           CASE WHEN hi >= 1 THEN 1e0 ELSE {wilson('n', 'hi', '+', Z95)} END AS conf_int_upper
    FROM (SELECT *, pow(abs(successes - n / 2) - c, 2) / (n / 4) AS statistic,
                 proportion - c / n AS lo, proportion + c / n AS hi
          FROM (SELECT *, least(0.5e0, abs(successes - n / 2)) AS c, successes / n AS proportion
                FROM (SELECT o_orderpriority, count(dear) AS n,
                             count(*) FILTER (dear = 1) AS successes
                      FROM d GROUP BY 1)))"""
    return rounded(f"WITH {DEAR} {sql}",
                   "proportion statistic p_value conf_int_lower conf_int_upper")


def chi_parts(source: str, yates: bool) -> str:
    """Chi-squared test of equality from columns n_x, n_y (sizes), p_x and p_y."""
    correction = "least(0.5e0, abs(delta) / k)" if yates else "0e0"
    return f"""
    SELECT *, delta AS p_diff, {chi_p('statistic')} AS p_value,
           greatest(-1e0, delta - reach) AS conf_int_lower,
           least(1e0, delta + reach) AS conf_int_upper
    FROM (SELECT *, pow(abs(delta) - c * k, 2) / (pooled * (1 - pooled) * k) AS statistic,
                 {Z95} * sqrt(p_x * (1 - p_x) / n_x + p_y * (1 - p_y) / n_y) + c * k AS reach
          FROM (SELECT *, {correction} AS c
                FROM (SELECT *, p_x - p_y AS delta, 1 / n_x + 1 / n_y AS k,
                             (p_x * n_x + p_y * n_y) / (n_x + n_y) AS pooled FROM ({source}))))"""


def proportion_methods() -> str:
    value, group = "treated", "dear"
    plain = plain_moments(value, group, "1", "0", "d")
    named = {m: weighted_moments(value, group, "1", "0", "weight", "d", one)
             for m, one in (("weighted", True), ("weighted_sum_n", False))}
    survey = f"""
    SELECT m1 - m2 AS diff_in_means, sqrt(variance) AS std_error,
           CAST(n1 + n2 - 2 AS DOUBLE) AS df
    FROM ({survey_scores(value, "1", "0", group, "d")})"""
    as_test = "SELECT method, diff_in_means AS p_diff, std_error, df, t_stat AS statistic, p_value,"
    as_test += " conf_int_lower, conf_int_upper FROM "
    parts = [as_test + f"({sql})" for sql in (
        tested(plain, "welch", keep="'welch' AS method"),
        tested(plain, "pooled", keep="'pooled' AS method"),
        *[tested(m, "welch", keep=f"'{k}' AS method") for k, m in named.items()],
        finished(survey, "'survey' AS method"))]
    for name, weight in (("two_proportion", "1e0"), ("two_proportion_weighted", "weight")):
        parts.append(f"""SELECT '{name}', p_diff, std_error, df, t_stat, p_value, conf_int_lower,
            conf_int_upper FROM ({two_proportions_of(weight)})""")
    for name, weight, yates in (("prop_test", "1e0", False), ("prop_test_yates", "1e0", True),
                                ("prop_test_weighted", "weight", False)):
        sizes = f"SELECT w_x AS n_x, w_y AS n_y, p_x, p_y FROM ({two_groups(weight)})"
        parts.append(f"""SELECT '{name}', p_diff, NULL, 1e0, statistic, p_value, conf_int_lower,
            conf_int_upper FROM ({chi_parts(sizes, yates)})""")
    return rounded(f"WITH {DEAR} " + " UNION ALL ".join(parts),
                   "p_diff std_error df statistic p_value conf_int_lower conf_int_upper")


PRIORITY_COUNTS = """
SELECT o_orderpriority, count(*) FILTER (treated = 1) AS n_treated,
       count(*) FILTER (control = 1) AS n_control,
       count(*) FILTER (treated = 1 AND dear = 1) AS x_treated,
       count(*) FILTER (control = 1 AND dear = 1) AS x_control,
       x_treated / n_treated AS p_treated, x_control / n_control AS p_control
FROM d GROUP BY 1"""


def counts_as_input() -> dict[str, str]:
    d = f"WITH {DEAR}"
    t, c = ("n_treated", "p_treated"), ("n_control", "p_control")
    two = (f"SELECT *, n_treated AS n_x, n_control AS n_y, p_treated AS p_x, p_control AS p_y"
           f" FROM ({PRIORITY_COUNTS})")
    return {
        "wilson_interval_from_counts": rounded(f"""{d}
            SELECT o_orderpriority, n_treated, p_treated, {wilson(*t, '-')} AS conf_int_lower,
                   {wilson(*t, '+')} AS conf_int_upper FROM ({PRIORITY_COUNTS})""",
            "p_treated conf_int_lower conf_int_upper"),
        "newcombe_difference_from_counts": rounded(f"""{d}
            SELECT o_orderpriority, p_treated - p_control AS p_diff,
                   p_treated - p_control - sqrt(pow(p_treated - {wilson(*t, '-')}, 2)
                     + pow({wilson(*c, '+')} - p_control, 2)) AS conf_int_lower,
                   p_treated - p_control + sqrt(pow({wilson(*t, '+')} - p_treated, 2)
                     + pow(p_control - {wilson(*c, '-')}, 2)) AS conf_int_upper
            FROM ({PRIORITY_COUNTS})""", "p_diff conf_int_lower conf_int_upper"),
        "prop_test_two_counts": rounded(f"""{d}
            SELECT o_orderpriority, x_treated, n_treated, x_control, n_control, p_x, p_y, p_diff,
                   statistic, p_value, conf_int_lower, conf_int_upper
            FROM ({chi_parts(two, True)})""",
            "p_x p_y p_diff statistic p_value conf_int_lower conf_int_upper"),
        "prop_test_one_count": rounded(f"""{d}
            SELECT *, {chi_p('statistic')} AS p_value,
                   CASE WHEN proportion <= 0 THEN 0e0
                        ELSE {wilson('n_treated', 'proportion', '-', Z95)} END AS conf_int_lower,
                   CASE WHEN proportion >= 1 THEN 1e0
                        ELSE {wilson('n_treated', 'proportion', '+', Z95)} END AS conf_int_upper
            FROM (SELECT o_orderpriority, x_treated, n_treated, p_treated AS proportion,
                         pow(abs(x_treated - n_treated / 2), 2) / (n_treated / 4) AS statistic
                  FROM ({PRIORITY_COUNTS}))""",
            "proportion statistic p_value conf_int_lower conf_int_upper"),
        "margin_of_error_counts": rounded(f"""{d}
            SELECT *, {Z99} * std_error AS margin_of_error,
                   p_treated - {Z99} * std_error AS conf_int_lower,
                   p_treated + {Z99} * std_error AS conf_int_upper
            FROM (SELECT o_orderpriority, n_treated, p_treated,
                         sqrt(p_treated * (1 - p_treated) / n_treated) AS std_error
                  FROM ({PRIORITY_COUNTS}))""",
            "p_treated std_error margin_of_error conf_int_lower conf_int_upper"),
        "proportion_test_method_comparison": proportion_methods(),
    }


def grouped(outcome: str, by: str, source: str, weight: str = "1e0") -> str:
    return f"""
    SELECT *, x_weighted / n_weighted AS p_weighted,
           x_unweighted / n_unweighted AS p_unweighted
    FROM (SELECT {by}, CAST(coalesce(sum({weight}), 0) AS DOUBLE) AS n_weighted,
                 count(*) AS n_unweighted,
                 CAST(coalesce(sum({weight}) FILTER ({outcome} = 1), 0) AS DOUBLE) AS x_weighted,
                 count(*) FILTER ({outcome} = 1) AS x_unweighted
          FROM {source} GROUP BY ALL)"""


def with_wilson(source: str, z: str = "1.96e0") -> str:
    return f"""
    SELECT *, {wilson('n_weighted', 'p_weighted', '-', z)} AS conf_int_lower,
           {wilson('n_weighted', 'p_weighted', '+', z)} AS conf_int_upper
    FROM ({source})"""


def with_cv(source: str, z: str = "1.96e0") -> str:
    return f"""
    SELECT *, standard_error / (least(p_weighted, 1 - p_weighted) + 0.001e0) AS coeff_of_variation
    FROM (SELECT *, (conf_int_upper - conf_int_lower) / 3.92e0 AS standard_error
          FROM ({with_wilson(source, z)}))"""


ESTIMATES = "n_weighted x_weighted p_weighted p_unweighted conf_int_lower conf_int_upper"

# Suppressed and unreliable conditions per rule name.
X, N, CV = "x_unweighted", "n_unweighted", "coeff_of_variation"
SMALL = f"({X} < 20 OR {N} < 100)"
DOUBT = f"({CV} > 0.3e0 AND {CV} <= 0.5e0)"
FLAGS = {
    "strict_confidential": (f"{SMALL} OR {CV} > 0.3e0", "false"),
    "strict_open_sample": (f"{X} < 10 OR {CV} > 0.3e0", "false"),
    "strict_open_population": (f"{SMALL} OR {CV} > 0.3e0", "false"),
    "loose_confidential": (f"{SMALL} OR {CV} > 0.5e0", f"{SMALL} OR {DOUBT}"),
    "loose_open": (f"{CV} > 0.5e0 OR {X} < 10", f"{DOUBT} OR ({X} >= 10 AND {X} < 20)"),
}


def flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def suppression() -> str:
    flags = ", ".join(
        f"{flag(s)} AS {name}_suppressed, {flag(u)} AS {name}_unreliable"
        for name, (s, u) in FLAGS.items())
    source = with_cv(grouped("oversized", "p_brand", "pa"))
    return rounded(f"WITH {PARTS} SELECT p_brand, {N}, {X}, {CV}, {flags} FROM ({source})", CV)


# --- domains and report ------------------------------------------------------

DOMAIN_DOUBLES = (
    "n_weighted x_weighted p_weighted p_unweighted conf_int_lower conf_int_upper"
    " standard_error coeff_of_variation diff_btw_domain_and_overall_p"
    " conf_int_lower_weighted_for_diff_btw_domain_and_overall_p"
    " conf_int_upper_weighted_for_diff_btw_domain_and_overall_p")


def domain_table(
    source: str, domain: str, outcome: str, rule: str, settings: str,
    weight: str = "1e0", z: str = "1.96e0",
) -> str:
    """Each domain against all others, computed from the rows of either side."""
    suppressed, unreliable = FLAGS[rule]
    sides = f"""
    SELECT v AS domain_var_value, false AS is_overall,
           sum({weight}) FILTER ({domain} = v) AS n_weighted,
           count(*) FILTER ({domain} = v) AS n_unweighted,
           coalesce(sum({weight}) FILTER ({domain} = v AND {outcome} = 1), 0) AS x_weighted,
           count(*) FILTER ({domain} = v AND {outcome} = 1) AS x_unweighted,
           sum({weight}) FILTER ({domain} <> v) AS n2,
           coalesce(sum({weight}) FILTER ({domain} <> v AND {outcome} = 1), 0)
           / sum({weight}) FILTER ({domain} <> v) AS p2
    FROM {source}, (SELECT DISTINCT {domain} AS v FROM {source} WHERE {domain} IS NOT NULL)
    GROUP BY v
    UNION ALL
    SELECT 'overall', true, sum({weight}), count(*),
           coalesce(sum({weight}) FILTER ({outcome} = 1), 0),
           count(*) FILTER ({outcome} = 1), NULL, NULL
    FROM {source}"""
    p, l1, u1 = "p_weighted", "conf_int_lower", "conf_int_upper"
    return f"""
    SELECT '{domain}' AS domain_var, CAST(domain_var_value AS VARCHAR) AS domain_var_value,
           is_overall, '{outcome}' AS stat_var, 'proportion' AS stat,
           CAST(n_weighted AS DOUBLE) AS n_weighted, n_unweighted,
           CAST(x_weighted AS DOUBLE) AS x_weighted, x_unweighted, p_weighted, p_unweighted,
           conf_int_lower, conf_int_upper, standard_error, coeff_of_variation, {settings},
           {flag(unreliable)} AS unreliable_flag, {flag(suppressed)} AS suppressed_flag,
           share * ({p} - p2) AS diff_btw_domain_and_overall_p,
           share * low AS conf_int_lower_weighted_for_diff_btw_domain_and_overall_p,
           share * high AS conf_int_upper_weighted_for_diff_btw_domain_and_overall_p,
           CASE WHEN share * low IS NULL OR share * high IS NULL THEN NULL
                WHEN share * low > 0 AND share * high > 0 THEN 1
                WHEN share * low < 0 AND share * high < 0 THEN 1 ELSE 0 END
             AS diff_btw_domain_and_overall_significant
    FROM (
      SELECT *, 1 - n_weighted / (n_weighted + n2) AS share,
             ({p} - p2) - sqrt(pow({p} - {l1}, 2) + pow(u2 - p2, 2)) AS low,
             ({p} - p2) + sqrt(pow({u1} - {p}, 2) + pow(p2 - l2, 2)) AS high
      FROM (SELECT *, {wilson('n2', 'p2', '-', z)} AS l2, {wilson('n2', 'p2', '+', z)} AS u2
            FROM ({with_cv(f"SELECT *, x_weighted / n_weighted AS p_weighted,"
                           f" x_unweighted / n_unweighted AS p_unweighted FROM ({sides})", z)})))"""


def settings(strict: bool, confidential: bool, kind: str) -> str:
    return (f"{str(strict).lower()} AS strict_suppression,"
            f" {str(confidential).lower()} AS confidentiality_concerns,"
            f" '{kind}' AS sample_or_population")


OPEN = settings(False, False, "sample")


def published(shown: str, suppressed: str, unreliable: str | None = None) -> str:
    mark = f"WHEN {unreliable} = 1 THEN {shown} || 'X'" if unreliable else ""
    return f"CASE WHEN {suppressed} = 1 THEN '-' {mark} ELSE {shown} END"


SIDES = ("treatment_fraud", "treatment_denied", "control_denied")
GAP = "diff_btw_treatment_and_control_denied"


def report(source: str, domain: str) -> str:
    """All columns of the expanded report."""
    tables = []
    for side, arm, outcome in zip(
            SIDES, ("treated", "treated", "control"), ("large", "medium", "medium")):
        rows = f"(SELECT * FROM {source} WHERE {arm} = 1)"
        table = domain_table(rows, domain, outcome, "loose_open", OPEN, "weight")
        tables.append(f"(SELECT * FROM ({table})) AS {side}")
    t, c = SIDES[1], SIDES[2]
    key, overall = f"{SIDES[0]}.domain_var_value", f"{SIDES[0]}.is_overall"

    def side_columns(side: str) -> str:
        names = ["domain_var", "domain_var_value", "stat_var", "stat", *DOMAIN_STATISTICS]
        if side != SIDES[0]:
            names.remove("domain_var_value")
        return ", ".join(f"{side}.{n} AS {side}_{n}" for n in names)

    joined = f"""
    SELECT {', '.join(side_columns(s) for s in SIDES)}, {SIDES[0]}.is_overall AS is_overall,
           {t}.p_weighted - {c}.p_weighted AS {GAP}_p_weighted,
           {t}.p_weighted - {c}.p_weighted - sqrt(pow({t}.p_weighted - {t}.conf_int_lower, 2)
             + pow({c}.conf_int_upper - {c}.p_weighted, 2)) AS {GAP}_conf_int_lower,
           {t}.p_weighted - {c}.p_weighted + sqrt(pow({t}.conf_int_upper - {t}.p_weighted, 2)
             + pow({c}.p_weighted - {c}.conf_int_lower, 2)) AS {GAP}_conf_int_upper
    FROM {tables[0]}
    LEFT JOIN {tables[1]} ON {t}.domain_var_value = {key} AND {t}.is_overall = {overall}
    LEFT JOIN {tables[2]} ON {c}.domain_var_value = {key} AND {c}.is_overall = {overall}"""
    hidden = f"({t}_suppressed_flag = 1 OR {c}_suppressed_flag = 1)"
    flagged = f"""
    SELECT *, {flag(hidden)} AS {GAP}_p_weighted_suppressed_flag,
           {flag(hidden)} AS {GAP}_conf_int_suppressed_flag,
           {flag(f'{GAP}_conf_int_lower < 0')} AS {GAP}_conf_int_lower_negative_flag,
           {flag(f'{GAP}_conf_int_upper < 0')} AS {GAP}_conf_int_upper_negative_flag
    FROM ({joined})"""
    doubt = (f"{GAP}_p_weighted_suppressed_flag = 0 AND ({t}_unreliable_flag = 1"
             f" OR {c}_unreliable_flag = 1 OR {GAP}_conf_int_lower_negative_flag = 1)")
    labels = []
    for s in SIDES:
        value = percent(f"{s}_p_weighted")
        starred = (f"({value} || CASE WHEN {s}_diff_btw_domain_and_overall_significant = 1"
                   f" THEN '*' ELSE '' END)")
        between = (f"({percent(f'{s}_conf_int_lower')} || ' to '"
                   f" || {percent(f'{s}_conf_int_upper')})")
        labels.append(published(starred, f"{s}_suppressed_flag", f"{s}_unreliable_flag")
                      + f" AS {s}_p_weighted_output")
        labels.append(published(between, f"{s}_suppressed_flag") + f" AS {s}_conf_int_output")
    for end in ("lower", "upper"):
        labels.append(
            f"CASE WHEN {GAP}_conf_int_{end}_negative_flag = 1 THEN '--'"
            f" ELSE {percent(f'{GAP}_conf_int_{end}')} END AS {GAP}_conf_int_{end}_output")
    gap_label = published(percent(f"{GAP}_p_weighted"), f"{GAP}_p_weighted_suppressed_flag",
                          f"{GAP}_p_weighted_unreliable_flag")
    between = f"({GAP}_conf_int_lower_output || ' to ' || {GAP}_conf_int_upper_output)"
    return f"""
    SELECT *, {published(between, f'{GAP}_conf_int_suppressed_flag')} AS {GAP}_conf_int_output
    FROM (SELECT *, {gap_label} AS diff_btw_treatment_and_control_p_weighted_output,
                 {', '.join(labels)}
          FROM (SELECT *, {flag(doubt)} AS {GAP}_p_weighted_unreliable_flag FROM ({flagged})))"""


DOMAIN_STATISTICS = (
    "n_weighted n_unweighted x_weighted x_unweighted p_weighted p_unweighted conf_int_lower"
    " conf_int_upper standard_error coeff_of_variation strict_suppression"
    " confidentiality_concerns sample_or_population unreliable_flag suppressed_flag"
    " diff_btw_domain_and_overall_p conf_int_lower_weighted_for_diff_btw_domain_and_overall_p"
    " conf_int_upper_weighted_for_diff_btw_domain_and_overall_p"
    " diff_btw_domain_and_overall_significant").split()

COMPACT = ", ".join(
    [f"{SIDES[0]}_domain_var_value", "is_overall"]
    + [f"{s}_{c}_output" for s in SIDES for c in ("p_weighted", "conf_int")]
    + ["diff_btw_treatment_and_control_p_weighted_output", f"{GAP}_conf_int_output"])


# --- quantiles and outliers --------------------------------------------------

FIVE = "[0, 0.25, 0.5, 0.75, 1]"
QUANTILES = ("q0", "q25", "q50", "q75", "q100")


def five_columns(array: str) -> str:
    return ", ".join(f"{array}[{k + 1}] AS {q}" for k, q in enumerate(QUANTILES))


def fenced(source: str, variable: str, by: str | None = None) -> str:
    """Rows of ``source`` with value y, the quantile list and the fences of their group."""
    by = by or "1"
    return f"""
    SELECT *, CASE WHEN q[1] <> q[5] THEN q[2] - 1.5e0 * (q[4] - q[2]) END AS low,
           CASE WHEN q[1] <> q[5] THEN q[4] + 1.5e0 * (q[4] - q[2]) END AS high
    FROM (SELECT a.*, {variable} AS y, g.q
          FROM {source} a JOIN (SELECT {by} AS g, quantile_cont({variable}, {FIVE}) AS q
                                FROM {source} GROUP BY {by if by != '1' else 'ALL'}) g
          ON {'a.' + by if by != '1' else '1'} IS NOT DISTINCT FROM g.g)"""


def outlier_rows(source: str, variable: str, by: str | None = None) -> str:
    key = f"{by}," if by else ""
    many = ", ".join(
        f"CASE WHEN any_value(q)[1] <> any_value(q)[5] THEN any_value(q)[{k + 1}] END AS {q}"
        for k, q in enumerate(QUANTILES))
    return f"""
    SELECT '{variable}' AS var, {key} {many},
           any_value(low) AS lower_outlier_threshold,
           count(*) FILTER (y <= low) AS lower_outlier_count,
           count(*) FILTER (y <= low) / count(*) AS lower_outlier_pct,
           any_value(high) AS upper_outlier_threshold,
           count(*) FILTER (y >= high) AS upper_outlier_count,
           count(*) FILTER (y >= high) / count(*) AS upper_outlier_pct
    FROM ({fenced(source, variable, by)}) {f'GROUP BY {by}' if by else ''}"""


OUTLIERS = ("q0 q25 q50 q75 q100 lower_outlier_threshold lower_outlier_pct"
            " upper_outlier_threshold upper_outlier_pct")


def nulled(variable: str, condition: str, by: str | None = None) -> str:
    sql = f"""
    SELECT event_id, kind, CASE WHEN {condition} THEN NULL ELSE y END AS {variable}
    FROM ({fenced('ev', variable, by)})"""
    return rounded(f"WITH {EVENTS} {sql}", variable)


def flags_of(variable: str) -> str:
    return (f"SELECT event_id, {flag('y <= low')} AS {variable}_lower_outlier_flag,"
            f" {flag('y >= high')} AS {variable}_upper_outlier_flag"
            f" FROM ({fenced('ev', variable, 'kind')})")


def histogram() -> str:
    def bins(version: str, value: str) -> str:
        return f"""
        SELECT '{version}' AS version, bin, lo + bin * width AS bin_start,
               lo + (bin + 1) * width AS bin_end, n
        FROM (SELECT lo, width, least(CAST(floor((v - lo) / width) AS INTEGER), 29) AS bin,
                     count(*) AS n
              FROM (SELECT {value} AS v FROM f WHERE {value} IS NOT NULL),
                   (SELECT min({value}) AS lo, (max({value}) - min({value})) / 30 AS width FROM f)
              GROUP BY ALL)"""

    cleaned = "CASE WHEN y > low AND y < high THEN y END"
    return rounded(
        f"WITH {EVENTS}, f AS ({fenced('ev', 'known_value')})"
        f" {bins('before', 'y')} UNION ALL {bins('after', f'({cleaned})')}",
        "bin_start bin_end")


# --- shares ------------------------------------------------------------------

COUNTS = f"""WITH {EVENTS},
relabelled AS (
  SELECT user_id AS person, CAST(ts AS DATE) AS day,
         CASE WHEN user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
              THEN 'unable to extract' ELSE kind END AS category
  FROM ev),
arrests AS (
  SELECT DISTINCT person, day, category, c_nationkey, c_mktsegment
  FROM relabelled LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c
       ON c.c_custkey = person
  WHERE category IS NULL OR category NOT IN ('signup', 'undefined')),
totals AS (SELECT person, category, count(*) AS dates FROM arrests GROUP BY 1, 2),
counts AS (
  SELECT a.person, a.category, t.dates
  FROM (SELECT DISTINCT person, category, c_nationkey, c_mktsegment FROM arrests) a
  JOIN totals t ON a.person = t.person AND a.category IS NOT DISTINCT FROM t.category)
"""


def draw(key: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5({key} || '|{seed}'), 1, 8) AS BIGINT)"


STRATUM_PARTS = """
SELECT lang, n_h, x_h, CAST(population AS DOUBLE) AS population_h, x_h / n_h AS p_h,
       x_h / n_h * (1 - x_h / n_h) / n_h * (population - n_h) / (population - 1) AS variance_h
FROM (SELECT lang, any_value(population) AS population, count(*) AS n_h,
             count(*) FILTER (toxic = 1) AS x_h FROM sample GROUP BY lang)"""


def dealt(total: int, measure: str, name: str) -> str:
    """Largest remainders; the strata here hold more than they are dealt."""
    return f"""
    SELECT c_mktsegment, in_debt, CAST(floor(share) + CASE WHEN row_number() OVER (
               ORDER BY share - floor(share) DESC, c_mktsegment, in_debt)
               <= {total} - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS {name}
    FROM (SELECT *, {total}e0 / sum(m) OVER () * m AS share
          FROM (SELECT *, {measure} AS m FROM segments))"""


SEGMENTS = """
cu AS (SELECT *, CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END AS in_debt FROM customer),
segments AS (SELECT c_mktsegment, in_debt, count(*) AS size, stddev_samp(c_acctbal) AS spread
             FROM cu GROUP BY 1, 2)"""


def sampling_queries() -> dict[str, str]:
    return {
        "stratified_split_numeric": """
            SELECT c_custkey, bracket,
                   CASE WHEN row_number() OVER (PARTITION BY bracket ORDER BY h, c_custkey)
                             <= ceil(0.5e0 * count(*) OVER (PARTITION BY bracket))
                        THEN 1 ELSE 0 END AS in_first
            FROM (SELECT c_custkey, md5(c_custkey || '|123') AS h,
                         CAST(1 + (c_acctbal > q[1])::INT + (c_acctbal > q[2])::INT
                              + (c_acctbal > q[3])::INT AS INTEGER) AS bracket
                  FROM customer, (SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS q
                                  FROM customer))""",
        "stratified_split_three_parts": """
            SELECT c_custkey, c_mktsegment,
                   CASE WHEN place <= ceil(0.5e0 * n) THEN 1 WHEN place <= ceil(0.8e0 * n) THEN 2
                        ELSE 3 END AS part
            FROM (SELECT *, count(*) OVER (PARTITION BY c_mktsegment) AS n, row_number() OVER (
                         PARTITION BY c_mktsegment ORDER BY md5(c_custkey || '|123'), c_custkey)
                         AS place FROM customer)""",
        "stratum_allocation": f"""
            WITH {SEGMENTS}
            SELECT * FROM ({dealt(75, 'size', 'allocated')})
            JOIN ({dealt(75, 'size * spread', 'by_spread')}) USING (c_mktsegment, in_debt)""",
        "stratified_draw": f"""
            WITH {SEGMENTS}
            SELECT c_custkey, c_mktsegment, in_debt
            FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, in_debt
                         ORDER BY md5(c_custkey || '|7'), c_custkey) AS place FROM cu)
            JOIN ({dealt(75, 'size * spread', 'allocated')}) USING (c_mktsegment, in_debt)
            WHERE place <= allocated""",
    }


def all_sql() -> dict[str, str]:
    """Query name to SQL."""
    li, o, ev, pa = (f"WITH {c}" for c in (LINEITEM, ORDERS, EVENTS, PARTS))
    sample = f"WITH {LABELLED}"
    quantiles_long = rounded(f"""
            SELECT unnest(['0%', '25%', '50%', '75%', '100%']) AS name, unnest(q) AS value
            FROM (SELECT quantile_cont(l_extendedprice, {FIVE}) AS q FROM lineitem)""", "value")
    summary_grouped = rounded(f"{ev} {outlier_rows('ev', 'known_value', 'kind')}", OUTLIERS)
    return counts_as_input() | {
        "dummy_from_predicate": f"""{o}
            SELECT priority, CASE WHEN priority = '1-URGENT' THEN 1
                                  WHEN priority <> '1-URGENT' THEN 0 END AS rush, count(*) AS n
            FROM o GROUP BY ALL""",
        "filter_not_in_keep_null": f"""{ev}
            SELECT kind, count(*) AS n FROM ev
            WHERE kind IS NULL OR kind NOT IN ('click', 'view') GROUP BY kind""",
        "filter_vs_global_mean": rounded("""
            SELECT CASE WHEN o_totalprice >= m THEN 'at_least' ELSE 'below' END AS side,
                   count(*) AS n, min(o_totalprice) AS lowest, max(o_totalprice) AS highest
            FROM orders, (SELECT avg(o_totalprice) AS m FROM orders) GROUP BY 1""",
            "lowest highest"),
        "binary_contract_violations": """
            WITH j AS (SELECT * FROM labels JOIN documents USING (doc_id))
            SELECT 'quality' AS "column", count(*) FILTER (quality NOT IN (0, 1)) AS violations
            FROM j UNION ALL
            SELECT 'toxic', count(*) FILTER (toxic NOT IN (0, 1)) FROM j UNION ALL
            SELECT 'n_chars', count(*) FILTER (n_chars NOT IN (0, 1)) FROM j""",
        "membership_flag": """
            SELECT event_id, user_id,
                   user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS in_debt
            FROM events""",
        "percent_label": f"""{o}
            SELECT o_orderpriority, {percent('avg(medium)')} AS label,
                   printf('%.0f', round(100 * (avg(medium) - 0.5e0), 0) + 0) || '%' AS off_half
            FROM o GROUP BY 1""",
        "union_samples": rounded(f"""{o}
            SELECT CASE WHEN treated = 1 THEN 'treatment' ELSE 'control' END AS origin,
                   count(*) AS n, count(large) FILTER (treated = 1) AS n_large,
                   avg(o_totalprice) AS mean_price
            FROM o WHERE treated = 1 OR control = 1 GROUP BY 1""", "mean_price"),
        "group_moments": rounded(rounded(f"""{li}
            SELECT l_returnflag, l_linestatus, count(*) AS n,
                   count(known_price) AS known_price_count,
                   count(*) - count(known_price) AS known_price_missing,
                   sum(known_price) AS known_price_sum, avg(known_price) AS known_price_mean,
                   stddev_samp(known_price) AS known_price_sd,
                   count(l_quantity) AS l_quantity_count,
                   count(*) - count(l_quantity) AS l_quantity_missing,
                   sum(l_quantity) AS l_quantity_sum, avg(l_quantity) AS l_quantity_mean,
                   stddev_samp(l_quantity) AS l_quantity_sd
            FROM li GROUP BY 1, 2""",
            "known_price_mean known_price_sd l_quantity_mean l_quantity_sd"),
            "known_price_sum l_quantity_sum", 2),
        "weighted_mean_by_group": rounded(rounded(f"""{li}
            SELECT l_returnflag, count(*) AS n, sum(weight) AS weight_sum,
                   sum(weight * known_price) / sum(weight) AS weighted_mean
            FROM li WHERE known_price IS NOT NULL GROUP BY 1""", "weighted_mean"),
            "weight_sum", 2),
        "frequency_table": rounded(f"""{ev}
            SELECT kind, count(*) AS n, count(*) / (SELECT count(*) FROM ev) AS share
            FROM ev GROUP BY kind""", "share"),
        "crosstab": """
            SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS "F",
                   count(*) FILTER (l_linestatus = 'O') AS "O"
            FROM lineitem GROUP BY 1""",
        "pivot_group_means": rounded("""
            SELECT *, "mean_R" - "mean_A" AS mean_difference
            FROM (SELECT avg(l_extendedprice) FILTER (l_returnflag = 'R') AS "mean_R",
                         avg(l_extendedprice) FILTER (l_returnflag = 'A') AS "mean_A"
                  FROM lineitem)""", '"mean_R" "mean_A" mean_difference'),
        "group_total_window": rounded("""
            SELECT event_id, user_id, value, sum(value) OVER w AS group_total,
                   count(*) OVER w AS group_rows
            FROM events WINDOW w AS (PARTITION BY user_id)""", "value group_total"),
        "share_of_group_total": rounded(f"""{ev}
            SELECT event_id, kind, known_value,
                   known_value / sum(known_value) OVER (PARTITION BY kind) AS share
            FROM ev""", "known_value share", 9),
        "mean_of_ratios_vs_ratio_of_means": rounded("""
            SELECT l_returnflag, count(*) AS n, avg(l_discount) AS mean_top,
                   avg(l_tax) AS mean_bottom,
                   avg(CASE WHEN l_tax <> 0 THEN l_discount / l_tax END) AS mean_of_ratios,
                   avg(l_discount) / avg(l_tax) AS ratio_of_means,
                   sum(l_discount) / sum(l_tax) AS ratio_of_sums
            FROM lineitem GROUP BY 1""",
            "mean_top mean_bottom mean_of_ratios ratio_of_means ratio_of_sums"),
        "charge_counts": COUNTS + "SELECT * FROM counts",
        "charge_counts_first_rows": COUNTS + """
            SELECT * FROM counts ORDER BY person, category NULLS FIRST, dates LIMIT 10""",
        "charge_shares": rounded(COUNTS + """
            SELECT category, count(*) AS persons, avg(dates) AS mean_dates,
                   avg(total) AS mean_total, avg(dates / total) AS mean_share,
                   avg(categories) AS mean_categories
            FROM (SELECT *, sum(dates) OVER (PARTITION BY person) AS total,
                         count(*) OVER (PARTITION BY person) AS categories FROM counts)
            GROUP BY category""", "mean_dates mean_total mean_share mean_categories"),
        "charge_shares_many_attributes": rounded(f"""{ev},
            {ORDERS.strip()},
            arrests AS (
              SELECT DISTINCT user_id AS person, CAST(ts AS DATE) AS day, kind AS category,
                     o_orderstatus, priority
              FROM ev LEFT JOIN o ON o_custkey = user_id),
            totals AS (SELECT person, category, count(*) AS dates FROM arrests GROUP BY 1, 2),
            counts AS (
              SELECT a.person, a.category, t.dates
              FROM (SELECT DISTINCT person, category, o_orderstatus, priority FROM arrests) a
              JOIN totals t ON a.person = t.person
               AND a.category IS NOT DISTINCT FROM t.category)
            SELECT category, count(*) AS persons, avg(dates) AS mean_dates,
                   avg(total) AS mean_total, avg(dates / total) AS mean_share,
                   avg(categories) AS mean_categories
            FROM (SELECT *, sum(dates) OVER (PARTITION BY person) AS total,
                         count(*) OVER (PARTITION BY person) AS categories FROM counts)
            GROUP BY category""", "mean_dates mean_total mean_share mean_categories"),
        "prefixed_columns": rounded(rounded("""
            SELECT l_returnflag, count(*) AS lines_n, count(l_quantity) AS lines_l_quantity_count,
                   count(*) - count(l_quantity) AS lines_l_quantity_missing,
                   sum(l_quantity) AS lines_l_quantity_sum,
                   avg(l_quantity) AS lines_l_quantity_mean,
                   stddev_samp(l_quantity) AS lines_l_quantity_sd
            FROM lineitem GROUP BY 1""", "lines_l_quantity_mean lines_l_quantity_sd"),
            "lines_l_quantity_sum", 2),
        "five_number_summary": rounded(f"""{ev}
            SELECT kind, 'known_value' AS variable, {five_columns('q')}
            FROM (SELECT kind, quantile_cont(known_value, {FIVE}) AS q FROM ev GROUP BY kind)
            UNION ALL
            SELECT kind, 'user_id', {five_columns('q')}
            FROM (SELECT kind, quantile_cont(CAST(user_id AS DOUBLE), {FIVE}) AS q
                  FROM ev GROUP BY kind)""", " ".join(QUANTILES)),
        "quantiles_long": quantiles_long,
        "outlier_summary": rounded(f"{ev} {outlier_rows('ev', 'known_value')}", OUTLIERS),
        "outlier_summary_grouped": summary_grouped,
        "outlier_summary_many_vars": rounded(
            f"{li}, c AS (SELECT *, 42e0 AS constant FROM li) " + " UNION ALL ".join(
                outlier_rows("c", v, "l_linestatus")
                for v in ("l_extendedprice", "l_quantity", "constant")), OUTLIERS),
        "outlier_summary_from_sketches": rounded(
            f"{li}, c AS (SELECT *, 42e0 AS constant FROM li) " + " UNION ALL ".join(
                outlier_rows("c", v, "l_linestatus")
                for v in ("l_extendedprice", "l_quantity", "constant")), OUTLIERS),
        "null_outliers_both": nulled("known_value", "y <= low OR y >= high"),
        "null_outliers_upper": nulled("value", "y >= high"),
        "null_outliers_lower": nulled("negative_value", "y <= low"),
        "null_outliers_grouped": nulled("known_value", "y <= low OR y >= high", "kind"),
        "flag_outliers": f"""{ev}
            SELECT * FROM ({flags_of('known_value')}) JOIN ({flags_of('negative_value')})
            USING (event_id)""",
        "histogram_before_after": histogram(),
        "quantiles_long_brackets": quantiles_long,
        "outlier_summary_grouped_brackets": summary_grouped,
        "null_outliers_brackets": nulled("known_value", "y <= low OR y >= high", "kind"),
        "welch_t_test": simple_t_test("l_extendedprice", "'R'", "'A'"),
        "pooled_t_test": simple_t_test("l_extendedprice", "'R'", "'A'", "pooled"),
        "t_test_from_summary": summary_test("welch", null="100"),
        "t_test_from_summary_pooled": summary_test("pooled"),
        "t_ci_conservative_df": summary_test("conservative", Z90),
        "t_ci_level_per_row": level_per_row(),
        "t_test_ordered_groups": simple_t_test("known_price", "'A'", "'R'"),
        "weighted_t_test": weighted_test(True),
        "weighted_t_test_sum_n": weighted_test(False),
        "survey_t_test": survey_t_test(),
        "two_sample_means": rounded(f"{li} " + means_row(
            "known_price", "l_returnflag", "'R'", "'A'", "li", weight="weight",
            weights_used="true, true"), MEANS),
        "two_sample_means_equal_variance": rounded(f"{li} " + means_row(
            "known_price", "l_returnflag", "'R'", "'A'", "li", rule="pooled"), MEANS),
        "means_of_many_vars": many_means(None),
        "means_of_many_vars_weighted": many_means("weight"),
        "means_of_two_tables": two_tables(),
        "mean_test_method_comparison": method_comparison(),
        "ols_dummy": ols(),
        "wls_dummy": wls(),
        "ols_predictions": rounded(FITTED + """
            SELECT round(a + b * dearer, 9) AS predicted, dearer AS dear, count(*) AS n,
                   sum(pow(treated - a - b * dearer, 2)) AS squared_residuals
            FROM d, line GROUP BY 1, 2""", "predicted squared_residuals"),
        "ols_slope_se_from_residuals": rounded(FITTED + """
            SELECT count(*) AS n, sqrt(sum(pow(treated - a - b * dearer, 2)) / (count(*) - 2))
                   / sqrt(regr_sxx(treated, dearer)) AS std_error
            FROM d, line""", "std_error", 9),
        "two_proportion_pooled": two_proportions(),
        "two_proportion_pooled_weighted": two_proportions("weight"),
        "prop_test": prop_test(),
        "prop_test_yates": prop_test(yates=True),
        "prop_test_weighted_totals": prop_test("weight"),
        "prop_test_one_sample": one_sample(),
        "proportion_margin_of_error": rounded(f"""
            SELECT c_mktsegment, n, successes, proportion, std_error,
                   {Z99} * std_error AS margin_of_error,
                   proportion - {Z99} * std_error AS conf_int_lower,
                   proportion + {Z99} * std_error AS conf_int_upper
            FROM (SELECT *, sqrt(proportion * (1 - proportion) / n) AS std_error
                  FROM (SELECT c_mktsegment, count(*) AS n,
                               count(*) FILTER (c_acctbal < 0) AS successes,
                               count(*) FILTER (c_acctbal < 0) / count(*) AS proportion
                        FROM customer GROUP BY 1))""",
            "proportion std_error margin_of_error conf_int_lower conf_int_upper"),
        "required_sample_size": rounded(f"""{o}
            SELECT priority, count(large) AS n, avg(large) AS proportion,
                   avg(large) * (1 - avg(large)) / pow(0.05e0 / 1.96e0, 2) AS required_sample_size
            FROM o GROUP BY 1""", "proportion required_sample_size"),
        "wilson_interval": rounded(
            f"{o} {with_wilson(grouped('large', 'priority', 'o', 'weight'))}", ESTIMATES),
        "newcombe_difference": rounded(f"""{o}
            SELECT priority, n_x, n_y, p_x, p_y, p_x - p_y AS p_diff,
                   p_x - p_y - sqrt(pow(p_x - {wilson('w_x', 'p_x', '-')}, 2)
                     + pow({wilson('w_y', 'p_y', '+')} - p_y, 2)) AS conf_int_lower,
                   p_x - p_y + sqrt(pow({wilson('w_x', 'p_x', '+')} - p_x, 2)
                     + pow(p_y - {wilson('w_y', 'p_y', '-')}, 2)) AS conf_int_upper
            FROM (SELECT priority, count(*) FILTER (treated = 1) AS n_x,
                         count(*) FILTER (control = 1) AS n_y,
                         sum(weight) FILTER (treated = 1) AS w_x,
                         sum(weight) FILTER (control = 1) AS w_y,
                         sum(weight * large) FILTER (treated = 1) / w_x AS p_x,
                         sum(weight * large) FILTER (control = 1) / w_y AS p_y
                  FROM o WHERE large IS NOT NULL AND (treated = 1 OR control = 1)
                  GROUP BY priority)""",
            "p_x p_y p_diff conf_int_lower conf_int_upper"),
        "proportion_cv": rounded(
            f"{pa} {with_cv(grouped('oversized', 'p_brand', 'pa'), '1.645e0')}",
            ESTIMATES + " standard_error coeff_of_variation"),
        "suppression_flags": suppression(),
        "domain_vs_overall": rounded(f"{o} " + domain_table(
            "o", "priority", "large", "strict_confidential", settings(True, True, "sample")),
            DOMAIN_DOUBLES),
        "domain_vs_overall_weighted": rounded(f"{o} " + domain_table(
            "o", "priority", "large", "loose_open", settings(False, False, "population"),
            "weight", "1.645e0"), DOMAIN_DOUBLES),
        "domain_vs_overall_small_domains": rounded(f"{pa} " + domain_table(
            "pa", "p_brand", "oversized", "loose_confidential", settings(False, True, "sample")),
            DOMAIN_DOUBLES),
        "domain_vs_overall_many_domains": rounded(
            f"{o}, oy AS (SELECT *, CAST(year(o_orderdate) AS VARCHAR) AS year FROM o) "
            + " UNION ALL ".join(
                f"SELECT * FROM ({domain_table('oy', d, 'large', 'strict_confidential', settings(True, True, 'sample'), 'weight')})"
                for d in ("priority", "year", "o_orderstatus")), DOMAIN_DOUBLES),
        "treatment_control_report_many_domains": rounded(
            f"{o}, oq AS (SELECT *, CAST(quarter(o_orderdate) AS VARCHAR) AS quarter FROM o) "
            + " UNION ALL ".join(
                f"SELECT * FROM ({report('oq', d)})" for d in ("priority", "quarter")),
            " ".join(f"{s}_{c}" for s in SIDES for c in DOMAIN_DOUBLES.split())
            + f" {GAP}_p_weighted {GAP}_conf_int_lower {GAP}_conf_int_upper"),
        "treatment_control_report_refreshed":
            f"{o} SELECT {COMPACT} FROM ({report('o', 'priority')})",
        "treatment_control_report": f"{o} SELECT {COMPACT} FROM ({report('o', 'priority')})",
        "treatment_control_report_expanded": rounded(
            f"{o} {report('o', 'priority')}",
            " ".join(f"{s}_{c}" for s in SIDES for c in DOMAIN_DOUBLES.split())
            + f" {GAP}_p_weighted {GAP}_conf_int_lower {GAP}_conf_int_upper"),
        "treatment_control_report_small_domains": f"""{o},
            oc AS (SELECT o.*, CAST(c_nationkey AS VARCHAR) AS nation
                   FROM o JOIN customer ON c_custkey = o_custkey)
            SELECT {COMPACT} FROM ({report('oc', 'nation')})""",
        "stratified_proportion_moe": rounded(f"""{sample}
            SELECT n, strata, proportion, variance, sqrt(variance) AS std_error,
                   1.96e0 * sqrt(variance) AS margin_of_error
            FROM (SELECT CAST(any_value(total) AS BIGINT) AS n, count(*) AS strata,
                         sum(x_h) / any_value(total) AS proportion,
                         sum(pow(n_h / total, 2) * variance_h) AS variance
                  FROM (SELECT *, sum(n_h) OVER () AS total FROM ({STRATUM_PARTS})))""",
            "proportion variance std_error margin_of_error", 9),
        "stratum_variances": rounded(
            f"{sample} {STRATUM_PARTS}", "population_h p_h variance_h", 9),
        "survey_mean_stratified": rounded(f"""{sample}
            SELECT CAST(sum(n_h) AS BIGINT) AS n, count(*) AS strata, any_value(m) AS mean,
                   sqrt(sum((1 - n_h / population) * n_h / (n_h - 1) * ss)) AS std_error
            FROM (SELECT lang, count(*) AS n_h, any_value(population) AS population,
                         any_value(m) AS m, sum(pow(z - zbar, 2)) AS ss
                  FROM (SELECT *, avg(z) OVER (PARTITION BY lang) AS zbar
                        FROM (SELECT *, weight * (toxic - m) / total AS z
                              FROM sample, (SELECT sum(weight * toxic) / sum(weight) AS m,
                                                   sum(weight) AS total FROM sample)))
                  GROUP BY lang)""", "mean std_error", 9),
        "survey_mean_unstratified": rounded(f"""{li}
            SELECT count(*) AS n, CAST(1 AS BIGINT) AS strata, any_value(m) AS mean,
                   sqrt(count(*) / (count(*) - 1) * sum(pow(z - zbar, 2))) AS std_error
            FROM (SELECT *, avg(z) OVER () AS zbar
                  FROM (SELECT *, weight * (known_price - m) / total AS z
                        FROM li, (SELECT sum(weight * known_price) / sum(weight) AS m,
                                         sum(weight) AS total FROM li
                                  WHERE known_price IS NOT NULL)
                        WHERE known_price IS NOT NULL))""", "mean std_error"),
        **clustered_queries(o, li),
        **factor_queries(li),
        **sampling_queries(),
        "strata_overview": rounded(f"""{sample}
            SELECT count(*) AS n, sum(weight) AS sum_of_weights,
                   count(DISTINCT lang) AS strata, avg(toxic) AS unweighted_share
            FROM sample""", "sum_of_weights unweighted_share"),
        "stratified_split": f"""
            SELECT c_custkey, c_mktsegment,
                   CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY h, c_custkey)
                             <= ceil(0.5e0 * count(*) OVER (PARTITION BY c_mktsegment))
                        THEN 1 ELSE 0 END AS in_first
            FROM (SELECT *, md5(c_custkey || '|123') AS h FROM customer)""",
        "grid_weights": rounded(f"""
            SELECT event_id, 1 + ({draw('event_id', 123)} % 11) * 0.1e0 AS weight
            FROM events""", "weight"),
    }
