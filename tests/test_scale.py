"""What keeps the operators usable on large and skewed tables."""

from __future__ import annotations

import uuid

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from surveyframe.operators import (
    domains, means, outliers, ratios, report, sampling, tables,
)
from surveyframe.plans import attach, quantiles as plan, store
from workload import queries

PROBABILITIES = [0.0, 0.1, 0.25, 0.251, 0.5, 0.75, 0.99, 1.0]


def executed(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def scans(spark, df, rows: int) -> int:
    """How often a table of so many rows was read, from the records the stages took in.

    The single row that carries the totals of a domain test counts as a record too.
    """
    context = spark.sparkContext
    context.setJobGroup("before", "the last stage before the query")
    spark.range(1).count()
    tracker = context.statusTracker()
    stage = 1 + max(
        s for job in tracker.getJobIdsForGroup("before") for s in tracker.getJobInfo(job).stageIds)
    context.setLocalProperty("spark.jobGroup.id", None)

    df.collect()
    context._jsc.sc().listenerBus().waitUntilEmpty()
    store = context._jsc.sc().statusStore()
    taken, absent = 0, 0
    while absent < 50:
        try:
            taken += store.lastStageAttempt(stage).inputRecords()
            absent = 0
        except Py4JJavaError:  # a stage that was skipped or does not exist
            absent += 1
        stage += 1
    times, rest = divmod(taken, rows)
    assert rest <= 1
    return times


# --- exact quantiles of large groups -----------------------------------------

@pytest.fixture(scope="module")
def skewed(spark, data):
    """A third of all rows in one group, ties, missing values and an empty group."""
    events = spark.read.parquet(f"{data}/events.parquet")
    hot = F.when(F.col("user_id") < 50, -1).otherwise(F.col("user_id") % 7)
    return events.select(
        F.when(hot != 3, hot).alias("g"), "value",
        F.when(F.col("value") < 30, 30.0).otherwise(F.floor(F.col("value") / 10)).alias("tied"),
        F.when(hot != 2, F.col("value")).alias("partly"),
    ).repartition(12)


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("small_group, rows_per_salt", [
    (10**9, 10**9), (2_000, 10**9), (2_000, 500), (5, 300)])
def test_quantiles_match_numpy(skewed, monkeypatch, by, small_group, rows_per_salt):
    monkeypatch.setattr(plan, "ROWS_PER_SALT", rows_per_salt)
    variables = ["value", "tied", "partly"]
    found = plan.quantiles(skewed, variables, PROBABILITIES, by, small_group=small_group)
    local = skewed.toPandas()
    groups = local.groupby("g", dropna=False) if by else [("all", local)]
    expected = {
        (None if by and np.isnan(key) else key): rows for key, rows in groups}
    rows = {(r.g if by else "all"): r for r in found.collect()}
    assert set(rows) == set(expected)
    for key, group in expected.items():
        for i, variable in enumerate(variables):
            present = group[variable].dropna().to_numpy()
            if len(present) == 0:
                assert rows[key][f"__q{i}"] is None
            else:
                assert rows[key][f"__q{i}"] == pytest.approx(
                    np.quantile(present, PROBABILITIES), rel=1e-12)


def test_large_groups_give_the_same_outliers(spark, data):
    events = queries.events(spark, data)
    usual = outliers.outlier_summary(events, ["known_value", "user_id"], "kind").collect()
    large = outliers.outlier_summary(
        events, ["known_value", "user_id"], "kind", buffer_rows=100).collect()
    key = lambda r: (r.var, str(r.kind))
    assert list(map(tuple, sorted(usual, key=key))) == list(map(tuple, sorted(large, key=key)))


def test_approximate_quantiles_are_near(skewed):
    exact = plan.quantiles(skewed, ["value"], [0.5]).first()["__q0"][0]
    near = plan.approximate_quantiles(skewed, ["value"], [0.5]).first()["__q0"][0]
    assert near == pytest.approx(exact, rel=0.02)


def test_approximate_outliers_are_near(skewed):
    exact = outliers.outlier_summary(skewed, "value").first()
    near = outliers.outlier_summary(skewed, "value", approximate=True).first()
    assert near.upper_outlier_threshold == pytest.approx(exact.upper_outlier_threshold, rel=0.02)
    assert near.upper_outlier_count == pytest.approx(exact.upper_outlier_count, rel=0.05)


@pytest.fixture(scope="module")
def on_fences(spark):
    """Groups whose quartiles are interpolated, with a value that stands on each fence."""
    rng = np.random.default_rng(8)
    rows = []
    for group in range(60):
        values = rng.integers(0, 400, 41) / 7.0
        q1, q3 = np.percentile(values, [25, 75])
        rows += [(group, float(v)) for v in (*values, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))]
    table = spark.createDataFrame(rows, "g int, v double")
    fenced = outliers.outlier_summary(table, "v", "g").select(
        "g", "lower_outlier_threshold", "upper_outlier_threshold").collect()
    rows += [(r.g, x) for r in fenced for x in tuple(r)[1:]]
    return spark.createDataFrame(rows, "g int, v double").repartition(6)


@pytest.mark.parametrize("buffer_rows", [5, 20])
def test_outliers_do_not_depend_on_the_size_of_a_group(on_fences, buffer_rows):
    """Both ways agree to the last bit, on values at the fences too."""
    def rows(df):
        return sorted(map(tuple, df.collect()), key=str)

    for found in (
            lambda **o: outliers.five_number_summary(on_fences, "v", "g", **o),
            lambda **o: outliers.quantiles_long(on_fences, "v", "g", **o),
            lambda **o: outliers.outlier_summary(on_fences, "v", "g", **o),
            lambda **o: outliers.null_outliers(on_fences, "v", "both", "g", **o),
            lambda **o: outliers.flag_outliers(on_fences, "v", "g", **o)):
        assert rows(found()) == rows(found(buffer_rows=buffer_rows))
    assert rows(outliers.outlier_histogram(on_fences, "v")) == rows(
        outliers.outlier_histogram(on_fences, "v", buffer_rows=buffer_rows))


def jobs(spark, run) -> int:
    context = spark.sparkContext
    group = f"counted-{uuid.uuid4().hex}"
    context.setJobGroup(group, "the jobs of one call")
    run()
    count = len(context.statusTracker().getJobIdsForGroup(group))
    context.setLocalProperty("spark.jobGroup.id", None)
    return count


def test_all_large_groups_need_no_marks(spark, on_fences, monkeypatch):
    def summary(buffer_rows):
        return jobs(spark, lambda: outliers.five_number_summary(
            on_fences, "v", "g", buffer_rows=buffer_rows).collect())

    mixed = on_fences.unionByName(spark.createDataFrame([(-1, 1.0)], on_fences.schema))
    some = jobs(spark, lambda: outliers.five_number_summary(
        mixed, "v", "g", buffer_rows=20).collect())
    assert summary(20) < some


# --- shares within persons ----------------------------------------------------

def test_hot_person_is_not_gathered(spark):
    """One person holds a third of all rows, in many categories."""
    rows = spark.range(3_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("person"),
        (F.col("id") % 500).alias("category"), (F.col("id") % 7 + 1).alias("dates"),
        F.lit(1).cast("bigint").alias("sets"))
    found = ratios.category_shares(rows)
    assert "Window" not in executed(found)
    local = rows.toPandas()
    total = local.groupby("person")["dates"].transform("sum")
    local["share"] = local["dates"] / total
    expected = local.groupby("category")["share"].mean()
    for r in found.collect():
        assert r.mean_share == pytest.approx(expected[r.category], rel=1e-12)


def test_listed_counts_hold_no_long_list(spark, monkeypatch):
    monkeypatch.setattr(ratios, "LISTED_AT_ONCE", 10)
    counts = spark.createDataFrame(
        [("a", "x", 5, n) for n in (1, 9, 10, 11, 99, 100, 101, 999)],
        "person string, category string, dates bigint, sets bigint")
    assert ratios.listed_counts(counts).count() == 1 + 9 + 10 + 11 + 99 + 100 + 101 + 999


# --- statistics back on rows --------------------------------------------------

@pytest.mark.parametrize("limit, join", [
    (attach.BROADCAST_BYTES, "BroadcastHashJoin"), (0, "SortMergeJoin")])
def test_group_statistics_join_by_size(spark, limit, join):
    rows = spark.createDataFrame(
        [("a", 1.0), ("a", 2.0), (None, 5.0), ("b", None)], "k string, v double")
    stats = attach.kept(rows.groupBy("k").agg(F.sum("v").alias("total")))
    joined = attach.join_groups(rows, stats, ["k"], broadcast_bytes=limit)
    assert joined.columns == ["k", "v", "total"]
    assert sorted(map(str, joined.collect())) == sorted(map(str, [
        r for r in rows.withColumn("total", F.when(F.col("k") == "a", 3.0).when(
            F.col("k").isNull(), 5.0)).collect()]))
    assert join in executed(joined)


def test_size_counts_long_texts(spark):
    short = spark.createDataFrame([("a", 1.0)] * 10, "k string, v double")
    long = spark.createDataFrame([("a" * 10_000, 1.0)] * 10, "k string, v double")
    assert attach.stored_bytes(short) < 1_000 < 100_000 < attach.stored_bytes(long)
    assert attach.stored_bytes(short.limit(0)) == 0


def test_size_counts_binary_arrays_and_maps(spark):
    long = spark.range(10).select(
        F.lit("a" * 10_000).cast("binary").alias("binary"),
        F.array(F.lit("a" * 10_000)).alias("texts"),
        F.create_map(F.lit("a" * 10_000), F.lit(1)).alias("map"))
    for column in long.columns:
        assert attach.stored_bytes(long.select(column)) > 100_000


def test_kept_tables_lie_in_the_checkpoint_folder(spark):
    kept = attach.kept(spark.range(10).groupBy((F.col("id") % 2).alias("k")).count())
    folder = spark.conf.get("spark.checkpoint.dir")
    assert all(folder in file for file in kept.inputFiles())
    assert sorted(map(tuple, kept.collect())) == [(0, 5), (1, 5)]


class Settings(dict):
    """Stands for a session where only the configuration is read."""

    @property
    def conf(self):
        return self


def test_folder_of_intermediate_tables():
    warehouse = {"spark.sql.warehouse.dir": "hdfs://a/warehouse"}
    assert store.folder(Settings(warehouse)) == "hdfs://a/warehouse/_intermediate"
    cluster = warehouse | {"spark.master": "spark://a:7077"}
    named = {"spark.checkpoint.dir": "s3a://bucket/folder/"}
    assert store.folder(Settings(cluster | named)) == "s3a://bucket/folder"
    with pytest.raises(ValueError, match="scheme"):
        store.folder(Settings(cluster | {"spark.checkpoint.dir": "/tmp/folder"}))
    own_disks = {"spark.master": "yarn", "spark.sql.warehouse.dir": "file:/home/me/spark-warehouse"}
    with pytest.raises(ValueError, match="scheme"):
        store.folder(Settings(own_disks))
    mounted = own_disks | {"spark.checkpoint.dir": "file:///mounted/everywhere"}
    assert store.folder(Settings(mounted)) == "file:///mounted/everywhere"
    shared = cluster | {
        "spark.checkpoint.dir": "/folder", "spark.hadoop.fs.defaultFS": "hdfs://a:9000"}
    assert store.folder(Settings(shared)) == "/folder"


def test_folder_on_a_cluster_of_one_machine():
    one_machine = {"spark.master": "local-cluster[3,2,3000]",
                   "spark.sql.warehouse.dir": "file:/home/me/spark-warehouse"}
    assert store.folder(Settings(one_machine)) == "file:/home/me/spark-warehouse/_intermediate"
    named = one_machine | {"spark.checkpoint.dir": "/tmp/checkpoints/"}
    assert store.folder(Settings(named)) == "/tmp/checkpoints"


@pytest.fixture
def on_a_cluster(spark, monkeypatch):
    """Sets what the session says of its master, its folder and its warehouse."""
    known = type(spark.conf).get

    def named(folder, warehouse="file:/none"):
        said = {"spark.master": "spark://a:7077", "spark.checkpoint.dir": folder,
                "spark.sql.warehouse.dir": warehouse}
        monkeypatch.setattr(type(spark.conf), "get", lambda conf, key, *default: (
            said[key] if key in said else known(conf, key, *default)))
    return named


def test_a_shared_folder_without_a_scheme_serves_a_cluster(spark, on_a_cluster, tmp_path):
    on_a_cluster(str(tmp_path / "shared"))
    for _ in range(2):  # it is tried out once
        kept = attach.kept(spark.range(10).groupBy((F.col("id") % 2).alias("k")).count())
        assert sorted(map(tuple, kept.collect())) == [(0, 5), (1, 5)]
    assert len(list((tmp_path / "shared").glob("tried-*"))) == 1
    on_a_cluster(None, f"file:{tmp_path}/warehouse")
    assert store.folder(spark) == f"file:{tmp_path}/warehouse/_intermediate"


def test_a_folder_that_is_not_shared_is_refused_on_a_cluster(spark, on_a_cluster, tmp_path, monkeypatch):
    on_a_cluster("/proc/nowhere")
    with pytest.raises(ValueError, match="every executor"):
        store.folder(spark)
    # Two files that stayed on the disk of another machine.
    read = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda reader, *paths: (
        read(reader, *paths).where("id > 1")))
    on_a_cluster(str(tmp_path))
    for _ in range(2):
        with pytest.raises(ValueError, match="every executor"):
            store.folder(spark)


# --- plans --------------------------------------------------------------------

SCANS = {
    "welch_t_test": ("lineitem", 1), "means_of_many_vars": ("lineitem", 1),
    "weighted_t_test": ("lineitem", 1), "means_of_many_vars_weighted": ("lineitem", 1),
    "mean_test_method_comparison": ("lineitem", 3), "wls_dummy": ("lineitem", 1),
    "ols_dummy": ("lineitem", 1), "domain_vs_overall_weighted": ("orders", 1),
    "domain_vs_overall_many_domains": ("orders", 1),
    "treatment_control_report_many_domains": ("orders", 1),
    "survey_ratio": ("lineitem", 2),
    "treatment_control_report_expanded": ("orders", 1), "frequency_table": ("events", 1),
    "survey_mean_unstratified": ("lineitem", 2), "two_proportion_pooled": ("orders", 2),
    "ols_predictions": ("orders", 3),
}


@pytest.mark.parametrize("name", sorted(SCANS))
def test_number_of_scans(spark, data, name):
    table, expected = SCANS[name]
    rows = spark.read.parquet(f"{data}/{table}.parquet").count()
    assert scans(spark, queries.all_queries()[name](spark, data), rows) == expected


def test_group_filter_and_columns_reach_the_scan(spark, data):
    text = executed(queries.welch_t_test(spark, data))
    assert "In(l_returnflag, [A,R])" in text
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string>" in text


def test_cost_does_not_grow_with_the_number_of_domains(spark, data):
    parts = queries.parts(spark, data)
    rows = parts.count()
    few = domains.domain_vs_overall(parts, "p_brand", "oversized")
    many = domains.domain_vs_overall(parts, "p_partkey", "oversized")
    assert scans(spark, few, rows) == scans(spark, many, rows) == 1
    assert many.count() == rows + 1


# --- sampling -----------------------------------------------------------------

@pytest.mark.parametrize("proportion", [0.5, 0.1, 0.999])
def test_split_is_exact_in_every_stratum(spark, proportion):
    rows = spark.range(20_000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 9, None).otherwise(
            (F.col("id") % 40).cast("string")).alias("s"))
    split = sampling.stratified_split(rows, "s", "id", proportion=proportion)
    found = split.groupBy("s").agg(
        F.count("*").alias("n"), F.sum("in_first").alias("first")).collect()
    assert sum(r.n for r in found) == 20_000
    for r in found:
        assert r.first == int(np.ceil(r.n * proportion)), r


def test_split_refuses_missing_and_repeated_keys(spark):
    missing = spark.range(100).select(F.when(F.col("id") >= 60, F.col("id")).alias("k"))
    with pytest.raises(Exception, match="must not be NULL"):
        sampling.stratified_split(missing, [], "k").collect()
    repeated = spark.range(100).select(F.lit(7).alias("k"), (F.col("id") % 2).alias("s"))
    with pytest.raises(Exception, match="must be unique"):
        sampling.stratified_split(repeated, "s", "k").collect()


def test_split_does_not_depend_on_partitions_and_depends_on_the_seed(spark):
    rows = spark.range(500).select("id", (F.col("id") % 4).alias("s"))

    def chosen(table, seed):
        split = sampling.stratified_split(table, "s", "id", seed=seed)
        return {r.id for r in split.filter("in_first = 1").collect()}

    assert chosen(rows.repartition(1), 1) == chosen(rows.repartition(9), 1)
    assert chosen(rows, 1) != chosen(rows, 2)


def test_grid_weights_cover_the_grid(spark):
    drawn = spark.range(5_000).select(sampling.grid_weight("id", 1).alias("w"))
    counts = {round(r.w, 6): r["count"] for r in drawn.groupBy("w").count().collect()}
    assert sorted(counts) == [round(1 + k / 10, 6) for k in range(11)]
    assert min(counts.values()) > 350


# --- arguments ----------------------------------------------------------------

def test_unknown_and_textual_columns_are_refused(lineitem):
    with pytest.raises(ValueError, match="unknown column"):
        means.welch_t_test(lineitem, "nothing", "l_returnflag", "R", "A")
    with pytest.raises(ValueError, match="unknown column"):
        means.weighted_t_test(
            lineitem, "l_quantity", "l_returnflag", "R", "A", "weights_x")
    with pytest.raises(ValueError, match="must be numeric"):
        means.welch_t_test(lineitem, "l_linestatus", "l_returnflag", "R", "A")
    with pytest.raises(ValueError, match="different levels"):
        means.welch_t_test(lineitem, "l_quantity", "l_returnflag", "R", "R")


def test_bad_options_are_refused(orders, lineitem):
    with pytest.raises(ValueError, match="which must be"):
        outliers.null_outliers(orders, "o_totalprice", "middle")
    with pytest.raises(ValueError, match="kind must be"):
        domains.domain_vs_overall(orders, "priority", "large", kind="census")
    with pytest.raises(ValueError, match="df_rule"):
        means.t_test(lineitem, "l_quantity", "l_returnflag", ("R", "A"), df_rule="exact")
    with pytest.raises(ValueError, match="already has"):
        tables.group_total(orders, "o_totalprice", "priority", total="weight")
    with pytest.raises(ValueError, match="unknown column"):
        report.treatment_control_report(
            orders, "nowhere", treatment="treated", control="control", first_outcome="large",
            second_outcome="medium", control_outcome="medium", weight="weight")


def test_read_table_formats(spark, tmp_path):
    from surveyframe.sources import read_table

    source = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    source.write.parquet(str(tmp_path / "t.parquet"))
    source.write.orc(str(tmp_path / "t.orc"))
    source.write.option("header", True).csv(str(tmp_path / "t.csv"))
    for kind in ("parquet", "orc", "csv"):
        schema = "id int, name string" if kind == "csv" else None
        found = read_table(spark, str(tmp_path), "t", kind=kind, schema=schema)
        assert sorted(map(tuple, found.collect())) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError, match="schema"):
        read_table(spark, str(tmp_path), "t", kind="csv")
    with pytest.raises(ValueError, match="kind"):
        read_table(spark, str(tmp_path), "t", kind="dta")
