"""Outlier summaries with the help of stored sketches equal those without, to the last bit."""

from __future__ import annotations

import compare
import pytest
from pyspark.sql import functions as F

import surveyframe as sf
from surveyframe.plans import sketches

VARIABLES = ["value", "ties", "same", "v.w"]


@pytest.fixture(scope="module")
def table(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    return events.select(
        F.when(F.col("event_id") % 3 == 0, "hot").otherwise(
            F.nullif(F.col("event_type"), F.lit("error"))).alias("my kind"),
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value"),
        (F.col("event_id") % 5).alias("ties"), F.lit(3.0).alias("same"),
        F.when(F.col("event_type") == "click", F.pow(F.col("value"), 3)).alias("v.w"),
        (F.col("event_id") % 4).alias("day"))


def plain(df):
    return compare.rows_of(df.columns, df.collect())


@pytest.fixture
def small_sketches(monkeypatch):
    """Sketches of so few values that their brackets cut off most rows of the test tables."""
    monkeypatch.setattr(sketches, "SKETCH_SIZE", 800)
    monkeypatch.setattr(sketches, "FEW_ROWS", 800)
    monkeypatch.setattr(sketches, "_MARGIN", 4 * 2.296 / 800 ** 0.9723 + 2 / 800)


@pytest.mark.parametrize("by", [None, "my kind", ["my kind", "day"]])
def test_equal_to_the_summary_without_sketches(table, tmp_path, small_sketches, by):
    path = str(tmp_path / "sketches")
    sf.store_sketches(table, path, VARIABLES, by, part="day")
    found = sf.outlier_summary_from_sketches(table, path, VARIABLES, by)
    wanted = sf.outlier_summary(table, VARIABLES, by)
    assert found.columns == wanted.columns
    assert plain(found) == plain(wanted)


def test_brackets_of_large_groups_are_closed_in_further(table, tmp_path, small_sketches):
    path = str(tmp_path / "sketches")
    sf.store_sketches(table, path, VARIABLES, "my kind", part="day")
    found = sf.outlier_summary_from_sketches(table, path, VARIABLES, "my kind", buffer_rows=50)
    assert plain(found) == plain(sf.outlier_summary(table, VARIABLES, "my kind"))


def test_most_rows_are_counted_in_bulk(spark, table, tmp_path, small_sketches):
    path = str(tmp_path / "sketches")
    sf.store_sketches(table, path, ["value"], part="day")
    cells, _ = sketches.summary_cells(table, path, ["value"], [], 1.5)
    held = cells.agg(F.sum("held"), F.count_if(F.col("single").isNotNull())).first()
    assert held[0] == table.filter("value IS NOT NULL").count()
    assert held[1] < 0.4 * held[0]


def test_new_parts_and_corrected_ones(table, tmp_path, small_sketches):
    path = str(tmp_path / "sketches")
    wrong = table.withColumn("value", F.col("value") * 1000 - 5)
    for arrived in (wrong.filter("day < 2"), table.filter("day >= 2"), table.filter("day < 2")):
        sf.store_sketches(arrived, path, ["value"], "my kind", part="day")
    found = sf.outlier_summary_from_sketches(table, path, "value", "my kind")
    assert plain(found) == plain(sf.outlier_summary(table, "value", "my kind"))


def test_sketches_of_other_data_stop_the_job(table, tmp_path, small_sketches):
    path = str(tmp_path / "sketches")
    sf.store_sketches(table.withColumn("value", F.col("value") * 1000 + 1e6), path, "value", part="day")
    with pytest.raises(Exception, match="outside its bracket"):
        sf.outlier_summary_from_sketches(table, path, "value").collect()


def test_few_rows_and_none(spark, tmp_path):
    rows = [("a", 1.0), ("a", 2.0), ("a", None), ("b", None), (None, 4.0), (None, float("nan"))]
    few = spark.createDataFrame(rows, "g string, v double").withColumn("p", F.lit(1))
    path = str(tmp_path / "few")
    sf.store_sketches(few, path, "v", "g", part="p")
    found = sf.outlier_summary_from_sketches(few, path, "v", "g")
    assert plain(found) == plain(sf.outlier_summary(few, "v", "g"))
    with pytest.raises(ValueError, match="rename grouping"):
        sf.outlier_summary_from_sketches(few.withColumnRenamed("g", "q0"), path, "v", "q0")
