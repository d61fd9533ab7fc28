"""Every registered query against the same query in DuckDB."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
import compare
from workload import oracle, queries as registered

QUERIES = registered.all_queries()
ORACLE = oracle.all_sql()
DUCK_TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "int": "INTEGER", "string": "VARCHAR",
              "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(data):
    connection = compare.duck(data)
    yield connection
    connection.close()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert QUERIES.items() <= entry.queries().items()
    assert ORACLE.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, data, duck, name):
    found = QUERIES[name](spark, data)
    expected_columns, expected = compare.duck_rows(duck, ORACLE[name])
    columns, rows = compare.spark_rows(found)
    assert columns == expected_columns
    assert rows == expected
    assert rows

    check_plan(found)
    types = {f.name: DUCK_TYPES[f.dataType.simpleString()] for f in found.schema.fields}
    described = duck.execute(ORACLE[name]).description
    assert types == {d[0]: str(d[1]) for d in described}


def check_plan(df):
    """No cross join, no Python, and no window over the whole table in one task."""
    text = df._jdf.queryExecution().executedPlan().toString()
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython",
                 "InPandas"):
        assert word not in text
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"[-+] (\*\(\d+\) )?Window \[", line):
            assert not any("SinglePartition" in below for below in lines[i + 1:i + 4]), line


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
