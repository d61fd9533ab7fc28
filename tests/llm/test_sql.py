"""The queries of this subpackage that SQL can express, against DuckDB."""

from __future__ import annotations

import compare
import pytest

from surveyframe.llm import registered

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
         "double": "DOUBLE"}


@pytest.mark.parametrize("name", sorted(set(registered.ORACLE_SQL) - {"op5_mixing"}))
def test_matches_oracle(spark, data, name):
    found = registered.QUERIES[name](spark, data)
    duck = compare.duck(data)
    assert compare.spark_rows(found) == compare.duck_rows(duck, registered.ORACLE_SQL[name])
    described = duck.execute(registered.ORACLE_SQL[name]).description
    assert {f.name: TYPES[f.dataType.simpleString()] for f in found.schema.fields} == {
        d[0]: str(d[1]) for d in described}
    duck.close()
