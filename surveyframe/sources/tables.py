"""Reading input tables.  Results are DataFrames; the caller writes them where it likes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(
    spark: SparkSession, folder: str, name: str, *,
    kind: str = "parquet", schema: T.StructType | str | None = None,
) -> DataFrame:
    """One table of a folder, as Parquet, ORC or delimited text with a header.

    Text needs a schema: inferring one would read the whole file an extra time.
    """
    path = f"{folder.rstrip('/')}/{name}.{kind}"
    if kind in ("parquet", "orc"):
        reader = spark.read.format(kind)
        return (reader.schema(schema) if schema else reader).load(path)
    if kind == "csv":
        if schema is None:
            raise ValueError("a csv table needs a schema")
        return spark.read.schema(schema).csv(path, header=True)
    raise ValueError(f"kind must be parquet, orc or csv, not {kind!r}")
