"""Tables that a job writes on its way and reads again.

They lie in the folder that the cluster names in ``spark.checkpoint.dir``.  Where
that is unset they lie beside the tables of the session's warehouse, which all
executors share by definition.  A written table survives the loss of executors,
cuts the lineage, and is read by the columns that a step needs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


# Folders that were tried out, by application and path, with the executors of that time.
_tried: dict[tuple[str, str], set[str]] = {}


def folder(spark: SparkSession) -> str:
    """Where intermediate tables go.

    On a cluster of several machines a path without a scheme, or a default with ``file:``, may be
    mounted everywhere or be each machine's own disk.  A small table written there by two tasks a core
    tells which; a folder in which part of it is missing is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    # The executors of a local cluster are processes of this machine and see its files.
    local = spark.conf.get("spark.master", "local").split("[")[0] in ("local", "local-cluster")
    if not local:
        default = spark.conf.get("spark.hadoop.fs.defaultFS", "file:///")
        bare = ":" not in named and default.startswith("file:")
        # A folder that the cluster names with its scheme is taken as it is.
        unnamed = spark.conf.get("spark.checkpoint.dir", None) is None and named.startswith("file:")
        if bare or unnamed:
            _try_out(spark, named.rstrip("/"))
    return named.rstrip("/")


def _try_out(spark: SparkSession, path: str) -> None:
    """Stop unless what the executors write into ``path`` can be read; again when there are new ones."""
    try:
        context = spark.sparkContext
        executors = set(context._jsc.sc().getExecutorMemoryStatus().keys().mkString(" ").split())
        tried = _tried.setdefault((context.applicationId, path), set())
        if executors <= tried:
            return
        tasks = 2 * max(context.defaultParallelism, len(executors))
        probe = f"{path}/tried-{uuid.uuid4().hex}"
        spark.range(0, tasks, 1, tasks).write.parquet(probe)
        found = spark.read.schema("id long").parquet(probe).count()
        if found != tasks:
            raise OSError(f"{found} of {tasks} rows arrived in {probe}")
        tried |= executors
    except Exception as error:
        raise ValueError(
            f"intermediate tables cannot be kept in {path!r}: name spark.checkpoint.dir with its"
            " scheme, as a folder that every executor can reach") from error


def stored(df: DataFrame, label: str = "table") -> DataFrame:
    """``df`` computed now, written as Parquet and read again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
