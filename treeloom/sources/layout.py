"""How an input is laid out in files, and what that means for its first stage."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_total

# Setting that deals every input's rows over the session's cores.
SPREAD = "spark.treeloom.spread"


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a URI such as ``file:/a/b`` or ``s3://bucket/key``."""
    return fs.FileSystem.from_uri(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over all cores before text-heavy work, where the session asks for it.

    Inputs of one row group, as in tests and benchmarks, leave most cores idle; inputs of any
    real size fill a cluster with their own splits, so a cluster leaves this off.
    """
    session = df.sparkSession
    if session.conf.get(SPREAD, "false") != "true":
        return df
    return df.repartition(session.sparkContext.defaultParallelism)


def dealt_by_bytes(df: DataFrame, size: str, order: list[str], task_bytes: int) -> DataFrame:
    """``df`` in tasks of about ``task_bytes`` bytes each, by a running sum of ``size`` along
    ``order`` (its last column unique): neighbours stay together, the number of tasks follows the
    bytes, and a task is over the mark by less than its last row."""
    placed = running_total(df, [], order, size, "_upto")
    # A row belongs to the task in which it begins.
    task = F.floor((F.col("_upto") - F.coalesce(F.col(size), F.lit(0))) / task_bytes).cast("int")
    placed = placed.withColumn("_task", task)
    last = placed.agg(F.max("_task")).first()[0]
    if last is None:
        return df
    return placed.repartitionById(last + 1, F.col("_task")).sortWithinPartitions(*order).drop("_upto", "_task")
