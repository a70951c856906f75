"""Directory walks that see directories.

A walk goes down level by level: each round lists the directories found by the round before, one
row each, spread over the cluster, and a pruned name is never descended into. So a wide tree is
listed by many tasks, a deep one takes as many rounds as it has levels, and a directory is seen
whether it holds anything or not. Contents are read afterwards, in tasks of equal bytes.

A directory that cannot be listed, or went away, is a row with its error; so is such a file.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import base_name, extension, is_pruned
from ..session import durable
from .layout import dealt_by_bytes, open_path

ENTRY_DDL = "path STRING, is_dir BOOLEAN, size BIGINT, listed BOOLEAN, entries BIGINT, error STRING"
COLUMNS = ["path", "is_dir", "size", "listed", "entries", "error"]
# Bytes of files read by one task, and what opening a file costs beside them.
TASK_BYTES = 64 * 1024 * 1024
FILE_COST = 4096
# Rows and bytes handed over per batch.
BATCH_ROWS = 10_000
BATCH_BYTES = 32 * 1024 * 1024


def _list(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, plain = open_path(root)
        rows: list[tuple] = []
        for batch in batches:
            for path in batch["path"]:
                here = f"{plain}/{path}" if path else plain
                try:
                    found = system.get_file_info(fs.FileSelector(here))
                except OSError as problem:
                    found = []
                    rows.append((path, True, None, True, 0, f"{type(problem).__name__}: {problem}"))
                else:
                    rows.append((path, True, None, True, len(found), None))
                for entry in found:
                    is_dir = entry.type == fs.FileType.Directory
                    below = f"{path}/{entry.base_name}" if path else entry.base_name
                    rows.append((below, is_dir, None if is_dir else entry.size, False, None, None))
                    if len(rows) >= BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=COLUMNS)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=COLUMNS)

    return run


def walk(spark: SparkSession, root: str) -> DataFrame:
    """Every directory and file below ``root``: path (relative to it), is_dir, size, entries (of
    a directory, pruned ones not counted) and error. The root's own name is never tested."""
    listed, frontier = [], spark.createDataFrame([("",)], "path string")
    while True:
        tasks = spark.sparkContext.defaultParallelism
        found = durable(frontier.repartition(tasks).mapInPandas(_list(root), ENTRY_DDL))
        found = found.filter(F.col("listed") | ~is_pruned(base_name(F.col("path"))))
        listed.append(found)
        frontier = found.filter(F.col("is_dir") & ~F.col("listed")).select("path")
        if frontier.isEmpty():
            break
    every = reduce(DataFrame.unionByName, listed)
    # A directory has a row as an entry and, a round later, one of its own.
    files = every.filter(~F.col("is_dir")).select("path", "is_dir", "size", F.lit(None).cast("bigint").alias("entries"), "error")
    dirs = every.filter(F.col("listed") & (F.col("path") != ""))
    inside = every.filter(~F.col("listed")).groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("path")).agg(F.count("*").alias("kept"))
    counted = dirs.join(inside, "path", "left").select("path", "is_dir", "size", F.coalesce("kept", F.lit(0)).alias("entries"), "error")
    return files.unionByName(counted)


def files_in(spark: SparkSession, folder: str) -> DataFrame:
    """The files of one folder: path (relative to it), is_dir and size. Folders in it are not
    entered, and names that begin with a dot or an underscore are left out, as Spark does."""
    listed = durable(spark.createDataFrame([("",)], "path string").mapInPandas(_list(folder), ENTRY_DDL))
    problem = listed.filter(F.col("error").isNotNull()).first()
    if problem is not None:
        raise FileNotFoundError(problem.error)
    return listed.filter(~F.col("is_dir") & ~F.col("path").rlike("^[._]")).select("path", "is_dir", "size")


def _read(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, plain = open_path(root)
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path in batch["path"]:
                try:
                    with system.open_input_stream(f"{plain}/{path}") as handle:
                        data = handle.read()
                    rows.append((path, data.decode("utf-8", "replace"), None))
                    held += len(data)
                except OSError as problem:
                    rows.append((path, None, f"{type(problem).__name__}: {problem}"))
                if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "content", "error"])
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    return run


def contents(walked: DataFrame, root: str, extensions: list[str] | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """path, content and error of the files of a walk, in tasks of equal bytes."""
    files = walked.filter(~F.col("is_dir"))
    if extensions is not None:
        files = files.filter(extension(F.col("path")).isin(extensions))
    costed = files.select("path", (F.coalesce("size", F.lit(0)) + FILE_COST).alias("_cost"))
    dealt = dealt_by_bytes(costed, "_cost", ["path"], task_bytes)
    return dealt.select("path").mapInPandas(_read(root), "path STRING, content STRING, error STRING")


def empty_directories(walked: DataFrame) -> DataFrame:
    """Directories that hold nothing, or nothing but pruned names."""
    return walked.filter(F.col("is_dir") & (F.col("entries") == 0)).select(F.col("path").alias("dir_path"))
