"""Directories of source files, tree dumps, and the run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import ENGINE_COLUMN, HISTORY_DDL, RUN_DDL
from ..functions.paths import is_pruned
from ..operators.ordering import numbered
from . import walk


def below(path: Column, root: str) -> Column:
    """Path relative to the root of a walk; the root's own name is never tested."""
    plain = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return F.regexp_replace(path, r"^[a-z0-9]*:?/*\Q" + plain + r"\E/+", "")


def directory_files(spark: SparkSession, root: str, repo: str, extensions: list[str] | None = None) -> DataFrame:
    """Text files below a directory. Pruned names and other extensions are dropped from the
    file listing itself, so their contents are never opened; a file that vanishes is skipped."""
    reader = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    )
    if extensions is not None:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(extensions) + "}")
    listed = reader.load(root)
    kept = listed.filter(~is_pruned(below(F.col("_metadata.file_path"), root)))
    return kept.select(
        F.lit(repo).alias("repo"),
        below(F.col("path"), root).alias("file_path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    )


def text_dumps(spark: SparkSession, path: str) -> DataFrame:
    """Dumps of a folder, one file per row. Small files share a task, as many as make up its
    bytes; a file that cannot be read fails the job."""
    read = walk.contents(walk.files_in(spark, path), path)
    return read.select(
        F.concat(F.lit(path.rstrip("/") + "/"), "path").alias("file_path"),
        F.when(F.col("error").isNull(), F.col("content")).otherwise(F.raise_error("error")).alias("content"),
    )


def read_dumps(spark: SparkSession, folder: str) -> DataFrame:
    """Dumps written by language: language, file_path, content."""
    return spark.read.schema("file_path STRING, content STRING, language STRING").json(folder)


def pieces_in_order(spark: SparkSession, folder: str, key: str, name: str = "position") -> DataFrame:
    """Lines of text files written in order, numbered from 1 within each ``key`` (a partition
    column of the folder): by file name, place in the file, and line."""
    read = spark.read.text(folder).select(
        key,
        F.col("value").alias("fragment"),
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"),
    )
    return numbered(read, [key], ["_file", "_start", "_line"], name).select(key, name, "fragment")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Run history lines; a blank line of a run without files is skipped."""
    reader = spark.read.schema(HISTORY_DDL).option("header", True).option("recursiveFileLookup", True)
    return reader.csv(path).filter(F.col("timestamp").isNotNull())


def read_runs(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Run records; ``multi_line`` for one pretty-printed record per file."""
    reader = spark.read.schema(RUN_DDL).option("multiLine", multi_line).option("recursiveFileLookup", True)
    return reader.json(path)


def history_head(history: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` lines of the history in time order."""
    return history.orderBy("timestamp", ENGINE_COLUMN, "repo", "language").limit(n)
