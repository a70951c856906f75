"""Directory trees from file paths. Files are merged per folder before ancestors are listed,
so a folder of a million files lists its ancestors once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import base_name, parent_path


def _with_ancestors(folders: DataFrame) -> DataFrame:
    """Each folder row once per folder on its way to the root, itself included."""
    path = F.col("_folder")
    depth = F.size(F.split(path, "/"))
    return folders.filter(path != "").withColumn("depth", F.explode(F.sequence(F.lit(1), depth))).withColumn(
        "dir_path", F.call_function("substring_index", path, F.lit("/"), F.col("depth"))
    )


def dir_tree(
    files: DataFrame, repo: str = "repo", path: str = "file_path", empty_dirs: DataFrame | None = None
) -> DataFrame:
    """Every directory that holds a file at any depth, plus ``empty_dirs`` (repo, dir_path)."""
    folders = files.select(repo, parent_path(F.col(path)).alias("_folder"))
    if empty_dirs is not None:
        folders = folders.unionByName(empty_dirs.select(repo, F.col("dir_path").alias("_folder")))
    listed = _with_ancestors(folders.distinct())
    return (
        listed.select(repo, "dir_path", "depth")
        .distinct()
        .select(
            repo,
            "dir_path",
            F.when(F.col("depth") > 1, parent_path(F.col("dir_path"))).alias("parent_path"),
            base_name(F.col("dir_path")).alias("name"),
            "depth",
        )
    )


def dir_rollup(files: DataFrame, repo: str = "repo", path: str = "file_path") -> DataFrame:
    """Files and lines below each directory, at any depth."""
    own = files.groupBy(repo, parent_path(F.col(path)).alias("_folder")).agg(
        F.count("*").alias("_files"), F.sum("loc").alias("_loc")
    )
    return (
        _with_ancestors(own)
        .groupBy(repo, "dir_path")
        .agg(F.sum("_files").alias("files"), F.sum("_loc").alias("loc"))
    )
