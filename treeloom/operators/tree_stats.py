"""Statistics over node tables. All are plain aggregations with map-side combining: a file's
nodes are born in one partition, so each task ships about one row per file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import LEAF_RANGE_EXTRA


def _with_files(nodes: DataFrame, keys: list[str], files: DataFrame | None) -> DataFrame:
    """Nodes, each counting one, and a row that counts nothing for each file, so that a file
    without nodes keeps its place in the totals without a join."""
    counted = nodes.select(*keys, F.lit(1).alias("one"), "depth", "is_leaf", "is_error")
    if files is None:
        return counted
    marks = files.select(
        *keys,
        F.lit(0).alias("one"),
        F.lit(0).alias("depth"),
        F.lit(False).alias("is_leaf"),
        F.lit(False).alias("is_error"),
    )
    return counted.unionByName(marks)


def tree_stats(nodes: DataFrame, keys: list[str], files: DataFrame | None = None) -> DataFrame:
    """Node count, depth (root = 1), leaves and error nodes; zeros for those of ``files`` that
    have no nodes."""
    return _with_files(nodes, keys, files).groupBy(*keys).agg(
        F.sum("one").cast("bigint").alias("nodes"),
        F.max("depth").alias("max_depth"),
        F.count_if("is_leaf").alias("leaves"),
        F.count_if("is_error").alias("errors"),
    )


def tree_stats_compat(nodes: DataFrame, keys: list[str], dialect: str, files: DataFrame | None = None) -> DataFrame:
    """The same as a walk over plain objects reports it, where a leaf's range object counts too."""
    extra_nodes, extra_depth = LEAF_RANGE_EXTRA[dialect]
    return tree_stats(nodes, keys, files).select(
        *keys,
        "nodes",
        "max_depth",
        (F.col("nodes") + extra_nodes * F.col("leaves")).alias("compat_nodes"),
        F.when(F.col("nodes") > 0, F.col("max_depth") + extra_depth).otherwise(0).alias("compat_max_depth"),
    )


def error_nodes(nodes: DataFrame, keys: list[str], files: DataFrame | None = None) -> DataFrame:
    return _with_files(nodes, keys, files).groupBy(*keys).agg(F.count_if("is_error").alias("error_nodes"))


def kind_histogram(nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return nodes.groupBy(*(keys or []), "kind").agg(F.count("*").alias("nodes"))


def parent_kind_pairs(nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """How often each kind sits below each other kind. The parent's kind is carried on every
    node, so walking to the parent needs no self-join."""
    return nodes.groupBy(*(keys or []), "parent_kind", "kind").agg(F.count("*").alias("pairs"))
