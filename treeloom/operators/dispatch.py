"""Choosing a tree builder by file extension, and keeping one bad file from failing a run.

A builder gives a file's result and its nodes in the same rows, from one explode: every file has
at least one row, with ``status`` and ``error``; a file without nodes has one whose ``node_id``
is null. So what happened to a file travels with its nodes and needs no join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed
from . import json_trees, line_trees, markup_trees
from .node_table import NODE_FIELDS, node_columns

# Takes files (keys, content), returns keys, dialect, the node columns, status and error.
Builder = Callable[[DataFrame, list[str]], DataFrame]

OK, FAILED = "ok", "error"


def _fine(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({"status": F.lit(OK), "error": F.lit(None).cast("string")})


def line_results(files: DataFrame, keys: list[str]) -> DataFrame:
    """Lines and tokens. Any text has at least its document."""
    return _fine(line_trees.line_nodes(files, keys=tuple(keys)))


def markup_results(files: DataFrame, keys: list[str]) -> DataFrame:
    """Elements; a text without any has a row without a node."""
    return _fine(markup_trees.markup_nodes(files, keys=tuple(keys), keep_empty=True))


def json_results(strict: bool = True) -> Builder:
    """Tree dumps in JSON. A strict reader fails on text that is not JSON; another keeps such a
    text as one opaque node of depth 1. JSON that is no object is a success without nodes."""

    def build(files: DataFrame, keys: list[str]) -> DataFrame:
        read = json_trees.node_arrays(files, "content", tuple(keys), others=("content",))
        raw = ~F.col("valid")
        kept = F.lit(False) if strict else raw
        rows = read.select(
            *keys, raw.alias("_raw"), F.when(kept, trimmed(F.col("content"))).alias("_dump"), F.explode_outer("nodes").alias("_n")
        )
        n, opaque = F.col("_n"), F.col("_dump").isNotNull() & F.col("_n").isNull()
        one = lambda value, otherwise: F.when(opaque, value).otherwise(otherwise)
        given = {c: n[c] for c in NODE_FIELDS if c not in ("parent_id", "is_error")} | {
            "node_id": one(1, n["node_id"]),
            "parent_id": n["parent"],
            "depth": one(1, n["depth"]),
            "ordinal": one(0, n["ordinal"]),
            "closes": one(0, n["closes"]),
            "text": one(F.col("_dump"), n["text"]),
            "is_leaf": one(True, n["is_leaf"]),
            "is_error": F.coalesce(n["kind"] == json_trees.ERROR_KIND, F.lit(False)),
        }
        failed = F.col("_raw") if strict else F.lit(False)
        return rows.select(
            *keys,
            F.lit("generic").alias("dialect"),
            *node_columns(**given),
            F.when(failed, FAILED).otherwise(OK).alias("status"),
            F.when(failed, "the dump is not JSON").alias("error"),
        )

    return build


class Dialects:
    """Builders by extension."""

    def __init__(self) -> None:
        self._builders: dict[str, tuple[list[str], Builder]] = {}

    def register(self, name: str, extensions: list[str], builder: Builder) -> "Dialects":
        self._builders[name] = (extensions, builder)
        return self

    @property
    def extensions(self) -> list[str]:
        return [e for extensions, _ in self._builders.values() for e in extensions]

    def results(self, files: DataFrame, keys: list[str]) -> DataFrame:
        """Rows of every file (keys, ext, content, and maybe status and error) whose extension
        has a builder; other files are dropped, as the walk does. A file that already failed
        keeps its error and is given to no builder. Each branch filters on the extension, so a
        table partitioned by it is read once in all."""
        keys = [*keys, "ext"]
        failed = F.lit(False)
        known = files.filter(F.col("ext").isin(self.extensions))
        if "status" in files.columns:
            failed = F.coalesce(F.col("status") == FAILED, F.lit(False))
        sound = known.filter(~failed)
        built = [builder(sound.filter(F.col("ext").isin(own)), keys) for own, builder in self._builders.values()]
        if "status" in files.columns:
            error = F.col("error") if "error" in files.columns else F.lit(None)
            none = known.filter(failed).select(
                *keys, F.lit(None).cast("string").alias("dialect"), *node_columns(), F.col("status"), error.cast("string").alias("error")
            )
            built.append(none)
        return reduce(DataFrame.unionByName, built)

    def nodes(self, files: DataFrame, keys: list[str]) -> DataFrame:
        """The nodes alone."""
        return self.results(files, keys).filter(F.col("node_id").isNotNull()).drop("status", "error")


def file_results(rows: DataFrame, keys: list[str], *others: Column) -> DataFrame:
    """One row for each file of ``rows``: status, error, nodes and max_depth. A file's rows are
    born in one partition, so each task ships about one row per file."""
    nodes, depth = F.count("node_id").alias("nodes"), F.max("depth").alias("max_depth")
    if not others:
        # The highest of strings is found by sorting. Counted by status and error first, nodes
        # are counted in hash tables, and about one row a file is left to be sorted.
        rows = rows.groupBy(*keys, "status", "error").agg(nodes, depth)
        nodes, depth = F.sum("nodes").alias("nodes"), F.max("max_depth").alias("max_depth")
    return rows.groupBy(*keys).agg(
        F.max("status").alias("status"), F.max("error").alias("error"), nodes, F.coalesce(depth, F.lit(0)).alias("max_depth"), *others
    )
