"""Comparing two node snapshots.

Files are compared by a digest of their nodes first: one aggregation with map-side combining a
side. Only files whose digests differ, or that one side lacks, are looked into: their nodes are
gathered per file, subtrees are hashed bottom-up inside the row, and the descent enters only
branches whose hashes differ. A node is its kind, field and text; where it lies in the text does
not matter. Nodes are paired by their place among their siblings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nesting import tree_differences
from ..functions.once import settled


def _own() -> Column:
    return F.xxhash64(*[F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in ("kind", "field_name", "text")])


def _digests(nodes: DataFrame, keys: list[str], name: str) -> DataFrame:
    mixed = F.xxhash64("node_id", "depth", _own()).cast("decimal(38,0)")
    return nodes.groupBy(*keys).agg(F.struct(F.count("*").alias("n"), F.sum(mixed).alias("sum")).alias(name))


def _trees(nodes: DataFrame, keys: list[str], wanted: DataFrame, side: str) -> DataFrame:
    own = nodes.select(*keys, F.struct("node_id", "depth", _own().alias("own")).alias("_n")).join(wanted, keys, "left_semi")
    return own.groupBy(*keys).agg(F.array_sort(F.collect_list("_n")).alias(side))


def compare(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, path (places among siblings from the root down, as text), status (``removed``,
    ``added`` or ``changed``) and the number of nodes of the subtree on either side: the topmost
    differences of every file of two node tables. Keys must not be null."""
    met = _digests(left, keys, "_l").join(_digests(right, keys, "_r"), keys, "full")
    wanted = met.filter(~F.col("_l").eqNullSafe(F.col("_r"))).select(*keys)
    both = _trees(left, keys, wanted, "left").join(_trees(right, keys, wanted, "right"), keys, "full")
    none = F.array().cast(dict(both.dtypes)["left"])
    both = settled(both.select(*keys, *[F.coalesce(s, none).alias(s) for s in ("left", "right")]), ["left", "right"])
    part = lambda side, field: F.transform(side, lambda n: n[field])
    found = both.select(*keys, tree_differences(part("left", "depth"), part("left", "own"), part("right", "depth"), part("right", "own")).alias("_d"))
    rows = found.select(*keys, F.explode("_d").alias("_d"))
    d = F.col("_d")
    return rows.select(
        *keys,
        F.array_join(F.transform(d["path"], lambda p: p.cast("string")), "/").alias("path"),
        F.when(d["right"].isNull(), "removed").when(d["left"].isNull(), "added").otherwise("changed").alias("status"),
        d["left_nodes"].alias("left_nodes"),
        d["right_nodes"].alias("right_nodes"),
    )
