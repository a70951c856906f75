"""Tree-shaped JSON to a node table, and plain-object statistics of any JSON.

A dump is cut into pieces inside its own row, whatever its length and depth
(``functions/json_text``); pieces are nested by their sorts (``functions/brackets``), and a node
reads its fields from the pieces that hold them. Nothing is shuffled and a tree is never joined
to itself. ``tree`` columns hold the JSON text; one that is null or not JSON has no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import ERROR_KIND, LINE_SHIFT
from ..functions import brackets
from ..functions.once import settled
from ..functions.text import trimmed
from .node_table import as_nodes

KEYS = ("repo", "file_path")


def parse_or_raw(files: DataFrame, text: str = "content") -> DataFrame:
    """Read tree dumps: ``tree`` where the text is JSON, else the trimmed text as ``raw_dump``.

    ``status`` is ``ok``; ``raw`` for text that is not JSON; ``error`` for a dump whose root
    only carries an error message; ``no_tree`` for JSON that is not an object.
    """
    read = settled(files, [text]).withColumn("_root", brackets.root_of(text))
    valid = F.col("_root.valid")
    return read.select(
        *files.columns,
        F.when(valid, F.col(text)).alias("tree"),
        F.when(~valid, trimmed(F.col(text))).alias("raw_dump"),
        F.when(~valid, "raw")
        .when(~F.col("_root.object"), "no_tree")
        .when(F.col("_root.error") & ~F.col("_root.kind"), "error")
        .otherwise("ok")
        .alias("status"),
    )


def node_arrays(
    trees: DataFrame, tree: str = "tree", keys: tuple[str, ...] = KEYS, named_only: bool = False, others: tuple[str, ...] = ()
) -> DataFrame:
    """``keys``, ``others``, valid (whether the text is JSON) and ``nodes``: an array of a dump's
    nodes in preorder, with the columns of the node table that JSON supplies."""
    scan = brackets.named_tree_of if named_only else brackets.tree_of
    own_columns = list(dict.fromkeys([*keys, *others]))
    made = settled(trees.select(*dict.fromkeys([*own_columns, tree])), [tree])
    found = made.select(*own_columns, scan(tree).alias("_tree"))
    return settled(found.select(*own_columns, "_tree.valid", "_tree.nodes"), ["valid", "nodes"])


def json_nodes(
    trees: DataFrame,
    tree: str = "tree",
    keys: tuple[str, ...] = KEYS,
    dialect: str = "generic",
    named_only: bool = False,
) -> DataFrame:
    """Flatten JSON syntax trees of any dialect; ``named_only`` skips an unnamed node whole."""
    # An inner explode would be given a filter on its size, which cuts every text twice.
    rows = node_arrays(trees, tree, keys, named_only).select(*keys, F.explode_outer("nodes").alias("_n"))
    rows = rows.select(*keys, "_n.*").filter(F.col("node_id").isNotNull())
    names = ["node_id", "depth", "ordinal", "closes", "kind", "parent_kind", "is_named", "field_name", "text", "is_leaf"]
    names += ["start_off", "end_off"] if dialect == "offsets" else ["start_line", "start_col", "end_line", "end_col"]
    given = {name: F.col(name) for name in names}
    for name in ("start_line", "end_line"):
        if name in given:
            given[name] = given[name] + LINE_SHIFT[dialect]
    return as_nodes(rows, list(keys), dialect, parent_id=F.col("parent"), is_error=F.col("kind") == ERROR_KIND, **given)


def object_tree_stats(trees: DataFrame, tree: str = "tree", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Node count and depth of any JSON value, counting its objects and arrays as nodes."""
    sized = settled(trees.select(*keys, tree), [tree]).select(*keys, brackets.object_sizes(tree).alias("_s"))
    return sized.select(*keys, "_s.nodes", "_s.max_depth")
