"""The flat node table every tree dialect lands in.

One row per node. ``node_id`` numbers a file's nodes in preorder from 1 and ``parent_id``
points into the same numbering, so a tree needs no recursive type. ``closes`` says how many
enclosing nodes end with this one, which is all a writer needs to nest rows again.
Columns a dialect does not supply are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_FIELDS = {
    "node_id": "int",
    "parent_id": "int",
    "depth": "int",
    "ordinal": "int",
    "closes": "int",
    "kind": "string",
    "parent_kind": "string",
    "is_named": "boolean",
    "field_name": "string",
    "text": "string",
    "start_line": "int",
    "start_col": "int",
    "end_line": "int",
    "end_col": "int",
    "start_off": "int",
    "end_off": "int",
    "is_leaf": "boolean",
    "is_error": "boolean",
}


def node_columns(**given: Column) -> list[Column]:
    """All node columns in order and typed; those not given are null."""
    absent = F.lit(None)
    return [
        (absent if given.get(name) is None else given[name]).cast(kind).alias(name)
        for name, kind in NODE_FIELDS.items()
    ]


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def as_nodes(df: DataFrame, keys: list[str], dialect: str, **given: Column) -> DataFrame:
    return df.select(*keys, F.lit(dialect).alias("dialect"), *node_columns(**given))
