"""Declaration outlines of any node table: marked kinds, each below its nearest marked ancestor.

An outline is worked out inside the row that holds a file's nodes in preorder. Builders that
keep such arrays give them without a shuffle; any other node table is gathered per file once,
with the columns an outline needs alone. Nodes are nested among the marked ones by their depths
(``nest_marked``), so no node is joined to its ancestors.

A declaration is named by its first child in the naming slot, else by its first child of an
identifier kind, else ``anonymous``; a name that is not a leaf is spelled by its leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import IDENTIFIER_KINDS, NAME_FIELD, NO_NAME
from ..functions.nesting import nest_marked
from ..functions.once import settled

USED = ["node_id", "depth", "kind", "field_name", "text", "is_leaf", "start_line", "start_col", "end_line", "end_col"]


def gathered(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``nodes``: each file's nodes in preorder. A file's tree must fit one row."""
    return nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*USED))).alias("nodes"))


def _marked(arrays: DataFrame, keys: list[str], class_by_kind: dict[str, str], identifiers: list[str]) -> tuple[DataFrame, Column]:
    """``arrays`` with _marked, and the class of a kind."""
    classes = F.create_map(*[F.lit(x) for pair in class_by_kind.items() for x in pair])
    names = F.array(*[F.lit(k) for k in identifiers])

    def mark(n: Column) -> Column:
        declared = F.when(F.array_contains(F.map_keys(classes), n["kind"]), 1).otherwise(0)
        by_kind = F.when(F.array_contains(names, n["kind"]), 2).otherwise(0)
        return declared + by_kind + F.when(n["field_name"] == NAME_FIELD, 4).otherwise(0)

    levels, marks = F.transform("nodes", lambda n: n["depth"]), F.transform("nodes", mark)
    return settled(arrays.select(*keys, "nodes", nest_marked(levels, marks).alias("_marked")), ["_marked"]), classes


def _name(m: Column) -> Column:
    below = F.slice("nodes", m["name"] + 1, m["name_end"] - m["name"] + 1)
    leaves = F.transform(F.filter(below, lambda n: n["is_leaf"]), lambda n: F.coalesce(n["text"], F.lit("")))
    one = F.get("nodes", m["name"])
    return F.when(m["name"].isNull(), NO_NAME).when(one["is_leaf"], one["text"]).otherwise(F.array_join(leaves, ""))


def outline(
    arrays: DataFrame, keys: list[str], class_by_kind: dict[str, str], identifiers: list[str] = IDENTIFIER_KINDS, line_shift: int = 0
) -> DataFrame:
    """A row for each declaration of ``arrays`` (keys, nodes)."""
    marked, classes = _marked(arrays, keys, class_by_kind, identifiers)

    def item(m: Column) -> Column:
        n, up = F.get("nodes", m["at"]), F.get("nodes", m["up"])
        lines = [(n[c] + line_shift).cast("int").alias(c) if "line" in c else n[c].cast("int").alias(c) for c in USED[6:]]
        return F.struct(n["node_id"].alias("node_id"), up["node_id"].alias("outline_parent_id"), n["kind"].alias("kind"), _name(m).alias("name"), *lines)

    rows = marked.select(*keys, F.explode(F.transform("_marked", item)).alias("_i"))
    i = F.col("_i")
    own = [classes[i["kind"]].alias("class") if c == "class" else i[c].alias(c) for c in ["node_id", "outline_parent_id", "class", "name", *USED[6:]]]
    return rows.select(*keys, *own)


def outline_documents(
    arrays: DataFrame, keys: list[str], class_by_kind: dict[str, str], identifiers: list[str] = IDENTIFIER_KINDS, line_shift: int = 0
) -> DataFrame:
    """``keys`` and ``outline``: one JSON array per file, declarations nested below each other,
    each with its ``children``. Only marked nodes are written, so closing brackets are those of
    marked nodes alone. A missing range is written as zeros."""
    marked, classes = _marked(arrays, keys, class_by_kind, identifiers)

    def point(n: Column, side: str, shift: int) -> Column:
        line, col = (F.coalesce(n[f"{side}_{c}"], F.lit(0)) for c in ("line", "col"))
        return F.struct((line + shift).alias("line"), col.alias("col")).alias(side)

    def piece(m: Column) -> Column:
        n = F.get("nodes", m["at"])
        span = F.struct(point(n, "start", line_shift), point(n, "end", line_shift))
        body = F.to_json(F.struct(classes[n["kind"]].alias("type"), _name(m).alias("name"), span.alias("range")))
        opened = F.concat(F.when(m["first"], "").otherwise(","), F.regexp_replace(body, r"\}$", ""), F.lit(',"children":['))
        return F.concat(opened, F.repeat(F.lit("]}"), m["closes"]))

    text = F.array_join(F.transform("_marked", piece), "")
    return marked.select(*keys, F.concat(F.lit("["), text, F.lit("]")).alias("outline"))
