"""Indented text dumps to a node table, and the size estimate for dumps read as plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nesting import nest_by_levels
from ..functions.text import indent_width, lines, opens_constructor, spelled_kind, spelled_text, trimmed
from .node_table import as_nodes, let

KEYS = ("repo", "file_path")

# A constructor dump's line: an optional slot name, then a constructor or a bracket.
SLOT = r"^\s*([A-Za-z_]\w*)="
CONSTRUCTOR = r"^\s*(?:[A-Za-z_]\w*=)?([A-Z][A-Za-z0-9]*)\("


def dump_nodes(
    files: DataFrame,
    text: str = "content",
    width: int = 2,
    spelled: bool = True,
    keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """One node per line; ``width`` blanks are one level and the parent is the nearest earlier
    line indented less. ``spelled`` reads `Kind: 'spelling'` lines, else constructor lines."""
    shown = F.filter(lines(F.regexp_replace(F.col(text), r"\s+$", "")), lambda l: F.rlike(l, F.lit(r"\S")))
    level = lambda l: (F.floor(indent_width(l) / width) + 1).cast("int")
    nested = files.select(*keys, shown.alias("_lines")).select(
        *keys, "_lines", nest_by_levels(F.transform("_lines", level)).alias("_nest")
    )

    def kind_of(line: Column) -> Column:
        return spelled_kind(line) if spelled else F.nullif(F.regexp_extract(line, CONSTRUCTOR, 1), F.lit(""))

    def described(kinds: Column) -> Column:
        return F.transform(
            "_nest",
            lambda n, i: F.struct(
                n.alias("place"),
                i.alias("i"),
                F.get("_lines", n["at"]).alias("line"),
                F.get(kinds, i).alias("kind"),
                F.get(kinds, n["parent"] - 1).alias("parent_kind"),
            ),
        )

    kinds = F.transform("_nest", lambda n: kind_of(F.get("_lines", n["at"])))
    rows = nested.select(*keys, F.explode(let(kinds, described)).alias("_n"))
    n = F.col("_n")
    place = n["place"]
    return as_nodes(
        rows,
        list(keys),
        "spelled_dump" if spelled else "constructor_dump",
        node_id=n["i"] + 1,
        parent_id=place["parent"],
        depth=place["depth"],
        ordinal=place["ordinal"],
        closes=place["closes"],
        kind=n["kind"],
        parent_kind=n["parent_kind"],
        is_named=F.lit(True),
        field_name=None if spelled else F.nullif(F.regexp_extract(n["line"], SLOT, 1), F.lit("")),
        text=spelled_text(n["line"]) if spelled else trimmed(n["line"]),
        start_line=place["at"] + 1,
        is_leaf=place["is_leaf"],
        is_error=F.lit(False),
    )


def dump_estimate(
    files: DataFrame, text: str = "content", width: int = 4, keys: tuple[str, ...] = KEYS
) -> DataFrame:
    """Estimated size of a constructor dump: its constructor lines, at least one, and the
    deepest indent. A dump without a single constructor line is an error."""
    per_line = F.transform(
        lines(F.col(text)),
        lambda l: F.struct(
            opens_constructor(l).alias("opens"),
            (F.floor(indent_width(l) / width) + 1).cast("int").alias("depth"),
        ),
    )
    seen = files.select(*keys, per_line.alias("_l"))
    opening = F.size(F.filter("_l", lambda l: l["opens"]))
    return seen.select(
        *keys,
        F.greatest(opening, F.lit(1)).cast("bigint").alias("nodes"),
        F.array_max(F.transform("_l", lambda l: l["depth"])).alias("max_depth"),
        F.when(opening > 0, "ok").otherwise("error").alias("status"),
    )
