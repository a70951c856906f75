"""Markup text to a node table: tokenise with one regular expression, then nest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import VOID_ELEMENTS
from ..functions.nesting import nest_by_steps
from ..functions.text import trimmed
from .node_table import as_nodes, let

TAG = r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>[^<]*"


def without_opaque_parts(html: Column) -> Column:
    """Drop comments and the bodies of script and style, which may contain fake tags."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for name in ("script", "style"):
        bare = F.regexp_replace(bare, rf"(?is)(<{name}\b[^>]*>).*?(</{name}\s*>)", "$1$2")
    return bare


def markup_nodes(
    files: DataFrame, text: str = "content", keys: tuple[str, ...] = ("repo", "file_path"), keep_empty: bool = False
) -> DataFrame:
    """One node per element. A close tag ends the innermost open element, whatever its name;
    void elements take a place but hold no children; elements never closed are errors.

    Narrow: each file is tokenised and nested inside its own row, so nothing is shuffled.
    ``keep_empty`` gives a file without elements a row whose ``node_id`` is null.
    """
    tokens = files.select(
        *keys, F.regexp_extract_all(without_opaque_parts(F.col(text)), F.lit(TAG), F.lit(0)).alias("_tokens")
    )
    void = F.array(*[F.lit(v) for v in VOID_ELEMENTS])

    def childless(token: Column, name: Column) -> Column:
        return F.array_contains(void, name) | F.rlike(token, F.lit(r"^<[^>]*/>"))

    def step(token: Column) -> Column:
        name = F.lower(F.regexp_extract(token, TAG, 2))
        return F.when(token.startswith("</"), -1).when(childless(token, name), 0).otherwise(1)

    nested = tokens.select(*keys, "_tokens", nest_by_steps(F.transform("_tokens", step)).alias("_nest"))
    def described(names: Column) -> Column:
        # Names stay beside their nodes, so a parent's kind needs no join.
        return F.transform(
            "_nest",
            lambda n, i: F.struct(
                n.alias("place"),
                i.alias("i"),
                F.get("_tokens", n["at"]).alias("token"),
                F.get(names, i).alias("name"),
                F.get(names, n["parent"] - 1).alias("parent_name"),
            ),
        )

    names = F.transform("_nest", lambda n: F.lower(F.regexp_extract(F.get("_tokens", n["at"]), TAG, 2)))
    one_each = F.explode_outer if keep_empty else F.explode
    rows = nested.select(*keys, one_each(let(names, described)).alias("_n"))
    n = F.col("_n")
    place = n["place"]
    return as_nodes(
        rows,
        list(keys),
        "markup",
        node_id=n["i"] + 1,
        parent_id=place["parent"],
        depth=place["depth"],
        ordinal=place["ordinal"],
        closes=place["closes"],
        kind=n["name"],
        parent_kind=n["parent_name"],
        is_named=F.lit(True),
        # What follows a childless element belongs to its parent.
        text=F.when(
            place["is_leaf"],
            F.when(childless(n["token"], n["name"]), "").otherwise(
                trimmed(F.regexp_extract(n["token"], r"^<[^>]*>([^<]*)", 1))
            ),
        ),
        is_leaf=place["is_leaf"],
        is_error=place["is_open"],
    )
