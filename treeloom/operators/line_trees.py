"""Plain text as a three-level tree: document, lines, space-separated tokens, with ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nesting import starts_of
from ..functions.text import lines
from .node_table import as_nodes


def line_tree_sizes(files: DataFrame, text: str = "content") -> DataFrame:
    """Add ``nodes`` and ``max_depth`` of each file's line tree, where the nodes themselves are
    not wanted. Every line feed adds a line and a token, every blank a token."""
    body = F.col(text)
    full = body.isNotNull() & (body != "")
    feeds = F.octet_length(body) - F.octet_length(F.replace(body, F.lit("\n"), F.lit("")))
    blanks = F.octet_length(body) - F.octet_length(F.replace(body, F.lit(" "), F.lit("")))
    return files.withColumn(
        "nodes", F.when(full, 3 + 2 * feeds + blanks).otherwise(1).cast("bigint")
    ).withColumn("max_depth", F.when(full, 3).otherwise(1))


def line_nodes(files: DataFrame, text: str = "content", keys: tuple[str, ...] = ("repo", "file_path")) -> DataFrame:
    """Node table of each file's lines and tokens. Narrow: no row leaves its partition."""
    body = F.col(text)
    present = F.when(body.isNull() | (body == ""), F.array().cast("array<string>")).otherwise(lines(body))
    split = files.select(
        *keys, present.alias("_lines"), F.coalesce(F.char_length(body), F.lit(0)).alias("_chars")
    ).select(*keys, "_lines", "_chars", F.transform("_lines", lambda l: F.split(l, " ", -1)).alias("_words"))
    last = F.size("_lines") - 1
    # What the root needs is taken here, so that no whole array is copied beside every line.
    placed = split.select(
        *keys,
        "_lines",
        "_words",
        "_chars",
        F.size("_lines").alias("_count"),
        F.coalesce(F.char_length(F.get("_lines", last)), F.lit(0)).alias("_tail"),
        starts_of(F.transform("_words", lambda w: F.size(w) + 1)).alias("_first"),
        starts_of(F.transform("_lines", lambda l: F.char_length(l) + 1)).alias("_line_at"),
        starts_of(
            F.flatten(F.transform("_words", lambda w: F.transform(w, lambda t: F.char_length(t) + 1)))
        ).alias("_token_at"),
    )

    def line(text: Column, i: Column) -> Column:
        first, words = F.get("_first", i), F.get("_words", i)
        return F.struct(
            (first + 2).alias("node_id"),
            F.char_length(text).alias("length"),
            F.get("_line_at", i).alias("at"),
            F.arrays_zip(
                words.alias("word"), F.slice("_token_at", first - i + 1, F.size(words)).alias("at")
            ).alias("tokens"),
            (i == last).alias("is_last"),
        )

    per_line = placed.select(
        *keys,
        "_count",
        "_tail",
        "_chars",
        F.posexplode_outer(F.transform("_lines", line)).alias("_i", "_l"),
    )
    # A line's row holds its tokens behind an empty place for the line, and in the first row one
    # more for the document; what a node is follows from its place, so that no node is built as
    # a value of its own before it is a row.
    empty = F.struct(F.lit(None).cast("string").alias("word"), F.lit(None).cast("int").alias("at"))
    heads = F.when(F.col("_l").isNull(), F.array(empty)).when(F.col("_i") == 0, F.array(empty, empty)).otherwise(F.array(empty))
    tokens = F.coalesce(F.col("_l.tokens"), F.array().cast("array<struct<word:string,at:int>>"))
    rows = per_line.select(
        *keys,
        "_count",
        "_tail",
        "_chars",
        "_i",
        F.when(F.coalesce(F.col("_i"), F.lit(0)) == 0, 2).otherwise(1).alias("_heads"),
        F.col("_l.node_id").alias("_id"),
        F.col("_l.length").alias("_length"),
        F.col("_l.at").alias("_at"),
        F.size("_l.tokens").alias("_size"),
        F.col("_l.is_last").alias("_last"),
        F.posexplode(F.concat(heads, tokens)).alias("_j", "_t"),
    )
    # The place among the line's tokens; -1 for the line, -2 for the document.
    k, at, size = F.col("_j") - F.col("_heads"), F.col("_t.at"), F.char_length("_t.word")
    is_root, is_token = k == -2, k >= 0

    def node(root: Column, line: Column, token: Column) -> Column:
        return F.when(is_token, token).when(is_root, root).otherwise(line)

    one, zero, none = F.lit(1), F.lit(0), F.lit(None)
    number, ends_line = F.col("_i") + 1, k == F.col("_size") - 1
    return as_nodes(
        rows,
        list(keys),
        "lines",
        node_id=F.when(is_root, one).otherwise(F.col("_id") + 1 + k),
        parent_id=node(none, one, F.col("_id")),
        depth=F.least(k, zero) + 3,
        ordinal=node(zero, F.col("_i"), k),
        closes=F.when(is_token & ends_line, F.when(F.col("_last"), 2).otherwise(1)).otherwise(0),
        kind=node(F.lit("document"), F.lit("line"), F.lit("token")),
        parent_kind=node(none, F.lit("document"), F.lit("line")),
        is_named=F.lit(True),
        text=F.when(is_root & (F.col("_count") == 0), "").otherwise(F.col("_t.word")),
        start_line=F.when(is_root, one).otherwise(number),
        start_col=F.when(is_token, at - F.col("_at")).otherwise(0),
        end_line=F.when(is_root, F.greatest(F.col("_count"), one)).otherwise(number),
        end_col=node(F.col("_tail"), F.col("_length"), at - F.col("_at") + size),
        start_off=node(zero, F.col("_at"), at),
        end_off=node(F.col("_chars"), F.col("_at") + F.col("_length"), at + size),
        is_leaf=F.when(is_root, F.col("_count") == 0).otherwise(is_token),
        is_error=F.lit(False),
    )
