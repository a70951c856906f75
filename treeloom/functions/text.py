"""Column functions over file contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import CONSTRUCTOR_LINE, KIND_SPELLING_LINE


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_count(text: Column) -> Column:
    """Newlines plus one; nothing for empty or missing text."""
    empty = text.isNull() | (text == "")
    feeds = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(empty, F.lit(0)).otherwise(feeds + 1).cast("bigint")


def trimmed(text: Column) -> Column:
    """Strip white space of every sort at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def preview(text: Column, length: int = 500) -> Column:
    return F.substring(text, 1, length)


def indent_width(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^(\s*)", 1))


def opens_constructor(line: Column) -> Column:
    return F.rlike(line, F.lit(CONSTRUCTOR_LINE))


def spelled_kind(line: Column) -> Column:
    return F.regexp_extract(line, KIND_SPELLING_LINE, 1)


def spelled_text(line: Column) -> Column:
    return F.regexp_extract(line, KIND_SPELLING_LINE, 2)
