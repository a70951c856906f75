"""Columns that are worked out once in each row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, made: list[str]) -> DataFrame:
    """``df`` with its columns ``made`` worked out once in each row. They become fields of one
    value that nothing may be pushed below or merged into, so that neither a filter on them nor
    a lambda that mentions them works them out anew."""
    once = F.when(F.monotonically_increasing_id() >= 0, F.struct(*made)).alias("made_")
    held = df.select(*[c for c in df.columns if c not in made], once)
    return held.select(*[F.col("made_")[c].alias(c) if c in made else F.col(c) for c in df.columns])
