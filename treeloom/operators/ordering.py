"""Positions and running totals over groups of any size.

A window over a whole group puts that group into one task. Here the rows are cut into
ranges of the full order first, ties broken by a unique column, so that a group holding a
third of all rows spans many tasks. Each range is totalled on its own and shifted by what
came before it in its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import durable


def running_total(
    df: DataFrame, keys: list[str], order: list[str], amount: str, name: str, total: str | None = None
) -> DataFrame:
    """Add ``name``: the sum of ``amount`` up to and including this row of its group, and on
    request ``total``: the sum over the whole group.

    ``order`` must end in a column unique within the group. The ranges are fixed by a
    checkpoint: drawn again after a lost executor they could differ between the two uses.
    """
    ranged = durable(
        df.repartitionByRange(*[F.col(c) for c in keys + order]).withColumn("_range", F.spark_partition_id())
    )
    # One row per group and range: at most groups + ranges rows, however large a group is.
    group = Window.partitionBy(*keys)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*keys, "_range").agg(F.sum(amount).alias("_amount")).select(
        *keys,
        "_range",
        F.coalesce(F.sum("_amount").over(before), F.lit(0)).alias("_before"),
        F.sum("_amount").over(group).alias("_whole"),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumn("_local", F.sum(amount).over(inside))
    placed = local.join(offsets, [*keys, "_range"]).withColumn(name, (F.col("_local") + F.col("_before")).cast("bigint"))
    if total is not None:
        placed = placed.withColumn(total, F.col("_whole").cast("bigint"))
    return placed.drop("_range", "_local", "_before", "_whole")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Row numbers from 1 within each group."""
    ones = running_total(df.withColumn("_one", F.lit(1).cast("bigint")), keys, order, "_one", name)
    return ones.drop("_one")


def exact_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact n, total, squares, least, most and median of a whole-number column per group; an
    even group's median is the mean of its middle two.

    Equal values are merged before anything is ordered, no group is held in memory, and the
    sums are exact, so nothing depends on the order of rows.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = running_total(counted, keys, [value], "_n", "_upto", "_size")
    v, n, upto = F.col(value), F.col("_n"), F.col("_upto")
    # The wide type keeps sums of squares exact.
    wide = v.cast("decimal(19,0)")
    times = n.cast("decimal(19,0)")

    def at(position: Column) -> Column:
        return F.max(F.when((upto - n < position) & (position <= upto), v))

    middle = at(F.floor((F.col("_size") + 1) / 2)) + at(F.floor((F.col("_size") + 2) / 2))
    return placed.groupBy(*keys).agg(
        F.sum(n).alias("n"),
        F.sum((wide * times).cast("decimal(38,0)")).alias("total"),
        F.sum((wide * wide * times).cast("decimal(38,0)")).alias("squares"),
        F.min(v).alias("least"),
        F.max(v).alias("most"),
        (middle / F.lit(2.0)).alias("median"),
    )
