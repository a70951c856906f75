"""Helpers of the pipeline operators: tables, words, keys, and joins with a checked side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.once import settled  # noqa: F401
from ..session import fresh_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Word patterns of the contracts, as what separates words.
BLANKS = r"[\x20\x09-\x0D]+"
NON_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A side is broadcast only when counted at no more than this many rows and bytes.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column, separators: str = BLANKS) -> Column:
    """The words of a text in order; none for a missing text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def text_key(text: Column) -> Column:
    """Tells texts apart; a missing text differs from an empty one."""
    return F.coalesce(F.md5(text), F.lit(""))


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """The same rows, written once to the shared folder and read from there. Cuts lineage, lets
    several uses share the work, and gives the planner true sizes."""
    spark = df.sparkSession
    folder = fresh_folder(spark, label)
    df.write.option("compression", compression).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def small(df: DataFrame, width: Column | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has no more than ``BROADCAST_ROWS`` rows, and no more
    than ``BROADCAST_BYTES`` bytes in its wide columns, whose bytes in a row ``width`` gives; a
    larger one is left to a shuffled join. ``df`` should be stored: it is counted."""
    n, wide = df.agg(F.count("*"), F.coalesce(F.sum(F.lit(0) if width is None else width), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and wide <= BROADCAST_BYTES else df


def where_found(df: DataFrame, flag: str) -> DataFrame:
    """The rows whose computed column ``flag`` is true. The row number, which nothing may be
    pushed below, keeps the filter above the computation: pushed into it, the filter would work
    out the words anew for every mention of them."""
    numbered = df.withColumn("row_", F.monotonically_increasing_id())
    return numbered.filter(F.col(flag) & (F.col("row_") >= 0)).drop("row_")


def least_count(counted: DataFrame, most: int, n: str = "n") -> int:
    """The least number of occurrences that no more than ``most`` rows of ``counted`` reach,
    from a histogram over eighths of powers of two: at most 512 rows reach the driver."""
    step = F.floor(F.log2(n) * 8).cast("int")
    classes = counted.groupBy(step.alias("step")).agg(F.count("*").alias("many"), F.min(n).alias("least"))
    least, total = 1 << 62, 0
    for row in sorted(classes.collect(), key=lambda r: -r.step):
        total += row.many
        if total > most:
            break
        least = row.least
    return least


def constant_array(values: list[int]) -> Column:
    """An array of whole numbers as one constant of the plan. Its length must have a bound that
    does not depend on the corpus."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def rows_of(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose id and text are among ``chosen`` (doc_id, key_: the text's
    XXH64). A missing id equals a missing id."""
    keys = stored(chosen.select(F.col("doc_id").alias("id_"), F.col("key_").alias("other_")).distinct(), "chosen")
    same = docs[id_col].eqNullSafe(keys["id_"]) & (F.xxhash64(docs[text_col]) == keys["other_"])
    return docs.join(small(keys), same, "left_semi")


def set_apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[str]]:
    """Columns renamed so that no name clashes with an operator's own; the new name of each
    column; and the old names in order, for :func:`put_back`."""
    names = list(docs.columns)
    held = [f"in_{i}_" for i in range(len(names))]
    return docs.toDF(*held), dict(zip(names, held)), names


def put_back(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"in_{i}_") for i in range(len(names))]).toDF(*names)
