"""Comparing two engines over repeated runs of the same repository.

Runs come as rows of (repo, engine, ts, run_id, files, loc, nodes, max_depth, parse_ns,
total_ns, rss_bytes, heap_bytes). Reported times are whole milliseconds, and every statistic
is computed from sums of those integers, so results do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import megabytes, rounded, seconds, whole_millis
from .ordering import exact_summary, numbered

METRICS = ["files", "loc", "nodes", "max_depth", "parse_sec", "total_sec", "peak_rss_mb", "peak_heap_mb"]


def number_runs(runs: DataFrame) -> DataFrame:
    """``run_no`` from 1 per repository and engine, in time order."""
    return numbered(runs, ["repo", "engine"], ["ts", "run_id"], "run_no")


def pair_runs(runs: DataFrame, left: str = "generic", right: str = "native") -> DataFrame:
    """The n-th run of one engine beside the n-th run of the other; both sides are kept and
    ``missing_side`` names the engine without a partner.

    Two runs meet in one aggregation, not in a join of the table with itself, and its key
    includes the run number, so a repository with very many runs stays spread out.
    """
    shown = F.struct(
        F.col("files").cast("double").alias("files"),
        F.col("loc").cast("double").alias("loc"),
        F.col("nodes").cast("double").alias("nodes"),
        F.col("max_depth").cast("double").alias("max_depth"),
        seconds(F.col("parse_ns")).alias("parse_sec"),
        seconds(F.col("total_ns")).alias("total_sec"),
        megabytes(F.col("rss_bytes")).alias("peak_rss_mb"),
        megabytes(F.col("heap_bytes")).alias("peak_heap_mb"),
    )
    placed = number_runs(runs.filter(F.col("engine").isin(left, right)))
    side = lambda engine: F.max(F.when(F.col("engine") == engine, shown))
    pairs = placed.groupBy("repo", "run_no").agg(side(left).alias("_a"), side(right).alias("_b"))
    missing = F.when(F.col("_a").isNull(), left).when(F.col("_b").isNull(), right)
    return pairs.select(
        "repo",
        "run_no",
        missing.alias("missing_side"),
        *[F.col(f"_a.{m}").alias(f"a_{m}") for m in METRICS],
        *[F.col(f"_b.{m}").alias(f"b_{m}") for m in METRICS],
    )


def engine_compare(runs: DataFrame, left: str = "generic", right: str = "native") -> DataFrame:
    """Eight metrics of each pair side by side, one row per metric."""
    pairs = pair_runs(runs, left, right)
    sides = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").alias(left), F.col(f"b_{m}").alias(right)) for m in METRICS]
    )
    return pairs.select("repo", "run_no", "missing_side", F.inline(sides))


def _verdict(ratio: Column, left: str, right: str) -> list[Column]:
    return [
        F.when(ratio > 1, left).otherwise(right).alias("faster"),
        rounded(F.when(ratio > 1, ratio).otherwise(1 / ratio), 2).alias("times_faster"),
    ]


def engine_speedup(runs: DataFrame, left: str = "generic", right: str = "native") -> DataFrame:
    """Per pair: which engine was faster and by what factor, where both took measurable time."""
    timed = pair_runs(runs, left, right).filter((F.col("a_parse_sec") > 0) & (F.col("b_parse_sec") > 0))
    ratio = F.col("b_parse_sec") / F.col("a_parse_sec")
    return timed.select("repo", "run_no", "a_parse_sec", "b_parse_sec", *_verdict(ratio, left, right))


def run_stats(runs: DataFrame, keys: tuple[str, ...] = ("repo", "engine")) -> DataFrame:
    """Mean, population deviation, median, least and greatest parse time over repeated runs.

    Sums of milliseconds and of their squares are exact integers; only the last step is not.
    """
    timed = runs.select(*keys, whole_millis(F.col("parse_ns")).alias("_ms"))
    n, total, squares = (F.col(c).cast("decimal(38,0)") for c in ("n", "total", "squares"))
    spread = F.sqrt((n * squares - total * total).cast("double")) / F.col("n")

    def sec(ms: Column) -> Column:
        return rounded(ms / F.lit(1000.0), 4)

    return (
        exact_summary(timed, list(keys), "_ms")
        .filter(F.col("n") > 1)
        .select(
            *keys,
            F.col("n").alias("runs"),
            sec(F.col("total").cast("double") / F.col("n")).alias("mean_sec"),
            sec(spread).alias("std_sec"),
            sec(F.col("median")).alias("median_sec"),
            sec(F.col("least")).alias("min_sec"),
            sec(F.col("most")).alias("max_sec"),
        )
    )


def mean_speedup(runs: DataFrame, left: str = "generic", right: str = "native") -> DataFrame:
    """Ratio of mean parse times per repository, over repositories whose runs are all paired
    and number more than one."""
    pairs = pair_runs(runs, left, right)
    ms = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("bigint")
    sums = pairs.groupBy("repo").agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("missing_side").isNull()).alias("_paired"),
        F.sum(ms("a_parse_sec")).alias("_a"),
        F.sum(ms("b_parse_sec")).alias("_b"),
    )
    whole = sums.filter((F.col("runs") > 1) & (F.col("runs") == F.col("_paired")) & (F.col("_a") > 0))
    ratio = F.col("_b") / F.col("_a")
    return whole.select(
        "repo",
        "runs",
        rounded(ratio, 2).alias("speedup"),
        F.when(ratio > 1, "faster").otherwise("slower").alias("direction"),
    )
