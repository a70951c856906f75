"""From a table of files to languages, sizes and status, and the totals over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import ENGINE_COLUMN, EXTENSIONS_BY_ENGINE, LANGUAGE_BY_EXTENSION
from ..functions.numbers import iso_millis, megabytes, rounded, seconds
from ..functions.paths import base_name, extension, is_pruned, parent_path
from ..functions.text import line_count


# Lookups of more pairs are joined without a broadcast hint.
BROADCAST_PAIRS = 10_000


def lookup(spark: SparkSession, pairs: list[tuple[str, str]], key: str, value: str) -> DataFrame:
    """A lookup table from fixed pairs. Its size is known here, so a small one may be broadcast."""
    rows = F.array(*[F.struct(F.lit(k).alias(key), F.lit(v).alias(value)) for k, v in pairs])
    table = spark.range(1).select(F.inline(rows))
    return F.broadcast(table) if len(pairs) <= BROADCAST_PAIRS else table


def with_dimensions(files: DataFrame, path: str = "file_path") -> DataFrame:
    """Name, folder and extension of each file."""
    p = F.col(path)
    return files.select(
        "*", base_name(p).alias("name"), parent_path(p).alias("dir_path"), extension(p).alias("ext")
    )


def pruned(files: DataFrame, path: str = "file_path") -> DataFrame:
    return files.filter(~is_pruned(F.col(path)))


def with_language(files: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Language of each file: the label of its extension, else the extension, else ``unknown``."""
    table = lookup(files.sparkSession, list((labels or LANGUAGE_BY_EXTENSION).items()), "ext", "_label")
    label = F.coalesce(F.col("_label"), F.nullif(F.col("ext"), F.lit("")), F.lit("unknown"))
    return files.join(table, "ext", "left").withColumn("language", label).drop("_label")


def supported_by_engine(files: DataFrame, engines: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per file and engine that accepts its extension; others are dropped."""
    pairs = [(e, engine) for engine, exts in (engines or EXTENSIONS_BY_ENGINE).items() for e in exts]
    return files.join(lookup(files.sparkSession, pairs, "ext", "engine"), "ext")


def with_line_count(files: DataFrame, text: str = "content") -> DataFrame:
    return files.withColumn("loc", line_count(F.col(text)))


# Totals ---------------------------------------------------------------------------------
# Input columns: loc, parse_ns, nodes, max_depth. A failed file keeps its lines and counts
# with no time, nodes or depth.


def _totals() -> list[Column]:
    return [
        F.count("*").alias("files"),
        F.sum("loc").alias("loc"),
        F.coalesce(F.sum("nodes"), F.lit(0)).cast("bigint").alias("nodes"),
        F.coalesce(F.max("max_depth"), F.lit(0)).cast("int").alias("max_depth"),
        seconds(F.coalesce(F.sum("parse_ns"), F.lit(0))).alias("parse_sec"),
    ]


def corpus_totals(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return files.groupBy(*(keys or [])).agg(*_totals())


def language_stats(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return files.groupBy(*(keys or []), "language").agg(*_totals())


def language_rollup(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per language and in total (``is_total``), rounded after summing at both levels.

    Files are merged per language first, so grouping twice handles one row per language.
    """
    keys = keys or []
    merged = files.groupBy(*keys, "language").agg(
        F.count("*").alias("_files"),
        F.sum("loc").alias("_loc"),
        F.sum("nodes").alias("_nodes"),
        F.max("max_depth").alias("_depth"),
        F.sum("parse_ns").alias("_ns"),
    )
    return merged.groupingSets([[*keys, "language"], list(keys)], *keys, "language").agg(
        F.grouping("language").cast("int").alias("is_total"),
        F.sum("_files").alias("files"),
        F.sum("_loc").alias("loc"),
        F.coalesce(F.sum("_nodes"), F.lit(0)).cast("bigint").alias("nodes"),
        F.coalesce(F.max("_depth"), F.lit(0)).cast("int").alias("max_depth"),
        seconds(F.coalesce(F.sum("_ns"), F.lit(0))).alias("parse_sec"),
    )


def status_counts(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return files.groupBy(*(keys or []), "status").agg(*_totals())


def throughput(files: DataFrame, keys: list[str]) -> DataFrame:
    """Lines and files per second of parse time; null when no time was spent."""
    spent = F.sum("parse_ns") / F.lit(1e9)
    return files.groupBy(*keys).agg(
        rounded(F.try_divide(F.sum("loc").cast("double"), spent), 2).alias("loc_per_sec"),
        rounded(F.try_divide(F.count("*").cast("double"), spent), 2).alias("files_per_sec"),
    )


def success_rate(files: DataFrame, keys: list[str]) -> DataFrame:
    ok = F.count_if(F.col("status") == "ok")
    return files.groupBy(*keys).agg(rounded(F.lit(100.0) * ok / F.count("*"), 2).alias("success_pct"))


def peak_metrics(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Highest resident size and highest heap, each on its own."""
    return samples.groupBy(*keys).agg(
        megabytes(F.max("rss_bytes")).alias("peak_rss_mb"), megabytes(F.max("heap_bytes")).alias("peak_heap_mb")
    )


def run_records(files: DataFrame, keys: list[str]) -> DataFrame:
    """One record per run with its nested ``languages`` map.

    Input as for the totals, plus ts, total_ns, rss_bytes and heap_bytes samples. The map is built
    from per-language rows, never from files, so its size is the number of languages.
    """
    entry = F.struct(
        F.col("files"),
        F.col("loc"),
        F.col("nodes"),
        F.col("max_depth").alias("maxDepth"),
        seconds(F.col("parse_ns")).alias("parseTimeSec"),
    )
    by_language = files.groupBy(*keys, "language").agg(
        F.count("*").alias("files"),
        F.sum("loc").alias("loc"),
        F.coalesce(F.sum("nodes"), F.lit(0)).cast("bigint").alias("nodes"),
        F.coalesce(F.max("max_depth"), F.lit(0)).cast("int").alias("max_depth"),
        F.coalesce(F.sum("parse_ns"), F.lit(0)).alias("parse_ns"),
        F.max("total_ns").alias("total_ns"),
        F.max("rss_bytes").alias("rss"),
        F.max("heap_bytes").alias("heap"),
        F.max("ts").alias("ts"),
    )
    return by_language.groupBy(*keys).agg(
        iso_millis(F.max("ts")).alias("timestamp"),
        F.sum("files").alias("files"),
        F.sum("loc").alias("loc"),
        F.sum("nodes").alias("totalNodes"),
        F.max("max_depth").alias("maxDepth"),
        seconds(F.sum("parse_ns")).alias("parseTimeSec"),
        seconds(F.max("total_ns")).alias("totalTimeSec"),
        megabytes(F.max("rss")).alias("peakRssMB"),
        megabytes(F.max("heap")).alias("peakHeapMB"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("language"), entry)))).alias("languages"),
    )


def history_rows(runs: DataFrame) -> DataFrame:
    """History lines of run records: one per language; run-level values repeat on each."""
    return runs.select("*", F.explode("languages").alias("language", "_s")).select(
        "timestamp",
        ENGINE_COLUMN,
        "repo",
        "language",
        F.col("_s.files").alias("files"),
        F.col("_s.loc").alias("loc"),
        F.col("_s.nodes").alias("nodes"),
        F.col("_s.maxDepth").alias("max_depth"),
        F.col("_s.parseTimeSec").alias("parse_sec"),
        F.col("totalTimeSec").alias("total_sec"),
        F.col("peakRssMB").alias("peak_rss_mb"),
        F.col("peakHeapMB").alias("peak_heap_mb"),
    )
