"""Archives to history in one job.

Archives are read once, into a table of files partitioned by extension in the shared folder. The
tree builders read that table, each its own extensions, and write every file's nodes and status
to the node snapshot. Statistics come from the snapshot's narrow columns: one aggregation over
nodes and files together gives one row per file, failed ones with their lines and nothing else,
and from those one record per repository. Records go to the run folder and, a line per language,
to the history.

Each step reads what the step before has written, and writes below its batch's own folder,
replacing it: a batch that is run again after a failure adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import ENGINE_COLUMN
from ..operators.dispatch import FAILED, Dialects
from ..operators.files import run_records, with_dimensions, with_language, with_line_count
from ..session import unless_set
from ..sinks.writers import write_history, write_runs, write_snapshot
from ..sources.archives import archive_to_files

# Adds ts, parse_ns, total_ns, rss_bytes and heap_bytes to files (repo, file_path, content, loc).
Measure = Callable[[DataFrame], DataFrame]
MEASURES = ["ts", "parse_ns", "total_ns", "rss_bytes", "heap_bytes"]
# Stored bytes of files whose nodes one task builds, and folders it keeps open. A task that meets more
# repositories sorts what is left.
NODES_SETTINGS = {"spark.sql.files.maxPartitionBytes": "2m", "spark.sql.maxConcurrentOutputFileWriters": "100"}
# A file of their table is cut between its row groups, so these are small.
FILES_OPTIONS = {"compression": "zstd", "parquet.block.size": str(4 * 1024 * 1024)}


@dataclass
class Analysis:
    """The folders of a job: files, nodes, runs and history."""

    root: str
    engine: str
    dialects: Dialects
    measure: Measure
    labels: dict[str, str] | None = None

    def folder(self, name: str, batch_id: int | None = None) -> str:
        return f"{self.root}/{name}" if batch_id is None else f"{self.root}/{name}/batch_id={batch_id}"

    def run(self, archives: DataFrame, batch_id: int) -> None:
        """Analyse ``archives`` (path) as one batch."""
        spark = archives.sparkSession
        files = self._files(spark, archives, batch_id)
        nodes = self._nodes(spark, files, batch_id)
        records = run_records(self._per_file(nodes, files), [ENGINE_COLUMN, "repo"])
        write_runs(records, self.folder("runs"), batch_id)
        # The history is written from the records, not from the trees again.
        written = spark.read.schema(records.schema).json(self.folder("runs", batch_id))
        write_history(written, self.folder("history"), batch_id)

    def _files(self, spark: SparkSession, archives: DataFrame, batch_id: int) -> DataFrame:
        found = with_dimensions(archive_to_files(archives, self.dialects.extensions))
        measured = self.measure(with_line_count(with_language(found, self.labels)))
        kept = measured.select("repo", "file_path", "content", "status", "error", "language", "loc", *MEASURES, "ext")
        folder = self.folder("files", batch_id)
        kept.write.mode("overwrite").options(**FILES_OPTIONS).partitionBy("ext").parquet(folder)
        return spark.read.schema(kept.schema).parquet(folder)

    def _nodes(self, spark: SparkSession, files: DataFrame, batch_id: int) -> DataFrame:
        """Archives are dealt in their order, so a repository's files lie together in few files of
        their table. Its nodes, of many times their size, are written where they are built, unsorted:
        a task takes few files and keeps open the folders of the repositories that it meets."""
        rows = self.dialects.results(files, ["repo", "file_path"]).withColumn("engine", F.lit(self.engine))
        with unless_set(spark, NODES_SETTINGS):
            write_snapshot(rows, self.folder("nodes"), batch_id, gathered=True)
        return spark.read.schema(rows.schema).parquet(self.folder("nodes", batch_id))

    def _per_file(self, nodes: DataFrame, files: DataFrame) -> DataFrame:
        """A row per file, nodes and files counted together, so that nothing is joined. Nodes are
        counted on their own before: strings among the totals would have every node sorted. An
        archive that could not be opened has no file and no record; the table of files has its
        error."""
        keys = ["repo", "file_path"]
        none = lambda kind: F.lit(None).cast(kind)
        counted = nodes.groupBy(*keys, "status").agg(F.count("node_id").alias("nodes"), F.max("depth").alias("depth"))
        by_node = counted.select(*keys, none("string").alias("language"), "nodes", "depth", "status", *[none("bigint").alias(c) for c in ("loc", *MEASURES[1:])], none("timestamp").alias("ts"))
        by_file = files.filter(F.col("file_path").isNotNull()).select(*keys, "language", F.lit(0).cast("bigint").alias("nodes"), none("int").alias("depth"), "status", "loc", *MEASURES[1:], "ts")
        each = by_node.unionByName(by_file).groupBy(*keys).agg(
            F.max("language").alias("language"),
            F.min("status").alias("status"),  # an error comes before ok
            F.sum("nodes").alias("nodes"),
            F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
            *[F.max(c).alias(c) for c in ("loc", *MEASURES)],
        )
        failed = F.col("status") == FAILED
        return each.withColumns({ENGINE_COLUMN: F.lit(self.engine), "parse_ns": F.when(failed, F.lit(0).cast("bigint")).otherwise(F.col("parse_ns"))})

    def files(self, spark: SparkSession) -> DataFrame:
        """Per-file results of all batches: repo, file_path, language, status, loc, nodes, max_depth."""
        found = self._per_file(spark.read.parquet(self.folder("nodes")), spark.read.parquet(self.folder("files")))
        return found.select("repo", "file_path", "language", "status", "loc", "nodes", "max_depth")
