"""Archives processed on arrival, each once or the newest of a name in place of the older, and
run records appended batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..fixed_values import BINARY_FILE_DDL
from ..jobs.analyse import Analysis
from ..session import durable
from ..sinks.writers import write_history, write_runs
from ..sources.archives import latest_archives
from ..sources.layout import open_path

Batch = Callable[[DataFrame, int], None]


def archive_stream(spark: SparkSession, landing: str, per_batch: int = 1000) -> DataFrame:
    """New archives of a landing directory: names only, their bytes are read by the job."""
    return (
        spark.readStream.schema(BINARY_FILE_DDL)
        .format("binaryFile")
        .option("pathGlobFilter", "*.zip")
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", per_batch)
        .load(landing)
        .select("path", "modificationTime", "length")
    )


def run_available(stream: DataFrame, checkpoint: str, handle: Batch) -> StreamingQuery:
    """Process what has arrived since the last call, then stop."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def ingest_archives(
    spark: SparkSession, landing: str, out: str, checkpoint: str, summarise: Callable[[DataFrame], DataFrame]
) -> None:
    """Summarise each new archive once. A replayed batch replaces its own folder."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        summarise(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    run_available(archive_stream(spark, landing), checkpoint, handle)


def _stamps(spark: SparkSession, out: str, repos: list[str]) -> DataFrame | None:
    """repo and the time and path of the archive its rows come from, for those of ``repos`` that
    have rows; None if none has. Only their folders are opened, however many there are."""
    system, plain = open_path(out)
    names = [entry.base_name for entry in system.get_file_info(fs.FileSelector(plain, allow_not_found=True))]
    folders = {unquote(name.removeprefix("repo=")): name for name in names if name.startswith("repo=")}
    held = [f"{out}/{folders[repo]}" for repo in repos if repo in folders]
    if not held:
        return None
    schema = "row_kind string, modificationTime timestamp, path string, repo string"
    found = spark.read.schema(schema).option("basePath", out).parquet(*held)
    return found.filter("row_kind = 'archive'").select("repo", F.struct("modificationTime", "path").alias("_held"))


def ingest_newest(
    spark: SparkSession, landing: str, out: str, checkpoint: str, summarise: Callable[[DataFrame], DataFrame]
) -> None:
    """Rows of the newest archive of each repository alone. ``summarise`` gives rows with repo.

    The rows of a repository are a folder of their own, with one more row that says which archive
    they come from: the state by repository. A newer archive replaces its folder, an older one
    that arrives late is left out, and a replayed batch writes the same folders again. An
    archive without rows leaves its repository without rows.

    A batch costs what its own archives cost, whatever is held already. Its repositories are
    dealt over the cores, since opening their folders and files takes longer than their rows.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        tasks = spark.sparkContext.defaultParallelism
        newest = durable(latest_archives(batch).repartition(tasks))
        # No more names than archives of a batch.
        held = _stamps(spark, out, [row.repo for row in newest.select("repo").collect()])
        if held is not None:
            met = newest.join(held, "repo", "left")
            newest = met.filter(F.col("_held").isNull() | (F.struct("modificationTime", "path") >= F.col("_held"))).drop("_held")
        # Which archives are taken must not change while their rows are written.
        newest = durable(newest.repartition(tasks))
        marks = newest.withColumn("row_kind", F.lit("archive"))
        rows = summarise(newest.select("path", "modificationTime")).withColumn("row_kind", F.lit("row"))
        both = rows.unionByName(marks, allowMissingColumns=True)
        both = both.repartition(tasks, "repo")
        both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(out)

    run_available(archive_stream(spark, landing), checkpoint, handle)


def read_newest(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all repositories."""
    return spark.read.parquet(out).filter("row_kind = 'row'").drop("row_kind", "path", "modificationTime")


def analyse_archives(spark: SparkSession, landing: str, job: Analysis, checkpoint: str) -> None:
    """The whole analysis of each new archive, once: every batch of arrivals is a batch of the
    job, whose folders a replay writes again."""
    run_available(archive_stream(spark, landing), checkpoint, job.run)


def append_runs(
    stream: DataFrame, records: Callable[[DataFrame], DataFrame], runs_folder: str, history_folder: str, checkpoint: str
) -> None:
    """Turn each batch into run records and append them to the run and history folders."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        made = records(batch).persist()
        try:
            write_runs(made, runs_folder, batch_id)
            write_history(made, history_folder, batch_id)
        finally:
            made.unpersist()

    run_available(stream, checkpoint, handle)
