"""Session settings and the shared folder every durable intermediate goes to."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs are written for. A cluster's own settings win where it has set them.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Rows of the tree builders carry whole files, so an Arrow batch is bounded in bytes too.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Checkpoint files go away with the DataFrame that needed them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: str = "*", partitions: int = 8, app: str = "treeloom") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TREELOOM_DRIVER_MEMORY", "8g"))
        .config("spark.treeloom.spread", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own: on a cluster a
    machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named.rstrip("/")
    already = context.getCheckpointDir()
    if already:
        return already.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="treeloom-")
    context.setCheckpointDir(own)
    return own


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new, unused folder name under the shared root."""
    return f"{shared_root(spark)}/treeloom/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the shared folder; survives lost executors."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def unless_set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Settings for as long as a block runs, where the session has none of its own."""
    free = {key: value for key, value in settings.items() if spark.conf.get(key, None) is None}
    for key, value in free.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in free:
            spark.conf.unset(key)
