"""Writers. Appending writers take a batch id and replace that batch, so a retry adds nothing."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.files import history_rows
from ..operators.node_table import NODE_FIELDS
from ..sources.layout import open_path

# Numbers of nodes rise from row to row and words differ: both are written faster, and numbers
# smaller, as differences than by dictionaries.
SNAPSHOT_OPTIONS = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.writer.version": "v2"} | {
    f"parquet.enable.dictionary#{name}": "false" for name, kind in NODE_FIELDS.items() if kind == "int" or name == "text"
}


def _batch(folder: str, batch_id: int | None) -> str:
    return folder if batch_id is None else f"{folder}/batch_id={batch_id}"


def _mode(batch_id: int | None) -> str:
    return "append" if batch_id is None else "overwrite"


def write_snapshot(nodes: DataFrame, folder: str, batch_id: int | None = None, gathered: bool = False) -> None:
    """Node table by engine and repository. Rows are gathered by folder first so that small
    repositories get few files, and a large one is split over as many tasks as it needs. Rows that
    are ``gathered`` already, each task holding few repositories, are written where they are."""
    placed = nodes if gathered else nodes.hint("rebalance", "engine", "repo")
    writer = placed.write.mode(_mode(batch_id)).options(**SNAPSHOT_OPTIONS).partitionBy("engine", "repo")
    writer.parquet(_batch(folder, batch_id))


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Each file of (file_path, content) as a file of its own below ``folder``; returns what was
    written (file_path, bytes) when it is computed. A null content makes an empty directory. A
    file appears under its own name only when complete, and is replaced by a retry."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, plain = open_path(folder)
        made = set()
        for batch in batches:
            sizes = []
            for path, content in zip(batch["file_path"], batch["content"]):
                target = f"{plain}/{path}"
                parent = target if content is None else target.rsplit("/", 1)[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                data = (content or "").encode()
                if content is not None:
                    hidden = f"{parent}/.{uuid.uuid4().hex}.part"
                    with system.open_output_stream(hidden) as out:
                        out.write(data)
                    system.move(hidden, target)
                sizes.append(len(data))
            yield pd.DataFrame({"file_path": batch["file_path"], "bytes": sizes})

    return files.select("file_path", "content").mapInPandas(write, "file_path STRING, bytes BIGINT")


def write_dumps(files: DataFrame, folder: str) -> None:
    """Dumps by language, one JSON line per file, so that each can be read as the file it was."""
    files.select("language", "file_path", "content").write.mode("append").partitionBy("language").json(folder)


def write_fragments(fragments: DataFrame, order: list[str], folder: str) -> None:
    """Nested JSON of any size as text: part files in name order are the documents."""
    repo, *rest = order
    (
        fragments.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(repo, F.col("fragment").alias("value"))
        .write.mode("append")
        .partitionBy(repo)
        .text(folder)
    )


def write_runs(runs: DataFrame, folder: str, batch_id: int | None = None) -> None:
    runs.write.mode(_mode(batch_id)).json(_batch(folder, batch_id))


def write_history(runs: DataFrame, folder: str, batch_id: int | None = None) -> None:
    """One quoted line per run and language, a header on each part file."""
    history_rows(runs).write.mode(_mode(batch_id)).option("header", True).csv(_batch(folder, batch_id))


def write_archives(files: DataFrame, folder: str) -> DataFrame:
    """Pack (archive, entry_path, content) into zip files below a shared folder.

    The caller names archives so that one archive holds a bounded number of entries; that is
    the group a task packs. A file appears under its own name only when complete.
    """

    def pack(group: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        name = group["archive"].iloc[0]
        ordered = group.sort_values("entry_path", kind="stable")
        blob = io.BytesIO()
        with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as archive:
            for path, content in zip(ordered["entry_path"], ordered["content"]):
                archive.writestr(zipfile.ZipInfo(path), content or "", zipfile.ZIP_DEFLATED)
        system, plain = open_path(folder)
        system.create_dir(plain, recursive=True)
        target = f"{plain}/{name}.zip"
        with system.open_output_stream(target + ".part") as out:
            out.write(blob.getvalue())
        system.move(target + ".part", target)
        return pd.DataFrame({"archive": [name], "entries": [len(group)]})

    return files.select("archive", "entry_path", "content").groupBy("archive").applyInPandas(
        pack, "archive STRING, entries BIGINT"
    )
