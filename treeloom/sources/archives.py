"""Zip archives as tables of entries.

An archive is read in two steps. Its directory is listed first, so names can be pruned and
filtered before any content is touched. Then entries are dealt over the cluster by their packed
bytes and each is read at its own offset, so one very large archive is shared by many tasks and
never loaded as a whole.
"""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import base_name, extension, is_pruned, without_zip
from ..session import durable
from .layout import dealt_by_bytes, open_path

ENTRY_DDL = (
    "archive STRING, entry_path STRING, ordinal BIGINT, is_dir BOOLEAN, offset BIGINT, packed BIGINT, "
    "size BIGINT, method INT, flags INT, crc BIGINT, error STRING"
)
CONTENT_DDL = "archive STRING, entry_path STRING, content STRING, error STRING"
# Packed bytes read by one task, what opening an entry costs beside them, and bytes handed over
# per batch.
TASK_BYTES = 64 * 1024 * 1024
ENTRY_COST = 4096
BATCH_BYTES = 32 * 1024 * 1024


def archive_files(spark: SparkSession, folder: str) -> DataFrame:
    """Archives below a folder. Their bytes are not read: only names, times and sizes are."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.zip")
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", "modificationTime", "length")
    )


def latest_archives(archives: DataFrame) -> DataFrame:
    """The newest archive of each repository name: repo, path, modificationTime."""
    newest = archives.groupBy(without_zip(base_name(F.col("path"))).alias("repo")).agg(F.max(F.struct("modificationTime", "path")).alias("_a"))
    return newest.select("repo", "_a.path", "_a.modificationTime")


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["archive", "entry_path", "ordinal", "is_dir", "offset", "packed", "size", "method", "flags", "crc", "error"]
    for batch in batches:
        for path in batch["path"]:
            try:
                system, plain = open_path(path)
                with system.open_input_file(plain) as handle, zipfile.ZipFile(handle) as archive:
                    found = archive.infolist()
                # A later entry replaces an earlier one of the same name.
                last = {i.filename: n for n, i in enumerate(found)}
                rows = [
                    (path, i.filename, n, i.is_dir(), i.header_offset, i.compress_size, i.file_size, i.compress_type, i.flag_bits, i.CRC, None)
                    for n, i in enumerate(found)
                    if last[i.filename] == n
                ]
            except (OSError, ValueError, EOFError, zipfile.BadZipFile) as problem:
                rows = [(path, None, 0, False, None, None, None, None, None, None, f"{type(problem).__name__}: {problem}")]
            for begin in range(0, len(rows), 50_000):
                yield pd.DataFrame(rows[begin : begin + 50_000], columns=columns)


def archive_entries(archives: DataFrame) -> DataFrame:
    """Directory of each archive; a later entry replaces an earlier one of the same name.
    An archive that cannot be opened gives one row with its error."""
    return archives.select("path").mapInPandas(_list, ENTRY_DDL)


def _entry_bytes(handle, e) -> bytes:
    """The contents of a listed entry, checked against its size and checksum."""
    if int(e.flags) & 1:
        raise ValueError("the entry is encrypted")
    data = _unpacked(handle, int(e.offset), int(e.packed), int(e.method), e.entry_path)
    if len(data) != int(e.size) or zlib.crc32(data) != int(e.crc):
        raise ValueError("the entry is damaged")
    return data


def _unpacked(handle, offset: int, packed: int, method: int, name: str) -> bytes:
    handle.seek(offset)
    header = handle.read(30)
    name_size, extra_size = struct.unpack("<HH", header[26:30])
    handle.seek(offset + 30 + name_size + extra_size)
    data = handle.read(packed)
    if method == zipfile.ZIP_STORED:
        return data
    if method == zipfile.ZIP_DEFLATED:
        return zlib.decompress(data, -15)
    with zipfile.ZipFile(handle) as archive:
        return archive.read(name)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["archive", "entry_path", "content", "error"]
    for batch in batches:
        rows: list[tuple] = []
        held = 0
        unread = batch[batch["error"].notna()]
        rows.extend((e.archive, e.entry_path, None, e.error) for e in unread.itertuples(index=False))
        for path, entries in batch[batch["error"].isna()].groupby("archive", sort=False):
            with ExitStack() as stack:
                try:
                    system, plain = open_path(path)
                    handle = stack.enter_context(system.open_input_file(plain))
                except (OSError, ValueError) as problem:
                    # The archive went away after it was listed.
                    said = f"{type(problem).__name__}: {problem}"
                    rows.extend((path, name, None, said) for name in entries["entry_path"])
                    continue
                for e in entries.itertuples(index=False):
                    try:
                        data = _entry_bytes(handle, e)
                        rows.append((path, e.entry_path, data.decode("utf-8", "replace"), None))
                        held += len(data)
                    except (OSError, ValueError, EOFError, RuntimeError, zlib.error, struct.error, zipfile.BadZipFile) as problem:
                        rows.append((path, e.entry_path, None, f"{type(problem).__name__}: {problem}"))
                    if held >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)


def entry_contents(entries: DataFrame, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Text of each entry. Entries are dealt over tasks of equal packed bytes in the order of
    their archives, so neighbours are read together, a very large archive is shared by many
    tasks, and many small ones by one. Archives that could not be listed pass through with
    their error."""
    # Kept, since dealing reads them twice and a listing opens every archive.
    wanted = durable(entries.filter(~F.col("is_dir")).withColumn("_cost", F.coalesce("packed", F.lit(0)) + ENTRY_COST))
    dealt = dealt_by_bytes(wanted, "_cost", ["archive", "offset", "ordinal"], task_bytes)
    return dealt.select("archive", "entry_path", "offset", "packed", "size", "method", "flags", "crc", "error").mapInPandas(_read, CONTENT_DDL)


def archive_to_files(archives: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """Table of files of archives: pruned and filtered by name before contents are read.

    An archive that cannot be opened is kept as one row with status ``error``.
    """
    entries = archive_entries(archives)
    wanted = ~is_pruned(F.regexp_replace("entry_path", "/$", ""))
    if extensions is not None:
        wanted = wanted & extension(F.col("entry_path")).isin(extensions)
    every = entry_contents(entries.filter(F.col("error").isNotNull() | wanted))
    return every.select(
        without_zip(base_name(F.col("archive"))).alias("repo"),
        F.col("entry_path").alias("file_path"),
        "content",
        F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"),
        "error",
    )


def empty_directories(entries: DataFrame) -> DataFrame:
    """Directories an archive names itself, which are the only trace of empty ones."""
    return entries.filter(F.col("is_dir")).select(
        without_zip(base_name(F.col("archive"))).alias("repo"),
        F.regexp_replace("entry_path", "/$", "").alias("dir_path"),
    )
