"""Token ids in blocks of byte planes.

Ids of a run of documents fill blocks of a fixed number of ids. A block is transposed into four
byte planes (all lowest bytes, then all second bytes, and so on) and each plane is compressed
with zstandard: a plane of high bytes is nearly constant and vanishes. The file format is a
Parquet folder with one row per block: where it lies (``part``, ``block``), its number of ids,
its planes, and the chunk index ``docs``, one entry for each document that has ids in the block.

Null texts count as empty, so such a document holds the end id alone. Rows with equal ids are
ordered by their text; repeated rows are kept. An empty table gives an empty folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import fresh_folder
from .pretokens import END, word_encoder
from .shared import table, text_key

BLOCK_IDS = 65_536
LEVEL = 3

_ENTRY = "struct<doc_id:bigint,number:bigint,first:bigint,n_tokens:bigint,begin:int,end:int>"
BLOCKS = f"part int, block int, n_ids int, planes array<binary>, docs array<{_ENTRY}>"


def planes_of(ids: bytes, level: int = LEVEL) -> list[bytes]:
    """The compressed byte planes of little-endian unsigned 32-bit ids, lowest bytes first."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=level).compress
    split = np.frombuffer(ids, dtype=np.uint8).reshape(-1, 4).T
    return [pack(np.ascontiguousarray(plane).tobytes()) for plane in split]


def ids_of(planes: list[bytes]) -> bytes:
    """The ids of a block again."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    split = np.stack([np.frombuffer(unpack(p), dtype=np.uint8) for p in planes])
    return np.ascontiguousarray(split.T).tobytes()


def _blocks(batches: Iterator[pa.RecordBatch], block_ids: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    encoder = word_encoder()
    end = END.to_bytes(4, "little")
    size = 4 * block_ids
    held, docs, block, number, first = bytearray(), [], 0, 0, 0

    def cut(n: int) -> pa.RecordBatch:
        nonlocal block, docs
        row = {
            "part": [part], "block": [block], "n_ids": [n // 4],
            "planes": [planes_of(bytes(held[:n]))], "docs": [docs],
        }
        del held[:n]
        block, docs = block + 1, []
        return pa.RecordBatch.from_pydict(row, schema=_ARROW)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = encoder.encode(text.as_py()) + end
            n, at = len(ids) // 4, 0
            while at < len(ids):
                step = min(size - len(held), len(ids) - at)
                begin = len(held) // 4
                docs.append(
                    {"doc_id": doc_id, "number": number, "first": first, "n_tokens": n, "begin": begin, "end": begin + step // 4}
                )
                held += ids[at : at + step]
                at += step
                if len(held) == size:
                    yield cut(size)
            number, first = number + 1, first + n
    if held:
        yield cut(len(held))


_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int32()),
        ("n_ids", pa.int32()),
        ("planes", pa.list_(pa.binary())),
        (
            "docs",
            pa.list_(
                pa.struct(
                    [
                        ("doc_id", pa.int64()),
                        ("number", pa.int64()),
                        ("first", pa.int64()),
                        ("n_tokens", pa.int64()),
                        ("begin", pa.int32()),
                        ("end", pa.int32()),
                    ]
                )
            ),
        ),
    ]
)


def write_blocks(docs: DataFrame, folder: str, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order. A part is one range
    of doc_id; equal ids are spread by their text."""
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    ranged = chosen.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ranged.mapInArrow(partial(_blocks, block_ids=block_ids), BLOCKS).write.option("compression", "none").parquet(folder)


_SEGMENTS = pa.schema(
    [
        ("part", pa.int32()),
        ("number", pa.int64()),
        ("block", pa.int32()),
        ("doc_id", pa.int64()),
        ("first", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("ids", pa.binary()),
    ]
)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            block = {name: batch.column(name)[row].as_py() for name in ("part", "block", "planes", "docs")}
            ids = ids_of(block["planes"])
            out = {name: [] for name in _SEGMENTS.names}
            for d in block["docs"]:
                own = ids[4 * d["begin"] : 4 * d["end"]]
                complete = d["end"] - d["begin"] == d["n_tokens"]
                for name in ("doc_id", "number", "first", "n_tokens"):
                    out[name].append(d[name])
                out["part"].append(block["part"])
                out["block"].append(block["block"])
                out["ids_crc32"].append(zlib.crc32(own) if complete else None)
                out["ids"].append(None if complete else own)
            yield pa.RecordBatch.from_pydict(out, schema=_SEGMENTS)


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document and block: the checksum of a document inside one block, else
    the ids of its part of the block."""
    types = "part int, number bigint, block int, doc_id bigint, first bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
    return spark.read.schema(BLOCKS).parquet(folder).mapInArrow(_read, types)


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    Only documents that cross a block's edge are shuffled with their ids.
    """
    segments = read_segments(spark, folder)
    pieces = F.sort_array(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("block", "ids"))))
    joined = F.aggregate(pieces, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    docs = segments.groupBy("part", "number").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("first").alias("first"),
        F.first("n_tokens").alias("n_tokens"),
        F.coalesce(F.max("ids_crc32"), F.crc32(joined)).alias("ids_crc32"),
    )
    # One row for each part: the number of ids in all parts before it.
    sums = spark.read.schema(BLOCKS).parquet(folder).groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    return docs.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def op4_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "bit-planes")
    write_blocks(table(spark, sf_dir, "documents"), folder)
    return read_digests(spark, folder)
