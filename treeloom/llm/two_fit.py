"""Best-two-fit packing of documents into sequences.

Documents of one length are interchangeable, so the packing is planned on the histogram of
lengths, which has as many rows as a sequence has places, whatever the corpus. A bin is filled
greedily, the longest document that fits first; then its smallest document is replaced by two
unpacked ones that fill the widened gap more tightly, as long as such a pair exists. A bin's
pattern is repeated as often as the remaining documents allow, so the plan is short too.
Documents are then numbered within their length by a distributed numbering and look up their
place. No document passes the driver.

Null texts count as empty: one piece holding the end id. Repeated rows are packed each on its
own. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import numbered
from .pretokens import END, byte_encoder
from .shared import stored, table

CAPACITY = 1024
_RANKS = 1 << 50


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (how often each length occurs in a bin) and how many bins have each."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    every = np.arange(capacity + 1)
    plan = []
    while left.any():
        rest = left.copy()
        bin_, gap = Counter(), capacity

        def fill() -> None:
            nonlocal gap
            while gap:
                fits = np.flatnonzero(rest[1 : gap + 1])
                if not fits.size:
                    return
                length = int(fits[-1]) + 1
                bin_[length] += 1
                rest[length] -= 1
                gap -= length

        fill()
        while gap and bin_.total() > 1:
            least = min(bin_)
            room = gap + least
            pair = best_pair(rest, every, room, least)
            if pair is None:
                break
            bin_[least] -= 1
            rest[least] += 1
            for length in pair:
                bin_[length] += 1
                rest[length] -= 1
            bin_ += Counter()
            gap = room - sum(pair)
        times = min(int(left[length]) // n for length, n in bin_.items())
        for length, n in bin_.items():
            left[length] -= times * n
        plan.append((dict(bin_), times))
    return plan


def best_pair(rest: np.ndarray, every: np.ndarray, room: int, over: int) -> tuple[int, int] | None:
    """The two remaining lengths with the largest sum above ``over`` and within ``room``."""
    there = np.maximum.accumulate(np.where(rest[: room + 1] > 0, every[: room + 1], 0))
    first = np.flatnonzero(rest[:room] > 0)
    if not first.size:
        return None
    second = there[room - first]
    # A length that occurs once cannot pair with itself: take the next one below.
    alone = (second == first) & (rest[first] < 2)
    second = np.where(alone, there[np.maximum(first - 1, 0)], second)
    total = np.where(second > 0, first + second, 0)
    best = int(total.argmax())
    if total[best] <= over:
        return None
    return int(first[best]), int(second[best])


def places(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For each length and pattern: the first rank it takes, its first bin, how many such
    documents a bin has, and the place of the first of them. Ordered by length and rank."""
    taken, rows, first_bin = Counter(), [], 0
    for pattern, times in plan:
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            rows.append((length * _RANKS + taken[length], length, taken[length], first_bin, n, offset))
            taken[length] += n * times
            offset += n * length
        first_bin += times
    rows.sort()
    cells = np.array(rows, dtype=np.int64).reshape(-1, 6)
    return dict(zip(("key", "length", "rank", "bin", "each", "offset"), cells.T))


def _pieces(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    encoder = byte_encoder()
    end = END.to_bytes(4, "little")
    for batch in batches:
        out = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = encoder.encode(text.as_py()) + end
            n = len(ids) // 4
            # Only the first piece may be short.
            edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
            for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                out["doc_id"].append(doc_id)
                out["piece"].append(piece)
                out["start"].append(a)
                out["length"].append(b - a)
                out["ids_crc32"].append(zlib.crc32(ids[4 * a : 4 * b]))
        yield pa.RecordBatch.from_pydict(out, schema=_PIECE)


_PIECE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents with their end id, the long ones cut."""
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    types = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    return chosen.mapInArrow(partial(_pieces, capacity=capacity), types)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces of at most ``capacity`` (a column ``length``)."""
    cut = stored(cut.withColumn("row_", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    at = places(plan_bins(counts, capacity))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(), rank.to_numpy() - 1
        row = np.searchsorted(at["key"], length * _RANKS + rank, side="right") - 1
        step = rank - at["rank"][row]
        each = at["each"][row]
        return pd.DataFrame(
            {"sequence_id": at["bin"][row] + step // each, "offset": at["offset"][row] + step % each * length}
        )

    ranked = numbered(cut, ["length"], ["row_"], "rank_")
    return ranked.withColumn("at_", placed("length", "rank_")).select(
        *[c for c in cut.columns if c != "row_"], "at_.sequence_id", "at_.offset"
    )


def op6_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents")))
