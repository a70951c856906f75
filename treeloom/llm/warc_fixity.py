"""Merkle fixity audit of WARC replicas.

A record's leaf is the SHA-256 of its bytes with its offset and length. Leaves are gathered by
ranges of offset: a node of the lowest level covers ``RANGE`` bytes of an archive, a node above
it ``FANOUT`` nodes below, up to one root per archive. Which node a record falls into follows
from its own offset, so no ordering of an archive is needed, every group is bounded by its
range, and all levels are plain aggregations. Replicas are compared root by root, and only the
children of differing nodes are looked at on the level below, down to the damaged records.

A record with null bytes hashes like an empty one of unknown length and differs from it. Rows
that repeat an archive and offset are all part of the leaf's range, and the record is compared
by all its copies. A null archive or offset is a place of its own. An archive missing from a replica is reported record by record. Empty
replicas give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import small, stored, table

RANGE = 1 << 18
FANOUT = 16
# Pages to an archive.
PAGES = 512


def warc_record(record_id: Column, uri: Column, body: Column) -> Column:
    """One WARC resource record as bytes; a missing body or address is empty."""
    payload = F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(payload).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.encode(F.concat(head, payload, F.lit("\r\n\r\n")), "UTF-8")


def page_archives(pages: DataFrame, per_archive: int = PAGES) -> DataFrame:
    """page_id, archive, offset, record: pages as the records of WARC files, in page order.
    Pages without an id are spread over archives of their own by their text."""
    odd = -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1024))
    archive = F.coalesce(F.floor(F.col("page_id") / per_archive), odd)
    made = pages.select("page_id", archive.alias("archive"), warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    # An archive is bounded by the number of its ids.
    before = Window.partitionBy("archive").orderBy("page_id", F.sha2("record", 256)).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.octet_length("record").cast("bigint")).over(before), F.lit(0))
    return made.select("page_id", "archive", offset.cast("bigint").alias("offset"), "record")


def leaves(records: DataFrame) -> DataFrame:
    """archive, offset, length, hash: one row for each place, its records in order of hash."""
    digest = F.coalesce(F.sha2("record", 256), F.lit("null"))
    each = records.select("archive", "offset", F.octet_length("record").cast("bigint").alias("length"), digest.alias("hash"))
    return each.groupBy("archive", "offset").agg(
        F.max("length").alias("length"), F.array_join(F.sort_array(F.collect_list("hash")), ",").alias("hash")
    )


def level_above(nodes: DataFrame, place: Column, fanout: int) -> DataFrame:
    """archive, node, hash: the nodes that each cover ``fanout`` places below."""
    entry = F.struct(place.alias("p"), F.col("hash").alias("h"))
    listed = nodes.groupBy("archive", F.floor(place / fanout).alias("node")).agg(F.sort_array(F.collect_list(entry)).alias("below"))
    text = F.array_join(F.transform("below", lambda e: F.concat_ws(":", e["p"].cast("string"), e["h"])), ";")
    return listed.select("archive", "node", F.sha2(text, 256).alias("hash"))


def merkle_tree(records: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT, depth: int | None = None) -> list[DataFrame]:
    """Levels from the leaves to the roots; ``depth`` levels above the leaves, by default as
    many as give one root per archive."""
    levels = [stored(leaves(records), "leaves")]
    if depth is None:
        depth = tree_depth(levels[0], range_bytes, fanout)
    lowest = levels[0].withColumn("hash", F.concat_ws("/", F.col("length").cast("string"), "hash"))
    levels.append(stored(level_above(lowest, F.col("offset"), range_bytes), "tree"))
    for _ in range(depth - 1):
        levels.append(stored(level_above(levels[-1], F.col("node"), fanout), "tree"))
    return levels


def tree_depth(records: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT) -> int:
    """Levels above the leaves until one node covers the farthest offset."""
    last = (records.agg(F.max("offset")).first()[0] or 0) // range_bytes
    depth = 1
    while last:
        last //= fanout
        depth += 1
    return depth


def audit(left: DataFrame, right: DataFrame, range_bytes: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """archive, offset, status (changed, missing, extra), length and hash on both sides: the
    records in which the replica ``right`` differs from ``left``."""
    depth = max(tree_depth(left, range_bytes, fanout), tree_depth(right, range_bytes, fanout))
    ours = merkle_tree(left, range_bytes, fanout, depth)
    theirs = merkle_tree(right, range_bytes, fanout, depth)

    def differing(a: DataFrame, b: DataFrame, place: str) -> DataFrame:
        side = lambda df, name: df.select(*[F.col(c).alias(f"{name}_{c}") for c in df.columns])
        same = F.col("left_archive").eqNullSafe(F.col("right_archive")) & F.col(f"left_{place}").eqNullSafe(F.col(f"right_{place}"))
        both = side(a, "left").join(side(b, "right"), same, "full")
        found = both.filter(~F.col("left_hash").eqNullSafe(F.col("right_hash")))
        keys = [F.coalesce(f"left_{c}", f"right_{c}").alias(c) for c in ("archive", place)]
        rest = [c for c in both.columns if c.endswith(("_length", "_hash"))]
        return found.select(*keys, *rest)

    marked = None
    for level in range(depth, -1, -1):
        place = "node" if level else "offset"
        a, b = ours[level], theirs[level]
        if marked is not None:
            parent = F.floor(F.col(place) / (fanout if level else range_bytes))
            keep = small(marked.select(F.col("archive").alias("in_"), F.col("node").alias("under_")))
            below = F.col("archive").eqNullSafe(F.col("in_")) & parent.eqNullSafe(F.col("under_"))
            a, b = (x.join(keep, below, "left_semi") for x in (a, b))
        marked = stored(differing(a, b, place), "differing")
    status = F.when(F.col("right_hash").isNull(), "missing").when(F.col("left_hash").isNull(), "extra").otherwise("changed")
    return marked.select("archive", "offset", status.alias("status"), "left_length", "right_length", "left_hash", "right_hash")


def damaged(records: DataFrame) -> DataFrame:
    """A replica with known damage: of every 89 pages one record has its last byte changed, one
    is cut in half, one is lost, and one is written again past the archive's end."""
    kind = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(89))
    size = F.octet_length("record")
    flipped = F.concat(F.substring("record", 1, size - 1), F.encode(F.lit("X"), "UTF-8"))
    bytes_ = F.when(kind == 11, flipped).when(kind == 23, F.expr("substring(record, 1, octet_length(record) div 2)")).otherwise(F.col("record"))
    held = records.filter(kind != 37).withColumn("record", bytes_)
    again = records.filter(kind == 53).withColumn("offset", F.col("offset") + (1 << 34))
    return held.unionByName(again)


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = page_archives(table(spark, sf_dir, "pages"))
    return audit(records, damaged(records))
