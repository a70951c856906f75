"""SimHash near-duplicates by BK-trees.

A document's fingerprint has a bit set where over half of its shingles' hashes have it. Equal
fingerprints are merged first, so exact copies cost one row. Two fingerprints within the radius
must agree on some choice of blocks of their bits; fingerprints that agree on one choice form a
shard. Each shard gets a BK-tree, whose children are keyed by their distance to the parent, and
every member follows only the edges within the radius. A shard's tree travels to its members by
one shuffle instead of being broadcast, since a broadcast of all trees would grow with the
corpus. A dense shard is cut again by blocks of the bits its members may still differ in. A shard reports links to its components' least members, never all pairs.

A null or wordless text has fingerprint zero, linked like any other; fewer words than a shingle
are one shingle. Null ids are allowed, but no component is named by one unless all of its ids
are null. Repeated rows stay. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, small, stored, table, words

RADIUS = 3
SHINGLE = 3
BITS = 64
# With five blocks two of them must agree: 10 choices, shards of one in 2^25 fingerprints.
BLOCKS = 5
# Fingerprints whose trees are built at once in a task, and members searched at once.
TOGETHER = 50_000
SEARCHED = 256
# Pairs of a member and a node that are looked at in one step.
VISITED = 1 << 18
# A shard of more fingerprints is cut again, at most so many times in all.
DENSE = 20_000
CUTS = 3
# Shingle hashes whose bits are counted at once.
COUNTED = 32_768


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of each run of ``width`` words, repeats included."""
    w = F.col("words_")
    n = F.size(w)
    shingle = F.transform(
        F.sequence(F.lit(0), n - width),
        lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + k) for k in range(width)])),
    )
    few = F.array(F.xxhash64(F.array_join(w, " ")))
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < width, few).otherwise(shingle)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = np.ascontiguousarray(hashes[at : at + COUNTED], dtype="<i8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("hashes")
        flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        found = [majority(flat[a:b]) for a, b in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and fp (signed 64 bits) for each row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = docs.select("doc_id", words(ascii_lower(F.col("text"))).alias("words_"))
    hashed = cut.select("doc_id", shingle_hashes(F.col("words_"), width).alias("hashes"))
    return hashed.mapInArrow(_fingerprints, f"doc_id {kind}, fp bigint")


# BK-trees of many shards at once ---------------------------------------------------------


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits. Counted on unsigned numbers: of a negative one numpy counts the bits of
    its absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64)).astype(np.int64)


def bk_forest(shard: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One BK-tree for each shard (``shard`` is sorted): the edges (parent, distance, child),
    ordered by parent and distance. A shard's first member is its root.

    Built level by level: of the members that stand at one node at one distance, the first
    becomes the child and the others go on from it.
    """
    n = len(fp)
    root = np.r_[True, shard[1:] != shard[:-1]] if n else np.zeros(0, bool)
    stands = np.maximum.accumulate(np.where(root, np.arange(n), 0))
    waiting = np.flatnonzero(~root)
    parents, steps, children = [], [], []
    while waiting.size:
        node = stands[waiting]
        step = apart(fp[waiting], fp[node])
        order = np.lexsort((waiting, step, node))
        node, step, waiting = node[order], step[order], waiting[order]
        new = np.r_[True, (node[1:] != node[:-1]) | (step[1:] != step[:-1])]
        parents.append(node[new])
        steps.append(step[new])
        children.append(waiting[new])
        stands[waiting] = waiting[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        waiting = waiting[~new]
    if not parents:
        none = np.zeros(0, np.int64)
        return none, none, none
    parent, step, child = map(np.concatenate, (parents, steps, children))
    order = np.lexsort((step, parent))
    return parent[order], step[order], child[order]


def linked(shard: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """For each member the position of its component's least member, by searching the shard's
    tree around every member."""
    parent, step, child = bk_forest(shard, fp)
    edge = parent * (BITS + 1) + step
    n = len(fp)
    root = np.maximum.accumulate(np.where(np.r_[True, shard[1:] != shard[:-1]], np.arange(n), 0))
    label = np.arange(n)
    for at in range(0, n, SEARCHED):
        who = np.arange(at, min(n, at + SEARCHED))
        waiting = [(who, root[who])]
        while waiting:
            who, node = waiting.pop()
            if len(who) > VISITED:
                half = len(who) // 2
                waiting += [(who[half:], node[half:]), (who[:half], node[:half])]
                continue
            distance = apart(fp[who], fp[node])
            near = (distance <= radius) & (node < who)
            if near.any():
                label = joined(label, np.stack([who[near], node[near]]))
            low = np.searchsorted(edge, node * (BITS + 1) + np.maximum(distance - radius, 0))
            high = np.searchsorted(edge, node * (BITS + 1) + np.minimum(distance + radius, BITS), side="right")
            many = high - low
            who = np.repeat(who, many)
            if who.size:
                first = np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many)
                waiting.append((who, child[first + np.arange(len(who))]))
    return label


def joined(label: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Least labels after joining the two sides of each pair."""
    while True:
        a, b = label[pairs[0]], label[pairs[1]]
        differ = a != b
        if not differ.any():
            return label
        np.minimum.at(label, np.maximum(a[differ], b[differ]), np.minimum(a[differ], b[differ]))
        while (label[label] != label).any():
            label = label[label]


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of whole shards; the rows come ordered by shard and fingerprint."""

    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        shard = np.concatenate([b.column("shard").to_numpy() for b in held])
        fp = np.concatenate([b.column("fp").to_numpy() for b in held])
        label = linked(shard, fp, radius)
        tied = label != np.arange(len(fp))
        return pa.RecordBatch.from_arrays([pa.array(fp[tied]), pa.array(fp[label[tied]])], ["a", "b"])

    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= TOGETHER:
            # The last shard may go on in the next batch.
            shard = batch.column("shard").to_numpy()
            edge = int(np.searchsorted(shard, shard[-1]))
            if edge:
                held[-1] = batch.slice(0, edge)
                yield links(held)
                held = [batch.slice(edge)]
                n = held[0].num_rows
    if held:
        yield links(held)


def _chosen(fixed: int, radius: int, blocks: int) -> list[int]:
    """``fixed`` with each choice of ``blocks - radius`` blocks of the other bits."""
    free = [b for b in range(BITS) if not fixed >> b & 1]
    edges = [len(free) * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << bit for bit in free[a:b]) for a, b in zip(edges, edges[1:])]
    return [fixed | sum(chosen) for chosen in combinations(masks, blocks - radius)]


def _cut(rows: DataFrame, masks: list[list[int]]) -> DataFrame:
    """shard, fp, place: each fingerprint under every mask of its place's list. The new place
    counts through all lists."""
    signed = lambda m: F.lit(m - (1 << BITS) if m >> (BITS - 1) else m).cast("bigint")
    lists = F.array(*[F.array(*map(signed, each)) for each in masks])
    cut = rows.select("fp", "shard", "place", F.posexplode(F.get(lists, F.col("place"))).alias("i", "mask"))
    place = F.col("place") * len(masks[0]) + F.col("i")
    # The choice and the chosen bits; a shared hash would only widen a shard.
    return cut.select(F.xxhash64("shard", "i", F.col("fp").bitwiseAND(F.col("mask"))).alias("shard"), "fp", place.alias("place"))


def shards(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, dense: int = DENSE) -> DataFrame:
    """shard, fp: each fingerprint under every choice of ``blocks - radius`` blocks of its bits.
    Shards of more than ``dense`` fingerprints are cut by the same choices of the bits in which
    they may still differ, so that pairs within the radius stay together in one of the parts."""
    rows = fps.select("fp", F.lit(0).cast("bigint").alias("shard"), F.lit(0).alias("place"))
    many, fixed, done = fps.count(), [0], []
    for cuts in range(CUTS):
        masks = [_chosen(m, radius, blocks) for m in fixed]
        rows, fixed = _cut(rows, masks), [m for each in masks for m in each]
        if many <= dense or cuts == CUTS - 1:
            break
        crowded = stored(rows.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > dense).select("shard"), "crowded")
        many = dense + 1 if crowded.limit(1).count() else 0
        if not many:
            break
        done.append(rows.join(small(crowded), "shard", "left_anti"))
        rows = stored(rows.join(small(crowded), "shard", "left_semi").select("shard", "fp", "place"), "dense")
    return reduce(DataFrame.unionByName, [each.select("shard", "fp") for each in [*done, rows]])


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, dense: int = DENSE) -> DataFrame:
    """Distinct (a, b), b the less: enough links between distinct fingerprints within the
    radius to hold each component together."""
    dealt = shards(fps, radius, blocks, dense).repartition("shard").sortWithinPartitions("shard", "fp")
    return dealt.mapInArrow(partial(_links, radius=radius), "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """fp, root: the least member of each linked fingerprint's component, by rounds of hooking
    every member and then its neighbours to the least one seen. Each round is written."""
    edges = stored(edges, "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Large star: the greater neighbours of a node link to the least around it.
        big = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        big = stored(big.distinct(), "links")
        # Small star: the lesser neighbours of a node, and itself, link to the least of them.
        below = big.groupBy("a").agg(F.min("b").alias("m"))
        little = big.join(below, "a")
        edges = little.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = stored(edges.unionByName(below.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fp, component_id for each row of ``docs`` (doc_id, text)."""
    marked = stored(fingerprints(docs, width), "fingerprints")
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(fps.select("fp"), radius, blocks))
    roots = roots.unionByName(roots.select(F.col("root").alias("fp"), "root")).distinct()
    rooted = stored(
        fps.join(small(stored(roots, "roots")), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted"
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    members = stored(rooted.select("fp", "root").join(named, "root").select("fp", "component_id"), "members")
    return marked.join(small(members), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` with one row of each component: the one with the least
    id, of equal ids the one with the least text. A component whose ids are all null keeps one
    row too."""
    spread = docs.select(F.struct(F.col(id_col), F.coalesce(F.md5(text_col), F.lit(""))).alias("doc_id"), F.col(text_col).alias("text"))
    found = near_duplicates(spread, **settings)
    kept = found.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("copies_"))
    kept = stored(kept.select(F.col(f"doc_id.{id_col}").alias("id_"), F.col("doc_id.col2").alias("key_"), "copies_"), "kept")
    keyed = docs.withColumn("key_", F.coalesce(F.md5(text_col), F.lit("")))
    same = keyed[id_col].eqNullSafe(kept["id_"]) & (keyed["key_"] == kept["key_"])
    chosen = keyed.join(small(kept), same).drop(kept["id_"]).drop(kept["key_"])
    single = chosen.filter("copies_ = 1")
    if kept.filter("copies_ > 1").limit(1).count():
        single = single.unionByName(chosen.filter("copies_ > 1").dropDuplicates([id_col, "key_"]))
    return single.select(*docs.columns)


def op7_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
