"""Line dedup over levelled sorted runs of line hashes.

Documents are taken in batches of ascending id. A run is a bucketed table of line keys, sorted
within its buckets; runs never share a key. Each batch's keys are merge-joined with every run:
keys that a run holds lose all their lines in the batch, the others form a run of their own on
the lowest level. As soon as a level has ``FANOUT`` runs they are compacted into one run of the
next, so a batch meets a number of runs that grows with the logarithm of the batches before it.
All runs have the same buckets, so only a batch's own keys are shuffled, never a run.

A line's key is the line without blanks at its ends, A-Z lower-cased; keys shorter than
``LEAST`` code points are never dropped. A key is known by two 64-bit hashes. It keeps its
lines in the least document id that holds it. Within a batch the keys are counted with map-side
combining; the most frequent repeated keys meet their lines by broadcast, so a line in a third
of all documents is no hot key. All of it is DataFrame functions.

A null or empty text is one empty line. Rows of one id are one document, whatever their texts;
rows without an id are one document, after all others. Repeated rows stay. Other columns stay,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_folder
from .shared import BROADCAST_ROWS, LOWER, UPPER, least_count, put_back, set_apart, settled, small, stored, table

BLANK = " \t\n\x0b\x0c\r"
LEAST = 10
BATCHES = 6
FANOUT = 3
KEY = ["h1", "h2"]


def lowered(text: Column) -> Column:
    """Lower-cases A-Z alone; texts of ASCII take the fast way."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def key_positions(text: Column) -> Column:
    """The position and key of every line whose key is long enough."""
    trimmed = F.transform(F.split(lowered(text), "\n"), lambda line: F.btrim(line, F.lit(BLANK)))
    keyed = F.transform(
        trimmed,
        lambda line, i: F.when(
            F.length(line) >= LEAST,
            F.struct(i.alias("at"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(LEAST), line).alias("h2")),
        ),
    )
    return F.filter(keyed, lambda key: key.isNotNull())


class Runs:
    """The line keys seen so far, as levels of runs; ``levels[i]`` lists the tables of level i."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = FANOUT):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.fanout = fanout
        self.levels: list[list[str]] = []

    def _write(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = keys.select(*KEY).repartition(self.buckets, *KEY)
        writer = dealt.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", fresh_folder(self.spark, "run"))
        writer.format("parquet").saveAsTable(name)
        return name

    def held(self, keys: DataFrame) -> DataFrame:
        """``keys`` (h1, h2, ...) with old: whether a run holds the key. One merge join per run."""
        flags = []
        for i, name in enumerate(name for level in self.levels for name in level):
            flags.append(f"old_{i}")
            keys = keys.join(self.spark.table(name).withColumn(flags[-1], F.lit(True)).hint("merge"), KEY, "left")
        old = reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in flags], F.lit(False))
        return keys.withColumn("old", old).drop(*flags)

    def add(self, keys: DataFrame) -> None:
        """A new run of ``keys``, which no run holds; full levels are compacted."""
        name, at = self._write(keys), 0
        while True:
            if at == len(self.levels):
                self.levels.append([])
            self.levels[at].append(name)
            if len(self.levels[at]) < self.fanout:
                return
            full, self.levels[at] = self.levels[at], []
            name = self._write(reduce(DataFrame.union, map(self.spark.table, full)))
            self._drop(full)
            at += 1

    def close(self) -> None:
        self._drop([name for level in self.levels for name in level])
        self.levels = []

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")


def _lines(docs: DataFrame) -> tuple[DataFrame, int]:
    """A stored row for each document with keys: doc_id, key_ (its text's hash), keys, and part,
    the range of ids it lies in; and the number of ranges."""
    spark = docs.sparkSession
    made = docs.select("doc_id", F.xxhash64("text").alias("key_"), key_positions(F.col("text")).alias("keys"))
    made = settled(made, ["key_", "keys"]).filter(F.size("keys") > 0)
    parts = max(BATCHES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder = fresh_folder(spark, "lines")
    ranged = made.repartitionByRange(parts, F.asc_nulls_last("doc_id")).withColumn("part", F.spark_partition_id())
    ranged.write.partitionBy("part").parquet(folder)
    lines = spark.read.schema(ranged.schema).parquet(folder)
    last = lines.agg(F.max("part")).first()[0]
    return lines, 0 if last is None else last + 1


def _each(lines: DataFrame, batches: int, parts: int) -> DataFrame:
    """A row for each keyed line: doc_id, key_, at, h1, h2, and the batch it belongs to."""
    batch = F.floor(F.col("part") * batches / max(parts, 1)).cast("int").alias("batch")
    return lines.select(batch, "doc_id", "key_", F.explode("keys").alias("k")).select("batch", "doc_id", "key_", "k.*")


def _dropped(each: DataFrame, repeated: DataFrame) -> DataFrame:
    """doc_id, key_, drop: positions of the lines to drop, for documents that have any."""
    others = lambda met: met.filter(F.col("old") | ~F.col("owner").eqNullSafe(F.col("doc_id")))
    on, own = ["batch", *KEY], ["doc_id", "key_", "at"]
    found = repeated.select(*on, "owner", "old", "n")
    least = least_count(found, BROADCAST_ROWS)
    frequent, rare = found.filter(F.col("n") >= least), found.filter(F.col("n") < least)
    hits = others(each.join(F.broadcast(frequent), on)).select(own)
    if not rare.isEmpty():
        rest = each.join(F.broadcast(frequent.select(on)), on, "left_anti")
        hits = hits.unionByName(others(rest.join(rare, on)).select(own))
    return stored(hits.groupBy("doc_id", "key_").agg(F.collect_set("at").alias("drop")), "dropped")


def dropped_lines(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """doc_id, key_ (XXH64 of the text) and drop (positions of the dropped lines) of every text
    of ``docs`` (doc_id, text) that loses a line."""
    lines, parts = _lines(docs)
    runs, repeated = Runs(docs.sparkSession, fanout=fanout), []
    for b in range(batches):
        own = [p for p in range(parts) if p * batches // parts == b]
        if not own:
            continue
        mine = _each(lines.filter(F.col("part").between(own[0], own[-1])), batches, parts)
        keys = mine.groupBy(*KEY).agg(
            F.min("doc_id").alias("owner"),
            F.max("doc_id").alias("last"),
            F.count("*").alias("n"),
            F.count_if(F.col("doc_id").isNull()).alias("nameless"),
        )
        shared = (F.col("owner") < F.col("last")) | (F.col("owner").isNotNull() & (F.col("nameless") > 0))
        keys = keys.select(F.lit(b).alias("batch"), *KEY, "owner", "n", F.coalesce(shared, F.lit(False)).alias("shared"))
        keys = stored(runs.held(keys), "keys")
        runs.add(keys.filter(~F.col("old")))
        repeated.append(keys.filter(F.col("old") | F.col("shared")))
    runs.close()
    if not repeated:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, key_ bigint, drop array<int>")
    return _dropped(_each(lines, batches, parts), stored(reduce(DataFrame.unionByName, repeated), "repeated"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text: the lines that stay, joined by \\n."""
    held, columns, names = set_apart(docs)
    doc_id, text = F.col(columns[id_col]), F.col(columns[text_col])
    drop = dropped_lines(held.select(doc_id.alias("doc_id"), text.alias("text")), **settings)
    same = doc_id.eqNullSafe(F.col("id_")) & (F.xxhash64(text) == F.col("key_"))
    met = held.join(small(drop.withColumnRenamed("doc_id", "id_"), F.size("drop") * 4), same, "left")
    whole = F.coalesce(text, F.lit(""))
    split = settled(met.withColumn("lines_", F.split(whole, "\n")), ["lines_"])
    left = F.array_except(F.sequence(F.lit(0), F.size("lines_") - 1), "drop")
    kept = F.array_join(F.transform(left, lambda i: F.get("lines_", i)), "\n")
    made = split.select(
        *held.columns,
        F.size("lines_").cast("bigint").alias("n_lines"),
        F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).cast("bigint").alias("n_dropped"),
        F.when(F.col("drop").isNull(), whole).otherwise(kept).alias("kept_text"),
    )
    made = settled(made, ["n_lines", "n_dropped", "kept_text"])
    own = ["n_lines", "n_dropped", "kept_text"]
    return made.toDF(*names, *own)


def op13_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
