"""Phrase collocations by dynamic itemset counting.

The corpus is dealt into shards that are scanned in a cycle, one a step. Phrases of all lengths
are counted in the same scans: single words from the first step on, a longer phrase from the
step after both of its subphrases (without its last, without its first word) have reached the
threshold. For one full cycle after its activation a phrase is on probation: a phrase found
``threshold`` times in the whole corpus occurs at least threshold / shards times in some shard,
so it is admitted at the first shard where it does, and its occurrences are counted from there
until it has seen every shard once. Steps end when nothing is active any more.

Two arrays of fixed size are all that travels to the tasks, whatever the corpus: the step in
which any phrase of a bucket reached the threshold, and the last step in which one was admitted.
They only choose what is worth counting. Phrases of one bucket may be counted in vain, none is
missed, and the counts themselves are kept by the words, so results are exact. Counting is one
aggregation a step, over what tasks have counted beforehand; a common phrase is no hot key.

Words are known by 64-bit hashes while they are counted and are spelled at the end; two words of
one hash would be found there and reported as an error. The hash is of the language and the word,
so phrases of different languages never meet and the language itself is not counted by.

Null texts are empty; a null language is ``und``. Repeated rows count each. An empty table gives
no rows. Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import fresh_folder
from .shared import LOWER, UPPER, small, stored, table

THRESHOLD = 30
LONGEST = 4
SHARDS = 3
TOP = 2000
# Buckets of the two arrays, as a power of two.
BITS = 24
# Separators of pieces, and blanks inside them.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"
# Words of a task whose hash is remembered.
REMEMBERED = 400_000
# Bytes of text of a block, and of all blocks a task holds back.
BLOCK = 4 << 20
HELD_BACK = 32 << 20
# Places in a phrase's mark of the step it was admitted in and of the step it was activated in.
SINCE, ACTIVE = 40, 32
# Parts of a language's phrases ranked on their own first.
SALTS = 64
WORDS = ["w1", "w2", "w3", "w4"]
# Stands for an end of a piece; no byte of UTF-8.
_END = b"\xff"
_LOWER_CUT = bytes.maketrans(UPPER.encode() + PIECE_ENDS, LOWER.encode() + _END * len(PIECE_ENDS))


# Shards ------------------------------------------------------------------------------------


class _Hashes(dict):
    """Hashes by word of one language, worked out when first asked for; zero for what ends a
    piece. They are kept while there is room, which all languages share; ``new`` holds those
    worked out since it was taken."""

    def __init__(self, lang: str, room: list[int]):
        super().__init__({_END: 0, b"": 0})
        self.seed, self.room = xxhash.xxh64_intdigest(lang.encode()), room
        self.new: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        known = self.new[word] = xxhash.xxh64_intdigest(word, self.seed) or 1
        if self.room[0] > 0:
            self.room[0] -= 1
            self[word] = known
        return known

    def taken(self) -> dict[bytes, int]:
        new, self.new = self.new, {}
        return new


def _numbered(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words of texts of one language, with an end of a piece between texts: numbers, and
    the word of each number."""
    said = _END.join(texts).translate(_LOWER_CUT).replace(_END, b" " + _END + b" ")
    one = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(said)])), pa.py_buffer(said)])
    words = pc.ascii_split_whitespace(one).flatten().dictionary_encode()
    return words.indices.to_numpy(), words.dictionary.cast(pa.large_binary()).to_pylist()


def _block(lang: str, shard: int, texts: list[bytes], hashes: _Hashes) -> pa.RecordBatch:
    codes, words = _numbered(texts)
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    ends = (ids == 0)[codes]
    n = len(codes) - int(np.count_nonzero(ends))
    codes = codes[np.r_[True, ~(ends[1:] & ends[:-1])]]
    new = hashes.taken()
    row = {
        "lang": pa.array([lang], pa.string()),
        "n": pa.array([n], pa.int64()),
        "codes": pa.array([codes.astype(_code_type(len(ids))).tobytes()], pa.binary()),
        "ids": pa.array([ids.tobytes()], pa.binary()),
        # Words met for the first time, and their spelling.
        "new": pa.array([np.fromiter(new.values(), np.uint64, len(new)).view(np.int64)], pa.list_(pa.int64())),
        "spelled": pa.array([[w.decode() for w in new]], pa.list_(pa.string())),
        "shard": pa.array([shard], pa.int32()),
    }
    return pa.RecordBatch.from_arrays(list(row.values()), list(row))


def _code_type(n: int) -> type:
    return np.uint16 if n <= 1 << 16 else np.uint32


def _shards(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, room, row = {}, [REMEMBERED], 0
        held, sizes = defaultdict(list), Counter()

        def block(key) -> pa.RecordBatch:
            lang, shard = key
            if lang not in known:
                known[lang] = _Hashes(lang, room)
            sizes.pop(key)
            return _block(lang, shard, held.pop(key), known[lang])

        for batch in batches:
            batch.column("text").validate(full=True)
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for text, lang in zip(texts, batch.column("lang").to_pylist()):
                key = (UNKNOWN if lang is None else lang, row % shards)
                row += 1
                if text:
                    held[key].append(text)
                    sizes[key] += len(text)
                    if sizes[key] >= BLOCK:
                        yield block(key)
            if sizes.total() >= HELD_BACK:
                yield from map(block, list(sizes))
        yield from map(block, list(sizes))

    return run


def shards_of(docs: DataFrame, shards: int) -> DataFrame:
    """Stored blocks of ``docs`` (text, lang), each of one language and one shard: lang, n (its
    words), codes (places in ids, one a word and one an end of a piece), ids (hashes of the words
    in their language, zero for the end), new and spelled (hashes and spellings of words that a
    task meets first), shard."""
    spark = docs.sparkSession
    schema = "lang string, n bigint, codes binary, ids binary, new array<bigint>, spelled array<string>, shard int"
    folder = fresh_folder(spark, "shards")
    # A reader holds the blocks of one group of rows at once.
    options = {"parquet.block.row.count.limit": 32, "parquet.enable.dictionary": "false", "compression": "zstd"}
    docs.select("text", "lang").mapInArrow(_shards(shards), schema).write.options(**options).partitionBy("shard").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


# Counting ----------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shift(buckets: np.ndarray) -> np.uint64:
    """By how much a hash is shifted for its bucket."""
    return np.uint64(65 - len(buckets).bit_length())


def _occurrences(codes: np.ndarray, ids: np.ndarray, reached: np.ndarray, admitted: np.ndarray, oldest: int):
    """Every active phrase of a block with its number of occurrences: columns w1 to w4, mark
    (the step it was activated in, and its bucket) and n. ``admitted`` tells the buckets to count
    whatever their step, ``oldest`` is the first step whose phrases are on probation."""
    shift = _shift(reached)
    bucket = ids >> shift
    here = np.flatnonzero((ids != 0) & ((oldest <= 0) | admitted[bucket]))
    if len(here):
        n = np.bincount(codes, minlength=len(ids))[here]
        yield [ids[here]] + [np.zeros(len(here), np.uint64)] * (LONGEST - 1) + [bucket[here].astype(np.int64), n]
    words = ids[codes]
    reach = np.where(ids != 0, reached[bucket], 0)[codes]
    # Where the phrases of k words that reached the threshold begin, with their keys.
    at = np.flatnonzero(reach)
    key, reach = words[at], reach[at]
    for k in range(2, LONGEST + 1):
        # Both the phrase without its last and the one without its first word.
        both = np.flatnonzero(at[1:] - at[:-1] == 1)
        if not len(both):
            return
        active = np.maximum(reach[both], reach[both + 1])
        at = at[both]
        key = _mix(key[both] * np.uint64(0x9E3779B97F4A7C15) + words[at + (k - 1)])
        bucket = key >> shift
        here = np.flatnonzero((active >= max(oldest, 0)) | admitted[bucket])
        if len(here):
            here = here[np.argsort(key[here])]
            sorted_, begins = key[here], at[here]
            new = sorted_[1:] != sorted_[:-1]
            for i in range(k):
                said = codes[begins + i]
                new |= said[1:] != said[:-1]
            first = np.flatnonzero(np.r_[True, new])
            n = np.diff(np.r_[first, len(here)])
            one, begins = here[first], begins[first]
            columns = [words[begins + i] if i < k else np.zeros(len(first), np.uint64) for i in range(LONGEST)]
            yield columns + [active[one].astype(np.int64) << ACTIVE | bucket[one].astype(np.int64), n]
        # A bucket may have been opened by another phrase before this one was active: longer ones
        # are activated by whichever came last.
        opened = reached[bucket]
        there = np.flatnonzero(opened)
        at, key, reach = at[there], key[there], np.maximum(active, opened)[there]


def packed(*arrays: np.ndarray) -> tuple[bytes, ...]:
    """Arrays of bytes, mostly zeros while a corpus is small, compressed."""
    import zstandard

    return tuple(zstandard.ZstdCompressor(level=1).compress(a.tobytes()) for a in arrays)


def unpacked(parts: tuple[bytes, ...]) -> list[np.ndarray]:
    import zstandard

    return [np.frombuffer(zstandard.ZstdDecompressor().decompress(p), np.uint8) for p in parts]


def _count(arrays, step: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached, since = unpacked(arrays.value)
        admitted = (since > 0) & (since > max(step - shards, 0))
        for batch in batches:
            for codes, ids in zip(batch.column("codes"), batch.column("ids")):
                ids = np.frombuffer(ids.as_buffer(), np.uint64).copy()
                codes = np.frombuffer(codes.as_buffer(), _code_type(len(ids))).astype(np.intp)
                for found in _occurrences(codes, ids, reached, admitted, step - shards):
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64), pa.int64()) for c in found], [*WORDS, "mark", "n"])

    return run


_COUNTED = ", ".join(f"{name} bigint" for name in [*WORDS, "mark", "n"])


def frequent_phrases(dealt: DataFrame, threshold: int = THRESHOLD, shards: int = SHARDS) -> DataFrame:
    """w1 to w4 (0 where the phrase is shorter) and n of every phrase of up to ``LONGEST`` words
    that occurs ``threshold`` times or more."""
    spark = dealt.sparkSession
    reached, admitted = (np.zeros(1 << BITS, np.uint8) for _ in range(2))
    held, done, last, step = None, [], 0, 0
    # What is known of a phrase is one number: the step it was admitted in (0: not yet), the step
    # it was activated in, its bucket.
    since, active = F.shiftright("mark", SINCE), F.shiftright("mark", ACTIVE).bitwiseAND(F.lit((1 << SINCE - ACTIVE) - 1))
    bucket_ = F.col("mark").bitwiseAND(F.lit((1 << ACTIVE) - 1))
    while True:
        step += 1
        sent = spark.sparkContext.broadcast(packed(reached, admitted))
        mine = dealt.filter(F.col("shard") == (step - 1) % shards).select("codes", "ids")
        seen = mine.mapInArrow(_count(sent, step, shards), _COUNTED)
        both = seen if held is None else seen.unionByName(held)
        # Tasks have counted beforehand: rows are dealt first and added up once.
        total = both.repartition(*WORDS).groupBy(*WORDS).agg(
            F.sum("n").alias("n"), F.sum(F.when(since > 0, F.col("n")).otherwise(F.lit(0))).alias("before"), F.max("mark").alias("mark")
        )
        # On probation a phrase is admitted where it has its share of the threshold.
        fresh = (F.col("n") * shards >= threshold) & (active + shards >= step)
        state = total.filter((since > 0) | fresh).select(
            *WORDS, "n", "before", F.when(since > 0, F.col("mark")).otherwise(F.col("mark") + (step << SINCE)).alias("mark")
        )
        state = stored(state, f"step-{step}")
        sent.destroy()
        over = since + shards - 1 <= step
        done.append(state.filter(over & (F.col("n") >= threshold)).select(*WORDS, "n"))
        held = state.filter(~over).select(*WORDS, "mark", "n")
        # No more rows than buckets reach the driver.
        hits = (F.col("n") >= threshold) & (F.col("before") < threshold) & (F.col(WORDS[-1]) == 0)
        news = state.select(bucket_.alias("bucket"), hits.alias("hit"), (since == step).alias("new")).filter("hit or new")
        news = news.groupBy("bucket").agg(F.max("hit").alias("hit"), F.max("new").alias("new")).toArrow()
        bucket = news["bucket"].to_numpy()
        hit, new = (bucket[news[c].to_numpy()] for c in ("hit", "new"))
        admitted[new] = step
        open_ = hit[reached[hit] == 0]
        reached[open_] = step
        last = step if len(open_) else last
        if step >= last + shards and not (admitted.max() and step < admitted.max() + shards - 1):
            return reduce(DataFrame.unionByName, done)


# Scores ------------------------------------------------------------------------------------


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(2000000 a / (l + r)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(2_000_000).cast("decimal(8,0)") * wide(a), wide(left) + wide(right))


def scored(frequent: DataFrame) -> DataFrame:
    """The candidates that stay, from ``frequent`` (p: an array of words of one language, n): p, a,
    l, r and score of the lowest-scoring cut."""
    frequent = stored(frequent.select("p", "n"), "phrases")
    long_ = frequent.filter(F.size("p") > 1).select("p", F.col("n").alias("a"))
    cuts = long_.select("p", "a", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("k"))
    cuts = cuts.withColumns({"head_": F.slice("p", F.lit(1), F.col("k")), "rest_": F.slice("p", F.col("k") + 1, F.size("p") - F.col("k"))})
    part = lambda key, n: small(frequent.select(F.col("p").alias(key), F.col("n").alias(n)), F.lit(64))
    cuts = cuts.join(part("head_", "l"), "head_").join(part("rest_", "r"), "rest_")
    cuts = cuts.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    lowest = cuts.groupBy("p", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # The highest count of a longer phrase around each phrase.
    spans = [(i, n) for n in range(2, LONGEST) for i in range(LONGEST - n + 1)]
    inner = F.array(*[F.when(F.size("p") >= i + n, F.when(F.size("p") > n, F.slice("p", i + 1, n))) for i, n in spans])
    around = long_.filter(F.size("p") > 2).select("a", F.explode(F.filter(inner, lambda x: x.isNotNull())).alias("p"))
    around = stored(around.groupBy("p").agg(F.max("a").alias("most")), "around")
    met = lowest.join(small(around, F.lit(64)), "p", "left")
    wide = lambda name: F.col(name).cast("decimal(20,0)")
    stays = F.col("most").isNull() | (100 * wide("most") < 80 * wide("a"))
    return met.filter(stays).select("p", "a", "cut.l", "cut.r", "cut.score")


def best(rows: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` rows of each lang, with rank: parts of a lang are ranked on their own
    first, so no task sorts a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("salt_", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt_").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.drop("salt_").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    return ranked.filter(F.col("rank") <= top)


def collocations(docs: DataFrame, threshold: int = THRESHOLD, shards: int = SHARDS, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language of ``docs``
    (text, lang)."""
    dealt = shards_of(docs, shards)
    frequent = stored(frequent_phrases(dealt, threshold, shards), "frequent")
    p = F.filter(F.array(*WORDS), lambda w: w != 0)
    kept = stored(scored(frequent.select(p.alias("p"), "n")).withColumn("id_", F.monotonically_increasing_id()), "scored")
    # Spelling: only words that stand in a phrase.
    wanted = stored(kept.select(F.explode("p").alias("w")).distinct(), "wanted")
    pairs = dealt.select("lang", F.inline(F.arrays_zip("new", "spelled")).alias("w", "word"))
    # Every task has spelled its own words. Each word once comes before the join, which as a
    # semi-join would be moved below this.
    words = stored(pairs.distinct().join(small(wanted), "w"), "spelled")
    if not words.groupBy("w").count().filter("count > 1").isEmpty():
        raise ValueError("two words share a hash")
    each = kept.select("id_", F.posexplode("p").alias("at", "w")).join(small(words, F.octet_length("word")), "w")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    phrases = each.groupBy("id_").agg(said.alias("phrase"), F.first("lang").alias("lang"))
    totals = dealt.groupBy("lang").agg(F.sum("n").alias("n"))
    found = best(kept.join(phrases, "id_"), top).join(F.broadcast(totals.filter("n > 0")), "lang")
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_itemset_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))
