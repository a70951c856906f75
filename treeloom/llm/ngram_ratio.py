"""Quality rules: a few counts of each text, then a hashed n-gram likelihood ratio.

Words and word pairs are hashed into buckets. Two multinomials over the buckets are counted:
one over the trusted documents (those labelled good), one over all documents. A document's
score is the mean over its n-grams of ln(trusted / raw), in whole thousandths, so that sums
are exact and every document gets the same verdict on every run. Documents below the threshold
are rejected. All of it is DataFrame functions.

Null texts have no words and fail the base rules, as do empty ones. Repeated rows stay, each
with its own verdict. Labels may repeat or contradict: a document is trusted if no label calls
it bad. With no trusted document at all every n-gram scores 0. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BLANKS, constant_array, settled, small, stored, table, words

BUCKETS = 1 << 17
# Occurrences added to every bucket of both multinomials.
SMOOTHING = 5.0
# Mean score, in thousandths of a nat, that a document must reach.
THRESHOLD = -160
WINDOW = 5
LEAST_WORDS = 10
REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    and words_ (hashes of the words) for the steps that follow."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    w = F.col("words_")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    starts = F.sequence(F.lit(0), F.size(w) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))
    none = F.array().cast("array<bigint>")
    cut = docs.withColumns({"words_": hashed_words(F.col(text_col)), "lines_": lines})
    first = settled(cut, ["words_", "lines_"]).withColumn("windows_", F.when(F.size(w) >= WINDOW, hashes).otherwise(none))
    # Windows in order of their hash stand beside their equals; texts without any skip this.
    pairs = F.sort_array(F.transform("windows_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("windows_")) < F.size("windows_")
    second = first.withColumn("pairs_", F.when(repeats, pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    p = F.col("pairs_")

    def beside(pair: Column, j: Column, by: int) -> Column:
        return F.coalesce(F.get(p, j + by)["h"] == pair["h"], F.lit(False))

    found = F.filter(p, lambda pair, j: beside(pair, j, -1) | beside(pair, j, 1))
    third = second.withColumn("repeated_", F.sort_array(F.transform(found, lambda pair: pair["i"])))
    covered = F.aggregate(
        "repeated_",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + s + WINDOW - F.greatest(s, acc["end"])).alias("n"), (s + WINDOW).alias("end")
        ),
    )["n"]
    counted = third.select(
        *docs.columns,
        "words_",
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("bigint").alias("n_dup_lines"),
        covered.cast("bigint").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def hashed_words(text: Column) -> Column:
    """A hash of each word: windows, words and pairs are all made of these."""
    return F.transform(words(text, BLANKS), lambda w: F.xxhash64(w))


def grams(w: Column) -> Column:
    """The bucket of every word and of every pair of words, from the words' hashes."""
    bucket = lambda h: h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")
    ones = F.transform(w, lambda x: bucket(x))
    twos = F.transform(w, lambda x, i: bucket(F.xxhash64(F.get(w, i - 1), x)))
    return F.concat(ones, F.slice(twos, 2, F.greatest(F.size(w) - 1, F.lit(0))))


def trusted_ids(labels: DataFrame) -> DataFrame:
    marked = labels.groupBy(F.col("doc_id").alias("trusted_")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return marked.filter((F.col("q") == 1) & (F.coalesce("t", F.lit(0)) == 0)).select("trusted_")


def weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """1000 ln(trusted / raw) of every bucket, smoothed. The counts of all documents meet in
    one row for each bucket, so what reaches the driver never grows."""
    trusted = stored(trusted_ids(labels), "trusted")
    marked = docs.select(id_col, text_col).join(small(trusted), F.col(id_col) == F.col("trusted_"), "left")
    cut = marked.select(F.col("trusted_").isNotNull().cast("int").alias("t"), hashed_words(F.col(text_col)).alias("words_"))
    cut = settled(cut, ["words_"])
    # An inner explode would be given a filter on its size, which works the grams out twice.
    each = cut.select("t", F.explode_outer(grams(F.col("words_"))).alias("bucket"))
    counts = each.filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("t").alias("t")).toPandas()
    n, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    n[counts["bucket"]], t[counts["bucket"]] = counts["n"], counts["t"]
    if not t.any():
        return [0] * BUCKETS
    # Both at the trusted corpus' size, so that a rare n-gram says little either way.
    expected = n * (t.sum() / n.sum())
    return np.rint(1000 * np.log((t + SMOOTHING) / (expected + SMOOTHING))).astype(int).tolist()


def judged(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD
) -> DataFrame:
    """``docs`` with the base counts, base_failed, score (thousandths) and kept. The statistics
    are those of all of ``docs``; each verdict is worked out within its row."""
    table_ = constant_array(weights(docs, labels, id_col, text_col))
    base = base_counts(docs, id_col, text_col).withColumn("grams_", grams(F.col("words_")))
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    total = F.aggregate("grams_", F.lit(0).cast("bigint"), lambda acc, g: acc + F.get(table_, g))
    mean = F.floor(total / F.greatest(F.size("grams_"), F.lit(1)))
    scored = base.withColumn("score", mean).drop("words_", "grams_")
    return settled(scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold)), made)


def op5_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, table(spark, sf_dir, "labels")).drop("text")
