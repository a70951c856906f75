"""Benchmark decontamination by a positional inverted index.

A window is ten consecutive words of a benchmark item. The corpus is counted for the windows'
terms, the rarest terms of each window become its anchors, and the index holds postings (term,
document, position) of anchors alone. A window's posting lists, each shifted by the term's
offset, are intersected from the rarest on; what is left is compared word by word with the
document, so matches are exact. Proximity matches are found from the places of the terms that
a match cannot do without. All of it is DataFrame functions.

Words are lower-cased in A-Z only. Null or wordless texts have no words and no hits. Null
item ids hit like others but are not listed. Rows that repeat a document keep a result each;
repeated items count once. Empty tables give no hits, or no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import NON_WORDS, ascii_lower, settled, small, stored, table, words

WIDTH = 10
ANCHORS = 2


def _words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("words_", words(ascii_lower(F.col(text_col)), NON_WORDS))


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """window (its words, blank between), terms, items: the distinct windows of all items. An
    item of fewer words, but not none, is one window."""
    cut = _words(benchmark.select(F.col("item_id").cast("string").alias("item"), "text"))
    n = F.size("words_")
    starts = F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1)))
    each = cut.filter(n > 0).select(
        "item", F.explode(F.transform(starts, lambda s: F.slice(F.col("words_"), s, width))).alias("terms")
    )
    return each.groupBy(F.array_join("terms", " ").alias("window"), "terms").agg(F.collect_set("item").alias("items"))


def _postings(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    cut = _words(docs.select(F.col(id_col).alias("doc_"), F.xxhash64(text_col).alias("key_"), F.col(text_col).alias("text_")), "text_")
    return cut.select("doc_", "key_", F.posexplode("words_").alias("pos", "term")).join(small(terms), "term")


def anchors(docs: DataFrame, found: DataFrame, text_col: str = "text", many: int = ANCHORS) -> DataFrame:
    """term, offset, window, n_anchors: the ``many`` rarest terms of each window by their
    occurrences in the whole corpus. A window with a term that never occurs has none."""
    spread = found.select("window", F.posexplode("terms").alias("offset", "term"))
    terms = stored(spread.select("term").distinct(), "terms")
    cut = _words(docs.select(text_col), text_col).select(F.explode("words_").alias("term"))
    counts = cut.join(small(terms, F.octet_length("term")), "term").groupBy("term").agg(F.count("*").alias("n"))
    counted = spread.join(stored(counts, "term-counts"), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    window = Window.partitionBy("window")
    ranked = counted.select(
        "*",
        F.row_number().over(window.orderBy("n", "term", "offset")).alias("rank"),
        F.min("n").over(window).alias("rarest"),
        F.least(F.count("*").over(window), F.lit(many)).alias("n_anchors"),
    )
    return ranked.filter((F.col("rank") <= many) & (F.col("rarest") > 0)).select("term", "offset", "window", "n_anchors")


def candidates(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, many: int = ANCHORS) -> DataFrame:
    """doc_, key_, start, window: where all anchors of a window stand at their offsets."""
    chosen = stored(anchors(docs, found, text_col, many), "anchors")
    terms = stored(chosen.select("term").distinct(), "anchor-terms")
    index = _postings(docs, id_col, text_col, terms)
    shifted = index.join(small(chosen, F.octet_length("window")), "term").select(
        "doc_", "key_", "window", (F.col("pos") - F.col("offset")).alias("start"), "n_anchors"
    )
    lists = shifted.filter("start >= 0").groupBy("doc_", "key_", "window", "start")
    # Repeated rows of a document bring each posting as often as the document stands there.
    met = lists.agg(F.count("*").alias("met"), F.max("n_anchors").alias("n_anchors"))
    return met.filter("met >= n_anchors").select("doc_", "key_", "start", "window")


def _beside(docs: DataFrame, found: DataFrame, near: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with words_ and, as near_, each candidate's start, window, terms and items."""
    listed = near.join(small(found, F.octet_length("window")), "window").groupBy("doc_", "key_").agg(
        F.collect_set(F.struct("start", "window", "terms", "items")).alias("near_")
    )
    listed = stored(listed, "candidates")
    width = F.aggregate("near_", F.lit(0).cast("bigint"), lambda acc, c: acc + 3 * F.octet_length(c["window"]) + 64)
    keyed = _words(docs.withColumn("key_", F.xxhash64(text_col)), text_col)
    same = keyed[id_col].eqNullSafe(F.col("doc_")) & (keyed["key_"] == F.col("other_"))
    return keyed.join(small(listed.withColumnRenamed("key_", "other_"), width), same, "left")


def judged(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_items (sorted strings) and contaminated."""
    found = stored(windows(benchmark, width), "windows")
    near = candidates(docs, found, id_col, text_col)
    both = _beside(docs, found, near, id_col, text_col)
    at = lambda c: F.array_join(F.slice("words_", c["start"] + 1, F.size(c["terms"])), " ")
    exact = F.filter(F.coalesce("near_", F.array().cast(both.schema["near_"].dataType)), lambda c: at(c) == c["window"])
    hits = both.withColumn("hits_", exact)
    covered = F.flatten(F.transform("hits_", lambda c: F.sequence(c["start"], c["start"] + F.size(c["terms"]) - 1)))
    items = F.sort_array(F.array_distinct(F.flatten(F.transform("hits_", lambda c: c["items"]))))
    made = ["n_words", "n_hit", "hit_items", "contaminated"]
    found = hits.select(
        *docs.columns,
        F.size("words_").cast("bigint").alias("n_words"),
        F.size(F.array_distinct(covered)).cast("bigint").alias("n_hit"),
        items.alias("hit_items"),
        (F.size("hits_") > 0).alias("contaminated"),
    )
    return settled(found, made)


def _rarest(docs: DataFrame, found: DataFrame, share: float) -> DataFrame:
    """term, window, needed, stretch's terms: for each window as many of its rarest distinct
    terms that a place with ``share`` of all of them must hold one of these."""
    distinct = found.select("window", "items", F.array_distinct("terms").alias("terms"))
    needed = F.ceil(F.size("terms") * share).cast("int")
    spread = distinct.withColumn("needed", needed).select("window", "terms", "items", "needed", F.explode("terms").alias("term"))
    terms = stored(spread.select("term").distinct(), "near-terms")
    cut = _words(docs.select("text")).select(F.explode("words_").alias("term"))
    counts = stored(cut.join(small(terms, F.octet_length("term")), "term").groupBy("term").agg(F.count("*").alias("n")), "near-counts")
    # A term that never occurs is the rarest of all, and has no place to look at.
    counted = spread.join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("window").orderBy("n", "term")))
    return ranked.filter((F.col("rank") <= F.size("terms") - F.col("needed") + 1) & (F.col("n") > 0)).select("term", "window", "terms", "items", "needed")


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = 5, share: float = 0.8, width: int = WIDTH) -> DataFrame:
    """doc_id, key_ (XXH64 of the text), item: documents of which some stretch of words, ``slop``
    longer than a window of the item, holds ``share`` of the window's distinct terms, in any order.

    A stretch that holds k of d terms holds one of any d - k + 1 of them, so the places of each
    window's d - k + 1 rarest terms are all there is to look at: the words around each are
    compared with the window's terms. No match is lost, whichever of its words are changed."""
    found = stored(windows(benchmark, width), "windows")
    anchored = stored(_rarest(docs, found, share), "near-anchors")
    terms = stored(anchored.select("term").distinct(), "near-anchor-terms")
    cut = settled(_words(docs.select("doc_id", F.xxhash64("text").alias("key_"), "text")).drop("text"), ["words_"])
    reach = width + slop - 1
    around = lambda i: F.slice("words_", F.greatest(i - reach, F.lit(0)) + 1, reach + 1 + F.least(i, F.lit(reach)))
    places = cut.select("doc_id", "key_", F.explode(F.transform("words_", lambda w, i: F.struct(w.alias("term"), i.alias("at")))).alias("p"), "words_")
    met = places.select("doc_id", "key_", F.col("p.term").alias("term"), F.col("p.at").alias("at"), "words_").join(small(terms), "term", "left_semi")
    near = met.select("doc_id", "key_", "term", around(F.col("at")).alias("near")).join(small(anchored, F.octet_length("window") * 2), "term")
    length = F.size("terms") + slop
    starts = F.sequence(F.lit(1), F.greatest(F.size("near") - length + 1, F.lit(1)))
    held = F.exists(starts, lambda s: F.size(F.array_intersect("terms", F.slice("near", s, length))) >= F.col("needed"))
    # Few words in common altogether: no stretch can hold enough.
    hits = near.filter(F.size(F.array_intersect("terms", "near")) >= F.col("needed")).filter(held)
    return hits.select("doc_id", "key_", F.explode("items").alias("item")).distinct()


def op9_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = judged(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        "contaminated",
    )
