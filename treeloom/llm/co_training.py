"""Quality classifier by co-training of two views.

The text view sees a document's distinct words and a few measures of its characters; the
metadata view sees source, language and recorded length. Each view is a naive Bayes model over
hashed features, counted by one aggregation over all labelled documents. In every round a view
calls the documents it is sure of, and those calls become labels of the other view where no
true label exists; both models are then counted again, over all documents. A view's scores are
calibrated by logistic regression on true labels alone, from a histogram of scores that models
without these labels gave: labelled documents are dealt into folds by their text, buckets are
counted fold by fold, and a fold is scored by the counts of all others. A document's two
calibrated log-odds are added against the common prior.

A model is as large as its number of buckets, whatever the corpus. It travels with the Arrow
function that scores rows: as a constant of the plan its text would be kept by the driver for
every query. Every text is cut once, into features that are written to the shared folder without
the text; fitting and scoring read these narrow rows alone, and verdicts meet their documents
by id and hash.

Null texts and null metadata are values of their own. Labels may repeat or contradict: a
document is good if no label calls it bad. Labels of unknown documents are ignored. Without
labels, or with labels of one kind only, every document scores the prior, 1/2 or that kind.
Repeated rows stay; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import BLANKS, small, stored, table, words

TEXT_BUCKETS = 1 << 16
META_BUCKETS = 1 << 12
ROUNDS = 2
# Parts of the labelled documents for calibration.
FOLDS = 2
# A view is sure of a document from this calibrated probability on, either way.
SURE = 0.98
SMOOTHING = 1.0
# How much the mean weight of the words counts beside one measure's weight.
WORDS_COUNT = 5
# Calibration histogram: thousandths of score to a bin, and the outermost bins.
BIN, BINS = 250, 200
KEPT = 0.5
COLUMNS = {name: name for name in ("doc_id", "text", "source", "lang", "n_chars")}


@dataclass
class View:
    """A fitted view: the weight of every bucket (thousandths) and its calibration."""

    weights: list[int]
    slope: float
    offset: float


def _share(part: Column, whole: Column, steps: int) -> Column:
    return F.floor(steps * part / F.greatest(whole, F.lit(1))).cast("int")


def _said(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def _given(docs: DataFrame, columns: dict[str, str] | None) -> dict[str, Column]:
    """The table's own columns under the names they have; metadata that is not there is null."""
    names = COLUMNS | (columns or {})
    return {c: F.col(name) if name in docs.columns else F.lit(None) for c, name in names.items()}


def _key(given: dict[str, Column]) -> Column:
    """Equal for rows of one id whose features are equal."""
    return F.xxhash64(F.coalesce(given["text"], F.lit("")), *[_said(given[c]) for c in ("source", "lang", "n_chars")])


def features(docs: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with words_ (buckets of distinct words), marks_ (buckets of the text's measures)
    and meta_ (buckets of the metadata). ``columns`` gives other names for the table's own
    columns."""
    given = _given(docs, columns)
    return _features(docs, F.coalesce(given["text"], F.lit("")), *[given[c] for c in ("source", "lang", "n_chars")])


def _features(docs: DataFrame, text: Column, source: Column, lang: Column, n_chars: Column) -> DataFrame:
    size = F.length(text)
    ascii_ = lambda letters: size - F.length(F.translate(text, letters, ""))
    n = F.size("all_")
    distinct = F.size("distinct_")
    measures = [
        _share(ascii_("#*$%&|<>"), size, 40),
        _share(ascii_("!?"), size, 40),
        _share(ascii_("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), size, 20),
        _share(ascii_("0123456789"), size, 20),
        _share(distinct, n, 20),
        _share(size, n, 1),
        F.floor(F.log2(n + F.lit(1))).cast("int"),
        _share(F.size(F.array_distinct(F.split(text, "\n"))), F.size(F.split(text, "\n")), 10),
    ]
    bucket = lambda size, *parts: F.xxhash64(*parts).bitwiseAND(F.lit(size - 1)).cast("int")
    length = F.floor(F.log2(n_chars.cast("double") + 1) * 2).cast("int")
    metas = [_said(source), _said(lang), _said(length), F.concat_ws("/", _said(source), _said(lang))]
    cut = docs.withColumn("all_", words(text, BLANKS)).withColumn("distinct_", F.array_distinct("all_"))
    return (
        cut.withColumn("words_", F.transform("distinct_", lambda w: bucket(TEXT_BUCKETS, w)))
        .withColumn("marks_", F.array(*[bucket(TEXT_BUCKETS, F.lit(f"m{i}"), m) for i, m in enumerate(measures)]))
        .withColumn("meta_", F.array(*[bucket(META_BUCKETS, F.lit(f"d{i}"), m) for i, m in enumerate(metas)]))
        .drop("all_", "distinct_")
    )


def _sums(lists: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of each list's weights, and its length."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    upto = np.r_[0, np.cumsum(weights[lists.flatten().to_numpy(zero_copy_only=False)])]
    ends = np.cumsum(sizes)
    return upto[ends] - upto[ends - sizes], sizes


def text_score(weights: list[int]) -> Column:
    """Thousandths of log-odds; the words by their mean, so long texts are not surer."""
    table_ = np.array(weights, dtype=np.int64)

    @F.arrow_udf(T.LongType())
    def score(words: pa.Array, marks: pa.Array) -> pa.Array:
        total, n = _sums(words, table_)
        return pa.array(WORDS_COUNT * total // np.maximum(n, 1) + _sums(marks, table_)[0])

    return score("words_", "marks_")


def meta_score(weights: list[int]) -> Column:
    table_ = np.array(weights, dtype=np.int64)

    @F.arrow_udf(T.LongType())
    def score(meta: pa.Array) -> pa.Array:
        return pa.array(_sums(meta, table_)[0])

    return score("meta_")


def scored(rows: DataFrame, text: list[int], meta: list[int]) -> DataFrame:
    """``rows`` of features with text_score_ and meta_score_."""
    return rows.withColumns({"text_score_": text_score(text), "meta_score_": meta_score(meta)})


def _weights(known: DataFrame, buckets: Column, size: int) -> list[list[int]]:
    """Naive Bayes weights from rows with good_ (1, 0 or null for unknown) and fold_: of all of
    them, then without each fold. ``FOLDS`` + 1 rows for each bucket reach the driver at most."""
    each = known.filter(F.col("good_").isNotNull()).select("good_", "fold_", F.explode_outer(buckets).alias("bucket"))
    counts = each.filter(F.col("bucket").isNotNull()).groupBy("bucket", "fold_").agg(F.sum("good_").alias("good"), F.count("*").alias("n")).toPandas()
    out = []
    for left_out in (None, *range(FOLDS)):
        part = counts if left_out is None else counts[counts["fold_"] != left_out]
        good = np.bincount(part["bucket"], part["good"], size)
        bad = np.bincount(part["bucket"], part["n"] - part["good"], size)
        if not good.any() or not bad.any():
            out.append([0] * size)
            continue
        share = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * size))
        out.append(np.rint(1000 * (share(good) - share(bad))).astype(int).tolist())
    return out


def calibrate(scores: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the log-odds of being good, by Newton steps on binned scores with a
    slight pull to zero."""
    if not n.sum():
        return 0.0, 0.0
    x = np.stack([scores / 1000.0, np.ones(len(scores))], axis=1)
    beta = np.zeros(2)
    pull = np.diag([0.01, 0.01]) * max(1.0, n.sum() / 100)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (good - n * p) - pull @ beta
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + pull, slope)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def _calibration(marked: DataFrame, scores: list[Column]) -> tuple[float, float]:
    """From the true labels alone, each scored by the model without its fold: at most
    ``2 * BINS + 1`` rows reach the driver."""
    score = F.coalesce(*[F.when(F.col("fold_") == i, s) for i, s in enumerate(scores)])
    bin_ = F.greatest(F.least(F.floor(score / BIN), F.lit(BINS)), F.lit(-BINS))
    known = marked.filter(F.col("label_").isNotNull()).withColumn("bin", bin_)
    rows = known.groupBy("bin").agg(F.sum("label_").alias("good"), F.count("*").alias("n")).collect()
    rows = sorted(rows, key=lambda r: r["bin"])
    column = lambda name: np.array([float(r[name]) for r in rows])
    return calibrate((column("bin") + 0.5) * BIN, column("good"), column("n"))


def log_odds(score: Column, view: View) -> Column:
    return F.lit(view.slope) * score / 1000 + F.lit(view.offset)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with label_: 1 good, 0 bad, null unknown."""
    known = labels.filter(F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("labelled_")).agg(
        F.min("quality").cast("int").alias("label_")
    )
    return docs.join(small(stored(known, "labels")), F.col(id_col) == F.col("labelled_"), "left").drop("labelled_")


def marked_rows(docs: DataFrame, labels: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """A narrow stored row for each row of ``docs``: id_, key_, label_, fold_ and its features."""
    given = _given(docs, columns)
    known = labelled(docs, labels, (COLUMNS | (columns or {}))["doc_id"])
    # Copies of one text share a fold.
    fold = F.pmod(F.xxhash64(given["text"]), F.lit(FOLDS)).cast("int")
    keyed = known.withColumns({"key_": _key(given), "fold_": F.when(F.col("label_").isNotNull(), fold).otherwise(-1)})
    return stored(features(keyed, columns).select(given["doc_id"].alias("id_"), "key_", "label_", "fold_", "words_", "marks_", "meta_"), "features")


def fit(marked: DataFrame, rounds: int = ROUNDS) -> tuple[View, View, float]:
    """The two views after all rounds, and the prior log-odds of the true labels."""
    good, n = marked.agg(F.coalesce(F.sum("label_"), F.lit(0)), F.count("label_")).first()
    if not 0 < good < n:
        # Nothing to tell apart: the prior alone.
        flat = View([0] * TEXT_BUCKETS, 0.0, 0.0), View([0] * META_BUCKETS, 0.0, 0.0)
        return *flat, 0.0 if not n else 10.0 if good else -10.0
    prior = float(np.log(good / (n - good)))
    sure = float(np.log(SURE / (1 - SURE)))
    call = lambda odds: F.when(odds >= sure, 1).when(odds <= -sure, 0)
    judged_, text_label, meta_label = marked, F.col("label_"), F.col("label_")
    for _ in range(rounds + 1):
        text_weights, *text_parts = _weights(judged_.withColumn("good_", text_label), F.concat("words_", "marks_"), TEXT_BUCKETS)
        meta_weights, *meta_parts = _weights(judged_.withColumn("good_", meta_label), F.col("meta_"), META_BUCKETS)
        judged_ = scored(marked, text_weights, meta_weights)
        text = View(text_weights, *_calibration(marked, [text_score(w) for w in text_parts]))
        meta = View(meta_weights, *_calibration(marked, [meta_score(w) for w in meta_parts]))
        # What one view is sure of is a label of the other.
        text_label = F.coalesce(F.col("label_"), call(log_odds(F.col("meta_score_"), meta)))
        meta_label = F.coalesce(F.col("label_"), call(log_odds(F.col("text_score_"), text)))
    return text, meta, prior


def verdicts(docs: DataFrame, labels: DataFrame, columns: dict[str, str] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """For each row of ``docs``: id_, key_, p_text, p_meta, score (probability of being good)
    and kept."""
    marked = marked_rows(docs, labels, columns)
    text, meta, prior = fit(marked, rounds)
    chance = lambda odds: F.round(1 / (1 + F.exp(-odds)), 6)
    odds = scored(marked, text.weights, meta.weights).withColumns(
        {"text_odds_": log_odds(F.col("text_score_"), text), "meta_odds_": log_odds(F.col("meta_score_"), meta)}
    )
    informed = any(text.weights) or any(meta.weights)
    both = F.col("text_odds_") + F.col("meta_odds_") - F.lit(prior) if informed else F.lit(prior)
    return odds.select(
        "id_",
        "key_",
        chance(F.col("text_odds_")).alias("p_text"),
        chance(F.col("meta_odds_")).alias("p_meta"),
        chance(both).alias("score"),
        (chance(both) >= KEPT).alias("kept"),
    )


def judged(
    docs: DataFrame, labels: DataFrame, columns: dict[str, str] | None = None, rounds: int = ROUNDS
) -> DataFrame:
    """``docs`` with p_text, p_meta, score and kept. Verdicts are joined to their documents, by
    broadcast where they are few."""
    given = _given(docs, columns)
    found = verdicts(docs, labels, columns, rounds)
    made = [F.first(c).alias(c) for c in ("p_text", "p_meta", "score", "kept")]
    found = stored(found.groupBy("id_", "key_").agg(*made).withColumnRenamed("key_", "other_"), "verdicts")
    same = given["doc_id"].eqNullSafe(F.col("id_")) & (_key(given) == F.col("other_"))
    return docs.join(small(found), same).drop("id_", "other_")


def kept_rows(docs: DataFrame, labels: DataFrame, columns: dict[str, str] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps."""
    given = _given(docs, columns)
    found = verdicts(docs, labels, columns, rounds).filter("kept").select("id_", F.col("key_").alias("other_")).distinct()
    same = given["doc_id"].eqNullSafe(F.col("id_")) & (_key(given) == F.col("other_"))
    return docs.join(small(stored(found, "kept")), same, "left_semi")


def op8_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    found = verdicts(docs, table(spark, sf_dir, "labels")).withColumnRenamed("id_", "doc_id")
    return found.select("doc_id", "p_text", "p_meta", "score", "kept")
