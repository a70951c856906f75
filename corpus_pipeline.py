"""The corpus pipeline: five stages over ``documents``, each one of the pipeline operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as
Parquet in the shared folder and reads it again as the next stage's input. All stages but the
last return the columns they were given, extra ones included, whatever their names. Repeated
rows pass the filtering stages together, but for the near-duplicates, where one row of each
group stays. Null or empty texts fail the quality rules. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treeloom.llm import bk_trees, co_training, ngram_ratio, phrase_index, two_fit
from treeloom.llm.shared import put_back, set_apart, table
from treeloom.session import fresh_folder


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the quality classifier keeps."""
    held, columns, names = set_apart(docs)
    return put_back(co_training.kept_rows(held, table(spark, sf_dir, "labels"), columns), names)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the quality rules keep; the statistics are those of this stage's own input."""
    held, columns, names = set_apart(docs)
    found = ngram_ratio.judged(held, table(spark, sf_dir, "labels"), columns["doc_id"], columns["text"])
    return put_back(found.filter("kept"), names)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group whose fingerprints link, by the operator's own shingles and radius."""
    held, columns, names = set_apart(docs)
    return put_back(bk_trees.one_of_each(held, columns["doc_id"], columns["text"]), names)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    held, columns, names = set_apart(docs)
    found = phrase_index.judged(held, table(spark, sf_dir, "benchmark"), columns["doc_id"], columns["text"])
    return put_back(found.filter(~found["contaminated"]), names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1024 tokens."""
    return two_fit.pack(two_fit.pieces(docs))


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", apply_rules),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("packing", pack),
]

# Hashing and model fitting cannot be written in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
