"""The stages on odd rows, each against its operator's own verdicts, and the fixity audit."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

from tests.llm.test_texts import base, fingerprint, reachable
from treeloom.llm import bk_trees, co_training, license_scan, line_runs, ngram_ratio, phrase_index, shared, warc_fixity


@pytest.fixture
def sf_dir(spark, tmp_path):
    """Labels and benchmark beside documents."""
    spark.createDataFrame([(1, 1, 0), (8, 0, 0), (99, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and then as dogs do")], "item_id bigint, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    return str(tmp_path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_keep_what_their_operators_keep(spark, docs, sf_dir):
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    own = ["doc_id", "text", "lang", "source", "n_chars"]
    plain = docs.select(own)
    want = {
        "quality_classifier": co_training.judged(plain, labels).filter("kept"),
        "quality_rules": ngram_ratio.judged(plain, labels).filter("kept"),
        "near_duplicates": bk_trees.one_of_each(plain),
        "decontamination": phrase_index.judged(plain, bench).filter("not contaminated"),
    }
    for name, stage in pipeline.STAGES[:-1]:
        # Columns named like the operators' own come through untouched.
        found = stage(spark, docs, sf_dir)
        assert found.columns == docs.columns
        assert rows(found.select(own)) == rows(want[name].select(own)), name
        assert found.filter("kept <> 'mine' or row_ <> 'mine'").count() == 0


def test_empty_documents_stay_empty(spark, empty, sf_dir):
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_stages_in_order(spark, docs, sf_dir):
    """The whole run against the rules applied one by one in Python."""
    spark.createDataFrame([(1, "nothing else is here to see at all")], "item_id bigint, text string").write.mode("overwrite").parquet(
        f"{sf_dir}/benchmark.parquet"
    )
    # With good labels alone the classifier keeps everything.
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.mode("overwrite").parquet(f"{sf_dir}/labels.parquet")
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    packed = pipeline.run(spark, sf_dir)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(packed.columns)
    left = [(r.doc_id, r.text) for r in docs.collect() if not base(r.text)[-1]]
    roots = reachable([fingerprint(text) for _, text in left], 3)
    first = {}
    for (doc_id, text), root in zip(left, roots):
        first.setdefault(root, []).append((doc_id is not None, doc_id, text))
    left = [min(group, key=lambda g: (g[0], g[1] or 0)) for group in first.values()]
    want = {doc_id for _, doc_id, text in left if "Nothing else is here to see at all" not in text}
    assert want and {r.doc_id for r in packed.collect()} == want


def test_nothing_broadcast(spark, docs, sf_dir, monkeypatch):
    """Where every side is beyond the limit, all joins are shuffled and results are the same."""
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    texts = plain.select("doc_id", "text")

    def every():
        return [
            rows(co_training.kept_rows(plain, labels)),
            rows(ngram_ratio.judged(plain, labels)),
            rows(bk_trees.near_duplicates(texts)),
            rows(bk_trees.one_of_each(texts)),
            rows(phrase_index.judged(texts, bench)),
            rows(license_scan.license_matches(texts, license_scan.default_templates(spark))),
            rows(line_runs.without_repeats(texts)),
        ]

    want = every()
    for module, name in ((shared, "BROADCAST_ROWS"), (line_runs, "BROADCAST_ROWS")):
        monkeypatch.setattr(module, name, 0)
    assert every() == want


# Fixity ----------------------------------------------------------------------------------


def records(spark, *parts):
    made = [(a, o, bytes(b, "utf-8") if b is not None else None) for a, o, b in parts]
    return spark.createDataFrame(made, "archive bigint, offset bigint, record binary").withColumn("hash", F.lit("mine"))


def found(left, right, **settings):
    return sorted((r.archive, r.offset, r.status) for r in warc_fixity.audit(left, right, **settings).collect())


def test_audit_finds_every_difference(spark):
    whole = [(a, o, f"record {a} {o}") for a in range(3) for o in range(0, 4000, 40)]
    other = [p for p in whole if p[:2] not in {(0, 40), (2, 3960)}]
    other = [(a, o, "changed" if (a, o) == (1, 2000) else b) for a, o, b in other] + [(1, 90_000, "more"), (7, 0, "new")]
    want = [(0, 40, "missing"), (1, 2000, "changed"), (1, 90_000, "extra"), (2, 3960, "missing"), (7, 0, "extra")]
    for settings in ({"range_bytes": 100, "fanout": 2}, {}):
        assert found(records(spark, *whole), records(spark, *other), **settings) == want
    assert found(records(spark, *whole), records(spark, *whole)) == []


def test_audit_of_odd_records(spark):
    left = [(1, 0, None), (1, 5, ""), (1, 9, "x"), (1, 9, "x"), (None, 3, "n")]
    assert found(records(spark, *left), records(spark, *left)) == []
    assert found(records(spark, *left), records(spark, (1, 0, ""), *left[1:])) == [(1, 0, "changed")]
    assert found(records(spark, *left), records(spark, *left[:2], *left[3:])) == [(1, 9, "changed")]
    assert found(records(spark), records(spark)) == []


def test_audit_reads_only_below_differences(spark):
    """Roots agree on untouched archives, whatever lies below."""
    pages = spark.createDataFrame([(i, f"u{i}", "x" * (i % 50)) for i in range(200)] + [(None, None, None)] * 2, "page_id bigint, url string, html string")
    made = warc_fixity.page_archives(pages, per_archive=64)
    hurt = warc_fixity.damaged(made)
    want = {11: "changed", 100: "changed", 189: "changed", 23: "changed", 112: "changed", 37: "missing", 126: "missing", 53: "extra", 142: "extra"}
    assert sorted(s for *_, s in found(made, hurt)) == sorted(want.values())
