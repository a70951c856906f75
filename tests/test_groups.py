"""Totals, orderings, directories and run comparison on small tables."""

import random
import statistics
import json

from pyspark.sql import functions as F

from treeloom.fixed_values import ENGINE_COLUMN
from treeloom.functions.numbers import iso_millis
from treeloom.jobs.analyse import Analysis
from treeloom.operators import directories, files, ordering, renest, runs, snapshots
from treeloom.operators.dispatch import Dialects, file_results, json_results, line_results, markup_results
from treeloom.operators.line_trees import line_nodes
from treeloom.sinks.writers import write_fragments
from treeloom.sources.trees import pieces_in_order


def test_row_numbers_of_a_group_spread_over_ranges(spark):
    """One group holds most rows, so it spans several ranges."""
    rows = [("hot" if i % 5 else f"k{i % 7}", (i * 37) % 101, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, t int, id int")
    got = {r.id: r.n for r in ordering.numbered(df, ["k"], ["t", "id"], "n").collect()}
    expected = {}
    for key in {k for k, _, _ in rows}:
        for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1:]), 1):
            expected[i] = n
    assert got == expected


def test_exact_summary(spark):
    source = random.Random(7)
    rows = [(f"g{source.randrange(3)}", source.randrange(40)) for _ in range(501)] + [("one", 9), ("two", 1), ("two", 4), ("two", None)]
    df = spark.createDataFrame(rows, "g string, v bigint").repartition(6)
    for r in ordering.exact_summary(df, ["g"], "v").collect():
        values = [v for k, v in rows if k == r.g and v is not None]
        assert (r.n, int(r.total), int(r.squares), r.least, r.most, r.median) == (
            len(values), sum(values), sum(v * v for v in values), min(values), max(values), statistics.median(values))


def run_rows(spark, rows):
    ddl = "repo string, engine string, n int, parse_ns bigint"
    return spark.createDataFrame(rows, ddl).select(
        "repo", "engine", F.timestamp_seconds(F.col("n")).alias("ts"), F.col("n").cast("bigint").alias("run_id"),
        *[F.col("n").cast("bigint").alias(c) for c in ("files", "loc", "nodes")], F.col("n").alias("max_depth"),
        "parse_ns", (F.col("parse_ns") * 2).alias("total_ns"), F.lit(1048576).cast("bigint").alias("rss_bytes"),
        F.lit(None).cast("bigint").alias("heap_bytes"))


def test_runs_pair_by_number_and_keep_the_odd_one(spark):
    ms = 1_000_000
    df = run_rows(spark, [("a", "generic", 1, 10 * ms), ("a", "generic", 5, 20 * ms), ("a", "native", 2, 30 * ms), ("a", "native", 6, 10 * ms),
                          ("b", "generic", 1, 10 * ms), ("b", "generic", 2, 10 * ms), ("b", "native", 1, 10 * ms), ("c", "native", 3, 0), ("c", "generic", 3, 5 * ms)])
    pairs = runs.pair_runs(df).orderBy("repo", "run_no").collect()
    assert [(p.repo, p.run_no, p.a_parse_sec, p.b_parse_sec, p.missing_side) for p in pairs] == [
        ("a", 1, 0.01, 0.03, None), ("a", 2, 0.02, 0.01, None), ("b", 1, 0.01, 0.01, None), ("b", 2, 0.01, None, "native"), ("c", 1, 0.005, 0.0, None)]
    fast = runs.engine_speedup(df).orderBy("repo", "run_no").collect()
    assert [(f.repo, f.faster, f.times_faster) for f in fast] == [("a", "generic", 3.0), ("a", "native", 2.0), ("b", "native", 1.0)]
    assert [(m.repo, m.speedup, m.direction) for m in runs.mean_speedup(df).collect()] == [("a", 1.33, "faster")]
    stats = {(s.repo, s.engine): s for s in runs.run_stats(df).collect()}
    assert set(stats) == {("a", "generic"), ("a", "native"), ("b", "generic")}
    a = stats["a", "native"]
    assert (a.runs, a.mean_sec, a.std_sec, a.median_sec, a.min_sec, a.max_sec) == (2, 0.02, 0.01, 0.02, 0.01, 0.03)
    assert runs.engine_compare(df).count() == 8 * 5


FILES = "repo string, file_path string, loc bigint, nodes bigint, max_depth int, parse_ns bigint, status string"


def measured(spark):
    return spark.createDataFrame([
        ("r", "src/A.java", 10, 5, 3, 1_400_000, "ok"), ("r", "src/b/C.java", 3, 2, 2, 1_400_000, "ok"),
        ("r", "src/b/d.es", 4, None, None, None, "error"), ("r", "Makefile", 2, 1, 1, 0, "ok")], FILES)


def test_language_totals_count_failed_files_and_round_after_summing(spark):
    labelled = files.with_language(files.with_dimensions(measured(spark)))
    rows = {r.language: tuple(r)[2:] for r in files.language_rollup(labelled, ["repo"]).drop("is_total").select(
        "repo", "language", "files", "loc", "nodes", "max_depth", "parse_sec").collect()}
    assert rows == {"java": (2, 13, 7, 3, 0.003), ".es": (1, 4, 0, 0, 0.0), "unknown": (1, 2, 1, 1, 0.0), None: (4, 19, 8, 3, 0.003)}
    assert {r.status: r.files for r in files.status_counts(labelled).collect()} == {"ok": 3, "error": 1}
    assert files.success_rate(labelled, ["repo"]).first().success_pct == 75.0
    assert files.throughput(labelled.filter("language = '.es'"), ["repo"]).first().loc_per_sec is None


def test_engines_accept_their_own_extensions(spark):
    names = ["a.java", "b.c", "c.cpp", "d.tsx", "e.JS", "f.h", "g.py"]
    df = files.with_dimensions(spark.createDataFrame([("r", n) for n in names], "repo string, file_path string"))
    got = {(r.file_path, r.engine) for r in files.supported_by_engine(df).collect()}
    assert got == {("a.java", "generic"), ("a.java", "native"), ("b.c", "native"), ("c.cpp", "generic"), ("f.h", "generic"),
                   ("g.py", "generic"), ("g.py", "native")}


def test_run_without_files_writes_no_line(spark):
    empty = measured(spark).filter("false").withColumn("language", F.lit("x")).withColumn(ENGINE_COLUMN, F.lit("generic"))
    empty = empty.selectExpr("*", "timestamp'2024-01-01' ts", "0L total_ns", "0L rss_bytes", "0L heap_bytes")
    assert files.history_rows(files.run_records(empty, [ENGINE_COLUMN, "repo"])).count() == 0


def test_directories(spark):
    m = measured(spark)
    empty = spark.createDataFrame([("r", "docs/old")], "repo string, dir_path string")
    tree = sorted(tuple(r) for r in directories.dir_tree(m, empty_dirs=empty).collect())
    assert tree == [("r", "docs", None, "docs", 1), ("r", "docs/old", "docs", "old", 2), ("r", "src", None, "src", 1), ("r", "src/b", "src", "b", 2)]
    assert {r.dir_path: (r.files, r.loc) for r in directories.dir_rollup(m).collect()} == {"src": (3, 17), "src/b": (2, 7)}


def test_response_pieces_make_one_document(spark):
    m = measured(spark).select("repo", "file_path", F.when(F.col("status") == "ok", '{"type":"program"}').alias("ast"),
                               F.when(F.col("status") != "ok", "bad").alias("error"))
    run = spark.range(1).select(F.lit("r").alias("repo"), iso_millis(F.lit("2024-01-01").cast("timestamp")).alias("timestamp"), F.lit('{"files":4}').alias("benchmark"))
    pieces = renest.response_fragments(m, run).orderBy("place", "seq").collect()
    body = json.loads("".join(p.fragment for p in pieces))
    root = body["nodes"][0]
    assert body["benchmark"] == {"files": 4} and body["timestamp"] == "2024-01-01T00:00:00.000Z"
    assert [c["name"] for c in root["children"]] == ["Makefile", "src"]
    src = root["children"][1]
    assert [c["name"] for c in src["children"]] == ["A.java", "b"] and src["children"][1]["children"][1] == {
        "type": "file", "name": "d.es", "filePath": "src/b/d.es", "error": "bad"}


RESULTS = "repo string, file_path string, ext string, content string, status string, error string"


def test_every_file_has_a_result(spark):
    rows = [
        ("r", "a", ".txt", "x y", "ok", None), ("r", "b", ".bin", "z", "ok", None), ("r", "c", ".json", '{"type":"a","children":[{"type":"b"}]}', "ok", None),
        ("r", "d", ".json", "broken {", "ok", None), ("r", "e", ".c", " Dump(\n ", "ok", None), ("r", "f", ".c", '{"error":"x"}', "ok", None),
        ("r", "g", ".html", "no tags", "ok", None), ("r", "h", ".json", "5", "ok", None), ("r", "i", ".txt", None, "error", "unread"), ("r", "j", ".json", None, None, None),
    ]
    df = spark.createDataFrame(rows, RESULTS)
    dialects = Dialects().register("lines", [".txt"], line_results).register("markup", [".html"], markup_results)
    dialects = dialects.register("json", [".json"], json_results()).register("c", [".c"], json_results(strict=False))
    found = dialects.results(df, ["repo", "file_path"])
    got = {r.file_path: (r.status, r.nodes, r.max_depth) for r in file_results(found, ["file_path"]).collect()}
    assert got == {
        "a": ("ok", 4, 3), "c": ("ok", 2, 2), "d": ("error", 0, 0), "e": ("ok", 1, 1), "f": ("ok", 1, 1), "g": ("ok", 0, 0), "h": ("ok", 0, 0),
        "i": ("error", 0, 0), "j": ("error", 0, 0)}
    assert {r.file_path: r.error for r in found.filter("error is not null").collect()} == {"d": "the dump is not JSON", "i": "unread", "j": "the dump is not JSON"}
    assert [r.text for r in found.filter("file_path = 'e'").collect()] == ["Dump("]
    nodes = dialects.nodes(df, ["repo", "file_path"])
    assert nodes.count() == 8 and "status" not in nodes.columns


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nodes_are_counted_without_sorting_them(spark):
    rows = [("r", "a", ".txt", "x y", "ok", None), ("r", "a", ".txt", "z", "error", "unread"), ("r", "b", ".txt", None, "ok", None), (None, None, ".txt", "x\n\ny", "ok", None)]
    found = Dialects().register("lines", [".txt"], line_results).results(spark.createDataFrame(rows, RESULTS), ["repo", "file_path"])
    made = file_results(found, ["repo", "file_path"])
    # What stands lowest in the plan takes the nodes; strings are sorted above it, a row a file.
    assert plan_of(made).rfind("HashAggregate") > plan_of(made).rfind("SortAggregate")
    got = {(r.repo, r.file_path): (r.status, r.error, r.nodes, r.max_depth) for r in made.collect()}
    assert got == {("r", "a"): ("ok", "unread", 4, 3), ("r", "b"): ("ok", None, 1, 1), (None, None): ("ok", None, 7, 3)}


def test_analysis_counts_nodes_without_sorting_them(spark):
    nodes = spark.createDataFrame(
        [("r", "a", 1, 1, "ok"), ("r", "a", 2, 2, "ok"), ("r", "a", None, None, "error"), ("r", "b", None, None, "ok")],
        "repo string, file_path string, node_id int, depth int, status string")
    listed = spark.createDataFrame(
        [("r", p, lang, status, 5, 7, 8, 9, 1) for p, lang, status in (("a", "x", "ok"), ("b", "y", "ok"), (None, None, "error"))],
        "repo string, file_path string, language string, status string, loc bigint, parse_ns bigint, total_ns bigint, rss_bytes bigint, heap_bytes bigint",
    ).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    made = Analysis("nowhere", "generic", Dialects(), lambda f: f)._per_file(nodes, listed)
    plan = plan_of(made)
    assert plan.rfind("HashAggregate") > plan.find("SortAggregate") and plan.count("HashAggregate") == 2
    got = {r.file_path: (r.language, r.status, r.nodes, r.max_depth, r["loc"], r.parse_ns) for r in made.collect()}
    assert got == {"a": ("x", "error", 2, 2, 5, 0), "b": ("y", "ok", 0, 0, 5, 7)}


def test_answer_with_trees(spark, tmp_path):
    """Folders and nodes in one text, read back in order; a repeated path counts once."""
    rows = [("r", f"d{i % 3}/f{i}.txt", f"word{i} and\nmore", "bad" if i == 4 else None) for i in range(12)]
    df = spark.createDataFrame(rows, "repo string, file_path string, content string, error string")
    nodes = line_nodes(df.filter("error is null"))
    run = spark.range(1).selectExpr("'r' repo", "'t' timestamp", "'{}' benchmark")
    answer = df.selectExpr("repo", "file_path", "cast(null as string) ast", "error")
    pieces = renest.response_fragments(answer.unionByName(answer.filter("error is not null")), run, nodes)
    write_fragments(pieces, ["repo", "place", "seq"], str(tmp_path / "out"))
    back = pieces_in_order(spark, str(tmp_path / "out"), "repo").orderBy("position").collect()
    assert [r.position for r in back] == list(range(1, len(back) + 1))
    body = json.loads("".join(r.fragment for r in back))
    files_ = {c["filePath"]: c for d in body["nodes"][0]["children"] for c in d["children"]}
    assert set(files_) == {r[1] for r in rows} and files_["d1/f4.txt"]["error"] == "bad"
    first = files_["d0/f0.txt"]["ast"]
    assert first["type"] == "document" and [t["text"] for t in first["children"][0]["children"]] == ["word0", "and"]


def test_written_pieces_are_the_document(spark, tmp_path):
    names = [("r", f"d{i % 7}/f{i}.py") for i in range(300)]
    f = spark.createDataFrame(names, "repo string, file_path string").selectExpr("*", "'{}' ast", "cast(null as string) error")
    run = spark.range(1).selectExpr("'r' repo", "'t' timestamp", "'{}' benchmark")
    write_fragments(renest.response_fragments(f, run), ["repo", "place", "seq"], str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "repo=r").glob("part-*"))
    body = json.loads("".join(p.read_text() for p in parts))
    folders = body["nodes"][0]["children"]
    assert [d["name"] for d in folders] == [f"d{i}" for i in range(7)]
    assert {c["filePath"] for d in folders for c in d["children"]} == {n for _, n in names}


def plain_differences(a, b, path=()):
    """Topmost differences of two trees (label, children), by a plain recursion."""
    if a is None or b is None or a[0] != b[0]:
        count = lambda t: None if t is None else 1 + sum(count(c) for c in t[1])
        return [("/".join(map(str, path)), "removed" if b is None else "added" if a is None else "changed", count(a), count(b))]
    out = []
    for i in range(max(len(a[1]), len(b[1]))):
        out += plain_differences(*[t[1][i] if i < len(t[1]) else None for t in (a, b)], (*path, i))
    return out


def test_snapshots_against_a_recursion(spark):
    source = random.Random(12)

    def tree(depth):
        return (source.choice("abc"), [tree(depth - 1) for _ in range(source.randrange(4))] if depth else [])

    def altered(t):
        kids = [altered(c) for c in t[1] if source.random() > 0.08]
        if source.random() < 0.1:
            kids.insert(source.randrange(len(kids) + 1), tree(1))
        return (source.choice("abc") if source.random() < 0.1 else t[0], kids)

    def rows(file, t):
        out = []

        def go(node, depth):
            out.append((file, len(out) + 1, depth, node[0], None, node[0] * 2))
            for c in node[1]:
                go(c, depth + 1)

        go(t, 1)
        return out

    before = {str(i): tree(4) for i in range(60)}
    after = {k: t if int(k) % 3 == 0 else altered(t) for k, t in before.items() if int(k) % 7}
    after["new"] = tree(3)
    ddl = "file string, node_id int, depth int, kind string, field_name string, text string"
    left, right = (spark.createDataFrame([r for k, t in side.items() for r in rows(k, t)], ddl) for side in (before, after))
    got = sorted(tuple(r) for r in snapshots.compare(left, right, ["file"]).collect())
    want = []
    for k in {*before, *after}:
        want += [(k, *d) for d in plain_differences(before.get(k), after.get(k), (0,))]
    assert got == sorted(want, key=lambda d: d[:2]) and len(got) > 60
    assert snapshots.compare(left, left, ["file"]).count() == 0
    assert snapshots.compare(left.limit(0), right.limit(0), ["file"]).count() == 0
