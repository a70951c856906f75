"""One query per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import ENGINE_COLUMN, OUTLINE_CLASS_BY_KIND
from ..functions.numbers import iso_millis, megabytes
from ..functions.paths import matches_pruned_glob, repo_name, run_tag, without_zip
from ..functions.text import line_count, preview
from ..operators import directories, dump_trees, files, json_trees, line_trees, markup_trees, outlines, renest, runs, snapshots, tree_stats
from ..jobs.analyse import Analysis
from ..operators.dispatch import Dialects, file_results, json_results, line_results, markup_results
from ..sinks import writers
from ..session import fresh_folder
from ..sources import archives, trees, walk
from ..sources.layout import spread
from ..streaming import ingest
from . import bindings as b

Query = Callable[[SparkSession, str], DataFrame]

NODE_IDS = ["node_id", "parent_id", "depth", "ordinal", "kind", "parent_kind"]


# Filters and projections ----------------------------------------------------------------


def prune_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.pruned(b.code_files(spark, sf_dir)).select("repo", "file_path")


def prune_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = b.code_files(spark, sf_dir)
    return code.filter(~matches_pruned_glob(F.concat(F.lit("./"), "file_path"))).select("repo", "file_path")


def supported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = files.with_dimensions(b.code_files(spark, sf_dir))
    return files.supported_by_engine(dims).select("repo", "file_path", "ext", "engine")


def file_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.with_dimensions(b.code_files(spark, sf_dir)).select("file_path", "name", "dir_path", "ext")


def language_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = files.with_dimensions(b.code_files(spark, sf_dir))
    return files.with_language(dims).select("file_path", "ext", "language")


def repo_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.table(spark, sf_dir, "events")
    body = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("body-"), "event_type")).when(F.col("event_id") % 3 == 1, "")
    asked = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("query-"), "event_type"))
    upload = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat("event_type", F.lit(".zip")))
    return e.select("event_id", repo_name(body, asked, without_zip(upload)).alias("repo"))


def loc_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.with_line_count(b.document_files(spark, sf_dir)).select("file_path", "loc")


def run_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.table(spark, sf_dir, "events")
    repo = F.concat("event_type", F.lit("/a b."), F.col("user_id").cast("string"))
    return p.select("event_id", run_tag(repo, iso_millis(F.col("ts"))).alias("tag"))


def mb_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = b.table(spark, sf_dir, "orders")
    size = F.when(F.col("o_orderkey") % 10 == 0, None).otherwise(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return o.select("o_orderkey", megabytes(size).alias("mb"))


def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.table(spark, sf_dir, "documents")
    return d.select("doc_id", preview(F.col("text"), 500).alias("head"), preview(F.col("text"), 200).alias("short_head"))


# Trees ----------------------------------------------------------------------------------


def json_tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = json_trees.json_nodes(b.syntax_trees(spark, sf_dir))
    return nodes.select(
        "repo", "file_path", *NODE_IDS, "is_named", "field_name", "text",
        "start_line", "start_col", "end_line", "end_col", "is_leaf", "is_error", "closes",
    )


def named_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = json_trees.json_nodes(b.syntax_trees(spark, sf_dir), named_only=True)
    return nodes.select("repo", "file_path", *NODE_IDS, "field_name", "text")


def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = json_trees.node_arrays(b.syntax_trees(spark, sf_dir))
    return outlines.outline(arrays, ["repo", "file_path"], OUTLINE_CLASS_BY_KIND)


def deep_tree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = json_trees.json_nodes(b.deep_trees(spark, sf_dir))
    return tree_stats.tree_stats(nodes, ["repo", "file_path"], b.deep_trees(spark, sf_dir))


def json_or_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = json_trees.parse_or_raw(b.event_dumps(spark, sf_dir))
    value = F.get_json_object("tree", "$.k").cast("bigint")
    return read.select("repo", "file_path", value.alias("k"), "raw_dump", "status")


def generic_tree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ("l_orderkey", "l_linenumber", "l_partkey")
    return json_trees.object_tree_stats(b.object_trees(spark, sf_dir), keys=keys)


def indent_dump_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = dump_trees.dump_nodes(b.spelled_dumps(spark, sf_dir), width=2)
    return nodes.select("repo", "file_path", *NODE_IDS, "text", "start_line")


def dump_node_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dump_trees.dump_estimate(b.constructor_dumps(spark, sf_dir))


def _page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup_trees.markup_nodes(spread(b.table(spark, sf_dir, "pages")), "html", ("page_id",))


def markup_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_nodes(spark, sf_dir).select("page_id", *NODE_IDS, "text", "is_leaf", "is_error")


def page_tree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_stats.tree_stats(_page_nodes(spark, sf_dir), ["page_id"], b.table(spark, sf_dir, "pages"))


def tree_stats_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_stats.tree_stats_compat(_page_nodes(spark, sf_dir), ["page_id"], "generic", b.table(spark, sf_dir, "pages"))


def error_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_stats.error_nodes(_page_nodes(spark, sf_dir), ["page_id"], b.table(spark, sf_dir, "pages"))


def kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_stats.kind_histogram(_page_nodes(spark, sf_dir))


def parent_kind_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_stats.parent_kind_pairs(_page_nodes(spark, sf_dir))


def line_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spread(b.table(spark, sf_dir, "conversations"))
    nodes = line_trees.line_nodes(turns, "text", ("conv_id", "turn"))
    return nodes.select(
        "conv_id", "turn", *NODE_IDS, "text", "start_line", "start_col", "end_line", "end_col",
        "start_off", "end_off", "is_leaf", "closes",
    )


def outline_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested outline document of every syntax tree."""
    arrays = json_trees.node_arrays(b.syntax_trees(spark, sf_dir))
    return outlines.outline_documents(arrays, ["repo", "file_path"], OUTLINE_CLASS_BY_KIND)


def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of pages, each below the nearest section around it, named by its first heading."""
    arrays = outlines.gathered(_page_nodes(spark, sf_dir), ["page_id"])
    found = outlines.outline(arrays, ["page_id"], b.PAGE_CLASSES, b.PAGE_HEADINGS)
    return found.select("page_id", "node_id", "outline_parent_id", "class", "name")


def dump_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested outline document of every spelled dump; a dump has lines but no columns."""
    nodes = dump_trees.dump_nodes(b.spelled_dumps(spark, sf_dir), width=2)
    arrays = outlines.gathered(nodes, ["repo", "file_path"])
    return outlines.outline_documents(arrays, ["repo", "file_path"], b.DUMP_CLASSES, b.DUMP_NAMES)


def offset_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = json_trees.json_nodes(b.offset_trees(spark, sf_dir), dialect="offsets")
    return nodes.select("repo", "file_path", *NODE_IDS, "text", "start_line", "start_off", "end_off", "is_leaf")


def offset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of offset dumps, and those of a walk over plain objects found both ways."""
    dumps, keys = b.offset_trees(spark, sf_dir), ["repo", "file_path"]
    stats = tree_stats.tree_stats_compat(json_trees.json_nodes(dumps, dialect="offsets"), keys, "offsets")
    walked = json_trees.object_tree_stats(dumps).select(*keys, F.col("nodes").alias("walked_nodes"), F.col("max_depth").alias("walked_depth"))
    return stats.join(walked, keys)


def shifted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = json_trees.json_nodes(b.shifted_trees(spark, sf_dir), dialect="named")
    return nodes.select("repo", "file_path", *NODE_IDS, "text", "start_line", "start_col", "end_line", "end_col", "is_leaf")


def _dialects() -> Dialects:
    return (
        Dialects()
        .register("lines", [".en", ".fr", ".de", ".es"], line_results)
        .register("markup", [".html"], markup_results)
        .register("strict", [".json"], json_results())
        .register("lenient", [".c"], json_results(strict=False))
    )


def dispatch_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of seven sorts in one table, each sent to the builder of its extension: files by
    status, and their nodes. Odd dumps go to the reader that keeps what is not JSON."""
    cols = ["repo", "file_path", "ext", "content"]
    docs = spread(b.document_files(spark, sf_dir)).select(cols)
    pages = spread(b.table(spark, sf_dir, "pages")).select(
        F.lit("web").alias("repo"), F.col("page_id").cast("string").alias("file_path"), F.lit(".html").alias("ext"),
        F.col("html").alias("content"),
    )
    ext = F.when(F.regexp_extract("file_path", "^([0-9]+)", 1).cast("bigint") % 2 == 0, ".json").otherwise(".c")
    dumps = b.event_dumps(spark, sf_dir).withColumn("ext", ext).select(cols)
    keys = ["repo", "file_path"]
    results = file_results(_dialects().results(docs.unionByName(pages).unionByName(dumps), keys), [*keys, "ext"])
    return results.groupBy("ext", "status").agg(
        F.count("*").alias("files"), F.countDistinct("repo").alias("repos"), F.sum("nodes").alias("nodes"), F.max("max_depth").alias("max_depth")
    )


# Directories and nesting ----------------------------------------------------------------


def dir_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directories.dir_tree(b.page_files(spark, sf_dir))


def dir_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directories.dir_rollup(b.page_files(spark, sf_dir))


def renest_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's tree nested again, as one document. Turns may repeat their keys."""
    turns = spread(b.table(spark, sf_dir, "conversations")).withColumn("_row", F.monotonically_increasing_id())
    keys = ["conv_id", "turn", "_row"]
    return renest.nested_json(line_trees.line_nodes(turns, "text", tuple(keys)), keys).drop("_row")


def _response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer for one site of all pages, as ordered pieces."""
    pages = b.page_files(spark, sf_dir)
    answer = pages.select(
        "repo",
        "file_path",
        F.when(F.col("page_id") % 9 != 0, F.to_json(F.struct(F.col("loc")))).alias("ast"),
        F.when(F.col("page_id") % 9 == 0, F.lit("unreadable")).alias("error"),
    )
    run = pages.groupBy("repo").agg(F.count("*").alias("files"), F.sum("loc").alias("loc")).select(
        "repo",
        F.lit("2024-01-01T00:00:00.000Z").alias("timestamp"),
        F.to_json(F.struct("files", "loc")).alias("benchmark"),
    )
    return renest.response_fragments(answer, run)


def snapshot_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer written as nested JSON text, and read back in the order of the files."""
    folder = fresh_folder(spark, "snapshot-json")
    writers.write_fragments(_response(spark, sf_dir), ["repo", "place", "seq"], folder)
    return trees.pieces_in_order(spark, folder, "repo")


def response_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer with the whole tree of every conversation turn, written and read back in order:
    folders and the nodes inside files are one sorted text."""
    c = spread(b.table(spark, sf_dir, "conversations")).select(
        F.lit("talk").alias("repo"),
        F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit(".txt")).alias("file_path"),
        F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, "unreadable").alias("error"),
        F.col("text").alias("content"),
    )
    answer = c.select("repo", "file_path", F.lit(None).cast("string").alias("ast"), "error")
    run = c.groupBy("repo").agg(F.count("*").alias("files")).select(
        "repo", F.lit("2024-01-01T00:00:00.000Z").alias("timestamp"), F.to_json(F.struct("files")).alias("benchmark")
    )
    nodes = line_trees.line_nodes(c.filter("error is null"))
    folder = fresh_folder(spark, "response")
    writers.write_fragments(renest.response_fragments(answer, run, nodes), ["repo", "place", "seq"], folder)
    return trees.pieces_in_order(spark, folder, "repo")


def response_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the answer for one site; `path` is the piece's place, spelled out."""
    pieces = _response(spark, sf_dir)
    path = F.array_join(F.transform("place", lambda s: F.concat(s["after"].cast("string"), F.lit(":"), s["name"])), "/")
    return pieces.select("repo", path.alias("place"), "fragment")


# Totals ---------------------------------------------------------------------------------


def language_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.language_stats(b.measured_files(spark, sf_dir))


def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.corpus_totals(b.measured_files(spark, sf_dir))


def language_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.language_rollup(b.measured_files(spark, sf_dir), ["repo"])


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound, broken and error-reporting dumps: every file counts with its lines, a broken one
    with no time, nodes or depth."""
    read = json_trees.parse_or_raw(b.event_dumps(spark, sf_dir))
    keys = ("repo", "file_path", "status", "loc", "parse_ns")
    time = F.when(F.col("status") != "raw", F.col("parse_ns"))
    sized = read.withColumn("loc", line_count(F.col("content"))).withColumn("parse_ns", time)
    return files.status_counts(json_trees.object_tree_stats(sized, keys=keys))


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.throughput(b.event_files(spark, sf_dir), ["language"])


def success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.success_rate(b.event_files(spark, sf_dir), ["repo"])


def peak_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.peak_metrics(b.event_files(spark, sf_dir), ["repo"])


# Runs -----------------------------------------------------------------------------------


def run_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.number_runs(b.event_runs(spark, sf_dir)).select("repo", "engine", "run_id", "run_no")


def engine_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.engine_compare(b.event_runs(spark, sf_dir))


def engine_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.engine_speedup(b.event_runs(spark, sf_dir))


def mean_speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.mean_speedup(b.event_runs(spark, sf_dir))


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_stats(b.event_runs(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.run_records(b.event_files(spark, sf_dir), [ENGINE_COLUMN, "repo"])


def runs_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "runs")
    writers.write_runs(_records(spark, sf_dir), folder)
    back = trees.read_runs(spark, folder)
    language = F.explode("languages").alias("language", "_s")
    return back.select("*", language).select(
        ENGINE_COLUMN, "repo", "timestamp", "files", "loc", "totalNodes", "maxDepth", "parseTimeSec", "totalTimeSec",
        "peakRssMB", "peakHeapMB", "language", F.col("_s.files").alias("lang_files"), F.col("_s.loc").alias("lang_loc"),
        F.col("_s.parseTimeSec").alias("lang_parse_sec"),
    )


def _written_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark, "history")
    writers.write_history(_records(spark, sf_dir), folder)
    return trees.read_history(spark, folder)


def history_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written_history(spark, sf_dir)


def history_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.history_head(files.history_rows(_records(spark, sf_dir)))


def history_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of all runs plus the lines of one more run per repository."""
    old = files.history_rows(_records(spark, sf_dir))
    later = b.event_files(spark, sf_dir).withColumn(ENGINE_COLUMN, F.lit("native"))
    return old.unionByName(files.history_rows(files.run_records(later, [ENGINE_COLUMN, "repo"])))


# Archives, sinks and streams ------------------------------------------------------------


def _landed(spark: SparkSession, sf_dir: str) -> str:
    """Documents packed into zip files of at most 500 entries below a fresh shared folder."""
    folder = fresh_folder(spark, "landing")
    d = b.table(spark, sf_dir, "documents")
    packed = d.select(
        F.concat(F.lit("docs-"), F.floor(F.col("doc_id") / 500).cast("string")).alias("archive"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("entry_path"),
        F.col("text").alias("content"),
    )
    writers.write_archives(packed, folder).write.format("noop").mode("overwrite").save()
    return folder


def scan_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archives.archive_to_files(archives.archive_files(spark, _landed(spark, sf_dir)))
    return found.select("repo", "file_path", "content", "status")


def dumps_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dumps written by language and read back, each the file it was."""
    folder = fresh_folder(spark, "dumps")
    writers.write_dumps(files.with_language(b.document_files(spark, sf_dir), b.LANGUAGE_LABELS), folder)
    return trees.read_dumps(spark, folder).select("language", "file_path", "content")


def _dump_folder(spark: SparkSession, sf_dir: str) -> str:
    """A directory of one file per document, beside pruned names and empty folders."""
    folder = fresh_folder(spark, "tree")
    docs = b.document_files(spark, sf_dir).select("file_path", F.coalesce("content", F.lit("")).alias("content"))
    some = b.table(spark, sf_dir, "documents").filter("doc_id % 5 = 0")
    name = lambda *parts: F.concat(*[F.lit(p) if p.endswith("/") or p.startswith("/") else F.col(p).cast("string") for p in parts])
    pruned = some.select(name("source", "/node_modules/", "doc_id", "/x.en").alias("file_path"), F.lit("no").alias("content"))
    empty = some.select(name("source", "/empty/", "doc_id").alias("file_path"), F.lit(None).cast("string").alias("content"))
    emptied = some.select(name("source", "/bare/", "doc_id", "/dist").alias("file_path"), F.lit("no").alias("content"))
    every = docs.unionByName(pruned).unionByName(empty).unionByName(emptied)
    writers.write_files(every, folder).write.format("noop").mode("overwrite").save()
    return folder


def scan_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory tree walked: paths and contents of files, and the folders that hold nothing."""
    folder = _dump_folder(spark, sf_dir)
    walked = walk.walk(spark, folder)
    found = walk.contents(walked, folder, [".en", ".fr", ".de", ".es"]).select("path", F.lit("file").alias("kind"), "content")
    return found.unionByName(
        walk.empty_directories(walked).select(F.col("dir_path").alias("path"), F.lit("empty").alias("kind"), F.lit(None).cast("string").alias("content"))
    )


def text_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelled dumps read from files of their own, a file a row, and their nodes counted."""
    folder = fresh_folder(spark, "text-dumps")
    dumps = b.spelled_dumps(spark, sf_dir).select(F.concat("file_path", F.lit(".txt")).alias("file_path"), "content")
    writers.write_files(dumps, folder).write.format("noop").mode("overwrite").save()
    read = trees.text_dumps(spark, folder)
    name = F.regexp_extract("file_path", r"([^/]+)\.txt$", 1).alias("file_path")
    nodes = dump_trees.dump_nodes(read.select(F.lit("dumps").alias("repo"), name, "content"))
    return tree_stats.tree_stats(nodes, ["file_path"])


def snapshot_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node table written by engine and repository, and read back whole."""
    folder = fresh_folder(spark, "snapshot")
    nodes = json_trees.json_nodes(b.syntax_trees(spark, sf_dir)).withColumn("engine", F.lit("generic"))
    # Repositories are folders here, so a bounded set of them is used as partitions.
    by_bucket = nodes.withColumnRenamed("repo", "conv").withColumn("repo", F.concat(F.lit("r"), F.col("conv") % 10))
    writers.write_snapshot(by_bucket, folder)
    back = spark.read.parquet(folder)
    return back.select("engine", "repo", "conv", "file_path", "node_id", "parent_id", "depth", "kind", "text", "start_line", "end_col", "closes")


def _analysis(spark: SparkSession, sf_dir: str) -> tuple[Analysis, str]:
    """The analysis of documents, pages and event dumps packed into archives, and the archives'
    folder. Sizes stand for times, so that results do not depend on the machine."""
    landing = fresh_folder(spark, "analyse-landing")
    d, p, e = (b.table(spark, sf_dir, t) for t in ("documents", "pages", "events"))
    part = lambda name, key, n: F.concat(F.lit(name), F.floor(F.col(key) / n).cast("string")).alias("archive")
    docs = d.select(part("docs-", "doc_id", 500), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("entry_path"), F.col("text").alias("content"))
    web = p.select(part("pages-", "page_id", 200), F.concat(F.lit("web/"), F.col("page_id").cast("string"), F.lit(".html")).alias("entry_path"), F.col("html").alias("content"))
    number = F.regexp_extract("file_path", "^([0-9]+)", 1).cast("bigint")
    dumps = b.event_dumps(spark, sf_dir).select(
        F.concat(F.lit("events-"), F.floor(number / 2000).cast("string")).alias("archive"), F.concat("repo", F.lit("/"), "file_path").alias("entry_path"), "content"
    )
    writers.write_archives(docs.unionByName(web).unionByName(dumps), landing).write.format("noop").mode("overwrite").save()

    def measure(found: DataFrame) -> DataFrame:
        chars, size = F.coalesce(F.char_length("content"), F.lit(0)).cast("bigint"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint")
        return found.withColumns({"ts": F.lit("2024-01-01").cast("timestamp"), "parse_ns": chars * 10_000, "total_ns": chars * 20_000, "rss_bytes": size * 100, "heap_bytes": chars * 100})

    return Analysis(fresh_folder(spark, "analysis"), "generic", _dialects(), measure, b.LANGUAGE_LABELS), landing


def analyse_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive to history: the lines that one job leaves there, run twice as after a failure."""
    job, landing = _analysis(spark, sf_dir)
    for _ in range(2):
        job.run(archives.archive_files(spark, landing), 0)
    return trees.read_history(spark, job.folder("history"))


def analyse_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive to files: what became of each."""
    job, landing = _analysis(spark, sf_dir)
    job.run(archives.archive_files(spark, landing), 0)
    return job.files(spark)


def stream_analyse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same history from archives analysed as they arrive; a second call finds nothing new."""
    job, landing = _analysis(spark, sf_dir)
    checkpoint = fresh_folder(spark, "analyse-state")
    for _ in range(2):
        ingest.analyse_archives(spark, landing, job, checkpoint)
    return trees.read_history(spark, job.folder("history"))


def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of the line trees of all turns: some have a word more, another first word,
    or a line less, and some are gone."""
    c = spread(b.table(spark, sf_dir, "conversations"))
    part, text = (F.col("conv_id") + F.col("turn")) % 5, F.col("text")
    later = F.when(part == 0, F.concat(text, F.lit(" tail"))).when(part == 1, F.concat(F.lit("X"), text))
    later = later.when(part == 2, F.regexp_replace(text, r"(?s)(^|\n)[^\n]*$", "")).otherwise(text)
    after = c.filter((F.col("conv_id") * 3 + F.col("turn")) % 11 != 0).withColumn("text", later)
    keys = ["conv_id", "turn"]
    return snapshots.compare(line_trees.line_nodes(c, "text", tuple(keys)), line_trees.line_nodes(after, "text", tuple(keys)), keys)


def stream_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of which some are uploaded again, holding every second file: the newer ones
    replace what came before; a call that finds nothing new changes nothing."""
    landing, out, checkpoint = (fresh_folder(spark, n) for n in ("newest-landing", "newest", "newest-state"))
    d = b.table(spark, sf_dir, "documents")
    number = F.floor(F.col("doc_id") / 200)
    packed = lambda rows: rows.select(
        F.concat(F.lit("docs-"), number.cast("string")).alias("archive"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("entry_path"),
        F.col("text").alias("content"),
    )

    def summarise(batch: DataFrame) -> DataFrame:
        dims = files.with_line_count(files.with_dimensions(archives.archive_to_files(batch)))
        labelled = files.with_language(dims, b.LANGUAGE_LABELS)
        return labelled.groupBy("repo", "language").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))

    for place, rows in (("first", d), ("second", d.filter((number % 2 == 0) & (F.col("doc_id") % 2 == 0))), (None, None)):
        if rows is not None:
            writers.write_archives(packed(rows), f"{landing}/{place}").write.format("noop").mode("overwrite").save()
        ingest.ingest_newest(spark, landing, out, checkpoint, summarise)
    return ingest.read_newest(spark, out).select("repo", "language", "files", "loc")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing = _landed(spark, sf_dir)
    out, checkpoint = fresh_folder(spark, "ingested"), fresh_folder(spark, "ingest-state")

    def summarise(batch: DataFrame) -> DataFrame:
        found = archives.archive_to_files(batch)
        dims = files.with_line_count(files.with_dimensions(found))
        labelled = files.with_language(dims, b.LANGUAGE_LABELS)
        return labelled.groupBy("repo", "language").agg(F.count("*").alias("files"), F.sum("loc").alias("loc"))

    # The second call finds nothing new and must add nothing.
    for _ in range(2):
        ingest.ingest_archives(spark, landing, out, checkpoint, summarise)
    return spark.read.parquet(out).select("repo", "language", "files", "loc")


def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs_out, history_out = fresh_folder(spark, "stream-runs"), fresh_folder(spark, "stream-history")
    schema = b.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)

    def records(batch: DataFrame) -> DataFrame:
        return files.run_records(b.as_measured(batch), [ENGINE_COLUMN, "repo"])

    ingest.append_runs(stream, records, runs_out, history_out, fresh_folder(spark, "history-state"))
    return trees.read_history(spark, history_out)


def queries() -> dict[str, Query]:
    return {
        "language_stats": language_stats,
        "markup_nodes": markup_nodes,
        "tree_stats": page_tree_stats,
        "prune_paths": prune_paths,
        "prune_glob": prune_glob,
        "supported_files": supported_files,
        "file_dims": file_dims,
        "repo_name": repo_names,
        "language_label": language_label,
        "loc_by_file": loc_by_file,
        "run_tag": run_tags,
        "mb_convert": mb_convert,
        "preview": previews,
        "json_tree_nodes": json_tree_nodes,
        "named_nodes": named_nodes,
        "outline": outline,
        "outline_json": outline_json,
        "page_outline": page_outline,
        "dump_outline": dump_outline,
        "offset_nodes": offset_nodes,
        "offset_stats": offset_stats,
        "shifted_nodes": shifted_nodes,
        "deep_tree_stats": deep_tree_stats,
        "json_or_raw": json_or_raw,
        "generic_tree_stats": generic_tree_stats,
        "indent_dump_nodes": indent_dump_nodes,
        "dump_node_estimate": dump_node_estimate,
        "tree_stats_compat": tree_stats_compat,
        "error_nodes": error_nodes,
        "kind_histogram": kind_histogram,
        "parent_kind_pairs": parent_kind_pairs,
        "line_nodes": line_nodes,
        "dispatch_nodes": dispatch_nodes,
        "dir_tree": dir_tree,
        "dir_rollup": dir_rollup,
        "renest_json": renest_json,
        "response_body": response_body,
        "response_trees": response_trees,
        "corpus_totals": corpus_totals,
        "language_rollup": language_rollup,
        "status_counts": status_counts,
        "throughput": throughput,
        "success_rate": success_rate,
        "peak_metrics": peak_metrics,
        "run_numbers": run_numbers,
        "engine_compare": engine_compare,
        "engine_speedup": engine_speedup,
        "mean_speedup": mean_speedup,
        "run_stats": run_stats,
        "runs_read": runs_read,
        "history_read": history_read,
        "history_head": history_head,
        "history_union": history_union,
        "scan_archives": scan_archives,
        "scan_tree": scan_tree,
        "text_dumps": text_dumps,
        "dumps_read": dumps_read,
        "analyse_history": analyse_history,
        "analyse_files": analyse_files,
        "snapshot_diff": snapshot_diff,
        "stream_analyse": stream_analyse,
        "snapshot_write": snapshot_write,
        "snapshot_json": snapshot_json,
        "stream_ingest": stream_ingest,
        "stream_newest": stream_newest,
        "stream_history": stream_history,
    }
