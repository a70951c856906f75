"""The given tables in the roles of the model.

The tables hold no program source, so files, trees, dumps and runs are derived from their
rows by Spark expressions. Every binding covers its whole table and whole texts, and each
derived file is built inside one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import ENGINE_COLUMN
from ..functions.paths import url_path
from ..functions.text import line_count, lines
from ..operators.files import with_language, with_line_count
from ..operators.line_trees import line_tree_sizes
from ..sources.layout import spread

# `.es` is left out on purpose: its label falls back to the extension.
LANGUAGE_LABELS = {".en": "english", ".fr": "french", ".de": "german"}

# Extensions dealt over documents to exercise the engines' own tables; the last four are a
# case variant, an unknown one, a name without a dot and a dotfile.
CODE_SUFFIXES = [
    "a.java", "b.py", "c.ts", "d.js", "e.cpp", "f.h", "g.c", "h.tsx", "i.jsx",
    "j.JS", "k.tar.gz", "Makefile", ".gitignore",
]
CODE_FOLDERS = ["src", "node_modules", "lib/.git", "dist", "src/x.github", "pkg/__pycache__", "app/core"]


# Outline classes of markup and of spelled dumps, and the kinds that name what is around them.
PAGE_CLASSES = {"article": "ARTICLE", "section": "SECTION", "div": "BLOCK", "nav": "MENU", "footer": "FOOTER", "header": "HEADER"}
PAGE_HEADINGS = ["h1", "h2", "h3", "title"]
DUMP_CLASSES = {"DeclStmt": "CLASS", "CallExpr": "METHOD"}
DUMP_NAMES = ["asm label"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(c: Column) -> Column:
    return c.cast("string")


def pick(values: list[str], by: Column) -> Column:
    """The value a number points at, going round the list."""
    return F.get(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a repository per source, with a time and a status of their own."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("repo"),
        F.concat("source", F.lit("/"), _text(F.col("doc_id")), F.lit("."), "lang").alias("file_path"),
        F.concat(F.lit("."), "lang").alias("ext"),
        F.col("text").alias("content"),
        (F.col("n_chars") * 1000).alias("parse_ns"),
    )


def measured_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with language, lines, and nodes and depth of their line trees."""
    files = with_line_count(line_tree_sizes(document_files(spark, sf_dir)))
    return with_language(files.drop("content"), LANGUAGE_LABELS)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under code-like paths."""
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws(
        "/", pick(CODE_FOLDERS, F.col("doc_id")), F.col("doc_id").cast("string"), pick(CODE_SUFFIXES, F.col("doc_id"))
    )
    return d.select(F.col("source").alias("repo"), path.alias("file_path"), "doc_id")


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of one site tree; the path is the URL without scheme and query."""
    p = table(spark, sf_dir, "pages")
    return p.select(
        F.lit("web").alias("repo"),
        F.concat(url_path(F.col("url")), F.lit("/"), _text(F.col("page_id")), F.lit(".html")).alias("file_path"),
        line_count(F.col("html")).alias("loc"),
        F.col("page_id"),
    )


def syntax_json(text: Column) -> Column:
    """A text as a syntax-tree dump of the generic dialect, built inside its row.

    Lines are declarations of four kinds; every second token is a method with an identifier,
    the others are unnamed leaves, and the first token names its line, except in every fifth.
    """

    def span(line: Column, begin: Column, end: Column) -> Column:
        at = line.cast("string")
        return F.concat(
            F.lit('"range":{"start":{"line":'), at, F.lit(',"col":'), begin.cast("string"),
            F.lit('},"end":{"line":'), at, F.lit(',"col":'), end.cast("string"), F.lit("}}"),
        )

    def leaf(head: Column, token: Column, line: Column, j: Column) -> Column:
        escaped = F.to_json(F.struct(token.alias("text")))
        return F.concat(head, span(line, j, j + F.char_length(token)), F.lit(","), F.substring(escaped, 2, 1 << 30))

    def token_node(token: Column, j: Column, line: Column) -> Column:
        first = (
            F.when(line % 5 == 0, '{"type":"word","isNamed":true,')
            .when(line % 3 == 0, '{"type":"identifier","isNamed":true,')
            .otherwise('{"type":"identifier","isNamed":true,"fieldName":"name",')
        )
        head = (
            F.when(j == 0, first)
            .when(j % 2 == 1, '{"type":"identifier","isNamed":true,')
            .otherwise('{"type":"punct","isNamed":false,')
        )
        own = leaf(head, token, line, j)
        method = F.concat(
            F.lit('{"type":"method_definition","isNamed":true,'), span(line, j, j + F.char_length(token)),
            F.lit(',"children":['), own, F.lit("]}"),
        )
        return F.when(j % 2 == 1, method).otherwise(own)

    def line_node(line: Column, i: Column) -> Column:
        kind = pick(["ERROR", "class_declaration", "expression_statement", "interface_declaration"], i + 1)
        tokens = F.transform(F.split(line, " ", -1), lambda t, j: token_node(t, j, i + 1))
        return F.concat(
            F.lit('{"type":"'), kind, F.lit('","isNamed":true,'), span(i + 1, F.lit(0), F.char_length(line)),
            F.lit(',"children":['), F.array_join(tokens, ","), F.lit("]}"),
        )

    return F.concat(
        F.lit('{"type":"program","isNamed":true,"children":['),
        F.array_join(F.transform(lines(text), line_node), ","),
        F.lit("]}"),
    )


def syntax_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as parsed syntax trees."""
    c = spread(table(spark, sf_dir, "conversations"))
    return c.select(
        _text(F.col("conv_id")).alias("repo"),
        _text(F.col("turn")).alias("file_path"),
        syntax_json(F.col("text")).alias("tree"),
    )


def _dumped(text: Column, leaf: Callable[[Column, Column, Column], Column], line: Callable[[Column, Column, Column], Column], root: Column) -> Column:
    """A dump of a text's lines and tokens: ``leaf`` (token, its number, line number), ``line``
    (line, its number, its children), ``root`` up to its children."""
    body = lambda t, i: line(t, i, F.array_join(F.transform(F.split(t, " ", -1), lambda w, j: leaf(w, j, i)), ","))
    return F.concat(root, F.array_join(F.transform(lines(text), body), ","), F.lit("]}"))


def offset_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as dumps of the dialect with character offsets, text on every node."""
    c = spread(table(spark, sf_dir, "conversations"))

    def span(begin: Column, text: Column) -> Column:
        return F.concat(F.lit('"range":{"start":'), _text(begin), F.lit(',"end":'), _text(begin + F.char_length(text)), F.lit("}"))

    said = lambda text: F.substring(F.to_json(F.struct(text.alias("text"))), 2, 1 << 30)
    leaf = lambda w, j, i: F.concat(F.lit('{"kind":"Identifier",'), span(i * 1000 + j, w), F.lit(","), said(w))
    line = lambda t, i, kids: F.concat(F.lit('{"kind":"Block",'), span(i * 1000, t), F.lit(',"children":['), kids, F.lit("]}"))
    tree = _dumped(F.col("text"), leaf, line, F.lit('{"kind":"SourceFile","text":"x","range":{"start":0,"end":9},"children":['))
    return c.select(_text(F.col("conv_id")).alias("repo"), _text(F.col("turn")).alias("file_path"), tree.alias("tree"))


def shifted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as dumps of the dialect whose lines begin at 0 and whose leaves have an
    empty list of children."""
    c = spread(table(spark, sf_dir, "conversations"))

    def span(line: Column, begin: Column, text: Column) -> Column:
        point = lambda col: F.concat(F.lit('{"line":'), _text(line), F.lit(',"col":'), _text(col), F.lit("}"))
        return F.concat(F.lit('"range":{"start":'), point(begin), F.lit(',"end":'), point(begin + F.char_length(text)), F.lit("}"))

    said = lambda text: F.regexp_replace(F.substring(F.to_json(F.struct(text.alias("text"))), 2, 1 << 30), r"\}$", "")
    leaf = lambda w, j, i: F.concat(F.lit('{"type":"word",'), span(i, j, w), F.lit(","), said(w), F.lit(',"children":[]}'))
    line = lambda t, i, kids: F.concat(F.lit('{"type":"line",'), span(i, F.lit(0), t), F.lit(',"children":['), kids, F.lit("]}"))
    tree = _dumped(F.col("text"), leaf, line, F.lit('{"type":"program","children":['))
    return c.select(_text(F.col("conv_id")).alias("repo"), _text(F.col("turn")).alias("file_path"), tree.alias("tree"))


def deep_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as single-branch trees of up to forty levels, and of up to 740 for some."""
    o = spread(table(spark, sf_dir, "orders"))
    depth = (F.col("o_orderkey") % 40 + F.when(F.col("o_orderkey") % 500 == 0, 700).otherwise(0)).cast("int")
    text = F.concat(
        F.repeat(F.lit('{"type":"block","isNamed":true,"children":['), depth),
        F.concat(F.lit('{"type":"leaf","isNamed":false,"text":"'), F.col("o_orderpriority"), F.lit('"}')),
        F.repeat(F.lit("]}"), depth),
    )
    return o.select(
        F.col("o_orderstatus").alias("repo"),
        _text(F.col("o_orderkey")).alias("file_path"),
        text.alias("tree"),
    )


def object_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as nested objects: a skipped key, nested arrays, a chain, and a part with
    ``children`` inside a part without."""
    item = spread(table(spark, sf_dir, "lineitem"))
    entries = F.transform(
        F.sequence(F.lit(1), F.col("l_linenumber")),
        lambda i: F.concat(F.lit('{"i":'), _text(i), F.lit(',"part":{"id":'), _text(F.col("l_partkey")), F.lit("}}")),
    )
    length = (F.col("l_partkey") % 12 + 1).cast("int")
    text = F.concat(
        F.lit('{"order":{"key":'), _text(F.col("l_orderkey")), F.lit(',"lines":['), F.array_join(entries, ","),
        F.lit(']},"parent":{"x":{"y":1}},"flags":[1,"a",null],"grid":[[{"a":1}],[]],"chain":'),
        F.repeat(F.lit('{"c":'), length), F.lit("1"), F.repeat(F.lit("}"), length),
        F.lit(',"tree":{"kind":"t","children":[{"kind":"u","range":{"s":{"l":1}}},5,null,[{"z":1}]],"other":{"q":1}}}'),
    )
    return item.select("l_orderkey", "l_linenumber", "l_partkey", text.alias("tree"))


def event_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as tree dumps: sound ones, cut-off ones, and ones that only report an
    error."""
    e = spread(table(spark, sf_dir, "events"))
    content = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("  "), F.expr("substring(props, 1, length(props) - 1)"), F.lit("\n")))
        .when(F.col("event_type") == "signup", F.concat(F.lit('{"error":"at '), _text(F.col("user_id")), F.lit('"}')))
        .otherwise(F.col("props"))
    )
    return e.select(
        F.col("event_type").alias("repo"),
        F.concat(_text(F.col("event_id")), F.lit(".json")).alias("file_path"),
        content.alias("content"),
        (F.round(F.col("value") * 100).cast("bigint") * 10000).alias("parse_ns"),
    )


def spelled_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as `Kind: 'spelling'` dumps, two blanks a level, levels rising and falling."""
    d = spread(table(spark, sf_dir, "documents"))

    def line(text: Column, i: Column) -> Column:
        wave = i % 6
        level = F.when(wave <= 3, wave + 1).otherwise(7 - wave).cast("int")
        kind = pick(["DeclStmt", "asm label", "CallExpr"], i)
        return F.concat(F.repeat(F.lit("  "), level), kind, F.lit(": '"), text, F.lit("'"))

    dump = F.concat(
        F.lit("TranslationUnit: '"), _text(F.col("doc_id")), F.lit("'\n"),
        F.array_join(F.transform(lines(F.col("text")), line), "\n"),
    )
    return d.select(F.col("source").alias("repo"), _text(F.col("doc_id")).alias("file_path"), dump.alias("content"))


def constructor_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as constructor dumps, four blanks a level; one in seven has no constructor."""
    d = spread(table(spark, sf_dir, "documents"))

    def line(_: Column, i: Column) -> Column:
        head = F.when(F.col("doc_id") % 7 == 0, "args=[").when(i % 2 == 0, "value=Expr(").otherwise("body=[")
        return F.concat(F.repeat(F.lit("    "), (i % 5).cast("int")), head)

    dump = F.array_join(F.transform(lines(F.col("text")), line), "\n")
    return d.select(F.col("source").alias("repo"), _text(F.col("doc_id")).alias("file_path"), dump.alias("content"))


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as runs of two engines by turns, one repository per user."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    engine = F.when(F.col("event_id") % 2 == 0, "generic").otherwise("native")
    ns = F.round(F.col("value") * 100).cast("bigint") * 10000
    return e.select(
        _text(F.col("user_id")).alias("repo"),
        engine.alias("engine"),
        "ts",
        F.col("event_id").alias("run_id"),
        (k + 1).alias("files"),
        (k * 100).alias("loc"),
        (k * 700).alias("nodes"),
        (k % 20 + 1).cast("int").alias("max_depth"),
        ns.alias("parse_ns"),
        (ns * 2).alias("total_ns"),
        (k * 1048576 + F.col("event_id")).alias("rss_bytes"),
        (k * 524288 + F.col("event_id")).alias("heap_bytes"),
    )


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as measured files: repository per user, language per event type."""
    return as_measured(table(spark, sf_dir, "events"))


def as_measured(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    ns = F.round(F.col("value") * 100).cast("bigint") * 10000
    return events.select(
        F.lit("generic").alias(ENGINE_COLUMN),
        _text(F.col("user_id")).alias("repo"),
        F.col("event_type").alias("language"),
        "ts",
        k.alias("loc"),
        (k * 7).alias("nodes"),
        (k % 20 + 1).cast("int").alias("max_depth"),
        ns.alias("parse_ns"),
        (ns * 2).alias("total_ns"),
        (k * 1048576 + F.col("event_id")).alias("rss_bytes"),
        (k * 524288 + F.col("event_id")).alias("heap_bytes"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
    )
