"""Node rows back to nested JSON, without ever holding a tree.

Each node writes its own piece of text: a comma if it follows a sibling, its fields, and as
many closing brackets as ``closes`` says. Pieces in ``node_id`` order are the document, whatever
its size, so a document is a sort. The answer for a repository is one sort of two streams of
pieces, folders and the nodes inside files, under one composite key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import base_name, parent_path
from ..session import durable
from .directories import dir_tree

# Sorts what closes a file after all of its nodes.
AFTER_ALL = 2**31 - 1


def _range(offsets: bool) -> Column:
    if offsets:
        return F.struct(
            F.coalesce("start_off", F.lit(0)).alias("start"), F.coalesce("end_off", F.lit(0)).alias("end")
        )

    def point(side: str) -> Column:
        line, col = F.coalesce(f"{side}_line", F.lit(0)), F.coalesce(f"{side}_col", F.lit(0))
        return F.struct(line.alias("line"), col.alias("col")).alias(side)

    return F.struct(point("start"), point("end"))


def json_fragments(nodes: DataFrame, keys: list[str], offsets: bool = False) -> DataFrame:
    """One piece of JSON text per node. Fields without a value are left out; a range that is
    missing is written as zeros. Several roots of one file are separated by line feeds."""
    kind_key = "kind" if offsets else "type"
    body = F.to_json(
        F.struct(
            F.col("kind").alias(kind_key),
            F.col("is_named").alias("isNamed"),
            F.col("field_name").alias("fieldName"),
            _range(offsets).alias("range"),
            F.when(F.col("is_leaf"), F.col("text")).alias("text"),
        )
    )
    before = F.when(F.col("ordinal") == 0, "").when(F.col("depth") == 1, "\n").otherwise(",")
    inner = F.concat(before, F.expr("substring(_body, 1, length(_body) - 1)"), F.lit(',"children":['))
    return nodes.withColumn("_body", body).select(
        *keys,
        "node_id",
        F.when(F.col("is_leaf"), F.concat(before, F.col("_body"), F.repeat(F.lit("]}"), F.col("closes"))))
        .otherwise(inner)
        .alias("fragment"),
    )


def nested_json(nodes: DataFrame, keys: list[str], offsets: bool = False) -> DataFrame:
    """``keys`` and ``json``: each file's nodes nested again, as one document. A file's document
    must fit one row; larger ones are written from their pieces (``writers.write_fragments``)."""
    pieces = F.array_sort(F.collect_list(F.struct("node_id", "fragment")))
    text = F.array_join(F.transform(pieces, lambda p: p["fragment"]), "")
    return json_fragments(nodes, keys, offsets).groupBy(*keys).agg(text.alias("json"))


def _place(path: Column, closing: bool = False) -> Column:
    """Sorts pieces into document order: folders before what they hold, closing brackets after
    it, children by name."""
    steps = F.transform(F.split(path, "/"), lambda s: F.struct(F.lit(0).alias("after"), s.alias("name")))
    steps = F.when(path == "", F.filter(steps, lambda s: F.lit(False))).otherwise(steps)
    if not closing:
        return steps
    return F.concat(steps, F.array(F.struct(F.lit(1).alias("after"), F.lit("").alias("name"))))


def _open(text: Column) -> Column:
    """A JSON object without its last bracket."""
    return F.regexp_replace(text, r"\}$", "")


def response_fragments(files: DataFrame, runs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The whole answer for a repository as ordered pieces: (repo, place, seq, fragment), in the
    order of place and seq.

    ``files`` has repo, file_path, ast (JSON text or null) and error; ``runs`` has repo,
    timestamp and benchmark (JSON text). With ``nodes`` (a node table of repo and file_path, one
    root a file) the tree of each file without an error is written from its nodes instead of
    ``ast``. A repository's pieces are never brought together here: a range-sorted text write is
    the document. Rows that repeat a path count once.
    """
    dirs = dir_tree(files).select("repo", F.col("dir_path").alias("path"), F.lit(True).alias("is_dir"))
    entries = dirs.withColumns({"ast": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    entries = entries.unionByName(
        files.select("repo", F.col("file_path").alias("path"), F.lit(False).alias("is_dir"), "ast", "error")
    ).withColumn("_above", parent_path(F.col("path")))
    # Read twice: for what comes first in its folder, and for the pieces.
    entries = durable(entries.dropDuplicates(["repo", "path", "is_dir"]))
    first = entries.groupBy("repo", "_above").agg(F.min(F.struct(base_name(F.col("path")), ~F.col("is_dir"))).alias("_first"))
    name = base_name(F.col("path"))
    known = F.to_json(
        F.struct(
            F.when(F.col("is_dir"), "directory").otherwise("file").alias("type"),
            name.alias("name"),
            F.col("path").alias("filePath"),
            F.col("error"),
        )
    )
    leads = F.struct(name, ~F.col("is_dir")) == F.col("_first")
    comma = F.when(leads, "").otherwise(",")
    treed = ~F.col("is_dir") & F.col("error").isNull() if nodes is not None else F.lit(False)
    text = (
        F.when(F.col("is_dir"), F.concat(comma, _open(F.col("_known")), F.lit(',"children":[')))
        .when(treed, F.concat(comma, _open(F.col("_known")), F.lit(',"ast":')))
        .when(F.col("ast").isNotNull(), F.concat(comma, _open(F.col("_known")), F.lit(',"ast":'), F.col("ast"), F.lit("}")))
        .otherwise(F.concat(comma, F.col("_known")))
    )

    def piece(at: Column, seq: int, fragment: Column) -> Column:
        return F.struct(at.alias("place"), F.lit(seq).alias("seq"), fragment.alias("fragment"))

    opening = piece(_place(F.col("path")), 0, text)
    after_dir = piece(_place(F.col("path"), True), 0, F.lit("]}"))
    after_file = piece(_place(F.col("path")), AFTER_ALL, F.lit("}"))
    pieces = F.when(F.col("is_dir"), F.array(opening, after_dir)).when(treed, F.array(opening, after_file)).otherwise(F.array(opening))
    inside = (
        entries.join(first, ["repo", "_above"])
        .withColumn("_known", known)
        .select("repo", F.explode(pieces).alias("_p"))
        .select("repo", "_p.place", "_p.seq", "_p.fragment")
    )
    root = F.to_json(F.struct(F.lit("directory").alias("type"), F.col("repo").alias("name"), F.lit("").alias("filePath")))
    head = runs.select(
        "repo",
        _place(F.lit("")).alias("place"),
        F.lit(0).alias("seq"),
        F.concat(F.lit('{"nodes":['), _open(root), F.lit(',"children":[')).alias("fragment"),
    )
    tail = runs.select(
        "repo",
        _place(F.lit(""), True).alias("place"),
        F.lit(0).alias("seq"),
        F.concat(
            F.lit(']}],"timestamp":"'), F.col("timestamp"), F.lit('","benchmark":'), F.col("benchmark"), F.lit("}")
        ).alias("fragment"),
    )
    every = inside.unionByName(head).unionByName(tail)
    if nodes is None:
        return every
    trees = json_fragments(nodes, ["repo", "file_path"])
    return every.unionByName(trees.select("repo", _place(F.col("file_path")).alias("place"), F.col("node_id").alias("seq"), "fragment"))
