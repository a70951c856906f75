"""Column functions on the edge cases their rules are about."""

import pytest
from pyspark.sql import functions as F

from treeloom.functions import numbers, paths, text


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_extension(spark):
    names = ["a.js", ".gitignore", "a.tar.gz", "a.", "A.JS", "x/y.z/b", "dist", "d/.env.local"]
    assert values(spark, paths.extension, names) == [".js", "", ".gz", ".", ".JS", "", "", ".local"]


def test_line_count(spark):
    assert values(spark, text.line_count, ["", None, "a", "a\n", "a\nb", "a\r\nb", "\n"]) == [0, 0, 1, 2, 2, 2, 2]


def test_repo_name_falls_through_empty_names(spark):
    row = spark.range(1).select(
        paths.repo_name(F.lit(""), F.lit(None).cast("string"), paths.without_zip(F.lit("a.zip"))),
        paths.repo_name(F.lit(""), F.lit("")),
        paths.repo_name(F.lit("x"), F.lit("y")),
    ).first()
    assert tuple(row) == ("a", "unknown", "x")


def test_prune_exact_names_at_every_level_files_too(spark):
    names = ["a/node_modules/b.js", "dist", "src/dist", "src/distant/a.js", "x/.gitignore", "a/__pycache__/b.py"]
    assert values(spark, paths.is_pruned, names) == [True, True, True, False, False, True]


def test_prune_glob_is_looser(spark):
    names = ["./a/node_modules/b.js", "./x/.gitignore", "./src/x.github/a", "./src/a.js", "./node_modulesX/a"]
    assert values(spark, paths.matches_pruned_glob, names) == [True, True, True, False, False]


def test_run_tag(spark):
    row = spark.range(1).select(paths.run_tag(F.lit("a/b c.d"), F.lit("2024-01-02T03:04:05.678Z"))).first()
    assert row[0] == "a_b_c_d_2024-01-02T03-04-05-678Z"


def test_halves_round_up(spark):
    assert values(spark, numbers.seconds, [1_499_999, 1_500_000, 0], "bigint") == [0.001, 0.002, 0.0]
    assert values(spark, numbers.megabytes, [None, 0, 1048576, 15728640 + 5243], "bigint") == [0.0, 0.0, 1.0, 15.01]


def test_trim_all_white_space(spark):
    assert values(spark, text.trimmed, [" \t a b \r\n", "a"]) == ["a b", "a"]


def test_dump_lines(spark):
    lines = ["    VarDecl: 'rect'", "asm label: ''", "  StringLiteral: '\"it's: %d\"'", "no dump"]
    assert values(spark, text.spelled_kind, lines) == ["VarDecl", "asm label", "StringLiteral", ""]
    assert values(spark, text.spelled_text, lines) == ["rect", "", "\"it's: %d\"", ""]
    assert values(spark, text.opens_constructor, ["  Name(id='x')", "args=[", "f(x)"]) == [True, False, False]


@pytest.mark.parametrize(
    "url, path",
    [
        ("http://a.example.com/fr/8?page=2&ref=x", "a.example.com/fr/8"),
        ("https://b.example.net/en/25#top", "b.example.net/en/25"),
        ("https://c.example.net/es/5/", "c.example.net/es/5"),
    ],
)
def test_url_path(spark, url, path):
    assert values(spark, paths.url_path, [url]) == [path]


def test_workers_hold_no_more_for_larger_batches():
    """What JSON and nesting need beside a batch follows the bytes looked at together, not the batch."""
    import tracemalloc

    import pyarrow as pa

    from treeloom.functions import brackets, nesting

    def peak(work):
        tracemalloc.start()
        try:
            work()
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    text = '{"type":"n","children":[' + ",".join(['{"type":"x","text":"t"}'] * 400) + "]}"
    for scan in (brackets.tree_of, brackets.named_tree_of, brackets.root_of, brackets.object_sizes):
        sizes = [peak(lambda: [None for _ in scan.func(iter([pa.array([text] * n)]))]) for n in (400, 1600)]
        assert sizes[1] < 1.3 * sizes[0]
    levels = [1] + [2, 3] * 2000
    for nest, values in ((nesting.nest_by_levels, [levels]), (nesting.nest_marked, [levels, [1] * len(levels)])):
        sizes = [peak(lambda: nest.func(*[pa.array([v] * n, pa.list_(pa.int32())) for v in values])) for n in (200, 800)]
        # Its result, of 25 bytes a value, is all that grows.
        assert sizes[1] - sizes[0] < 50 * 600 * len(levels)


def test_positions_are_read_as_casts_do(spark):
    from treeloom.functions.brackets import whole

    said = ["5", "-7", "+8", " 12 ", "1.5", "-1.9", "1e2", "3000000000", "2147483647.5", "2147483648", "-2147483648.9", "1e400", "true", "null",
            "", "x", "1d", "2.5F", "0x1p3", "NaN", "Infinity", "inf", ".5", "5.", "1e", "--1", "1_0", " 3", "\t4\n", "١"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    cast = rows.selectExpr("i", "coalesce(try_cast(s as int), try_cast(try_cast(s as double) as int)) as n").orderBy("i").collect()
    assert [(s, whole(s)) for s in said] == [(s, r.n) for s, r in zip(said, cast)]
