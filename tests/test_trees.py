"""Tree builders against plain recursions and hand-made trees."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from treeloom.fixed_values import OUTLINE_CLASS_BY_KIND
from treeloom.operators import dump_trees, json_trees, line_trees, markup_trees, outlines, renest, tree_stats

KEYS = ["repo", "file_path"]


def files(spark, *texts):
    return spark.createDataFrame([("r", str(i), t) for i, t in enumerate(texts)], "repo string, file_path string, content string")


def parsed(spark, *trees):
    return json_trees.parse_or_raw(files(spark, *[json.dumps(t) for t in trees]))


def outlined(trees, **settings):
    return outlines.outline(json_trees.node_arrays(trees), KEYS, OUTLINE_CLASS_BY_KIND, **settings)


def leaf(kind, text, **more):
    return {"type": kind, "isNamed": True, "text": text, **more}


CLASS = {
    "type": "program",
    "isNamed": True,
    "range": {"start": {"line": 1, "col": 0}, "end": {"line": 9, "col": 1}},
    "children": [
        {
            "type": "class_declaration",
            "isNamed": True,
            "range": {"start": {"line": 1, "col": 0}, "end": {"line": 8, "col": 1}},
            "children": [
                {"type": "class", "isNamed": False, "text": "class"},
                leaf("identifier", "Shape", fieldName="name"),
                {
                    "type": "class_body",
                    "isNamed": True,
                    "children": [
                        {"type": "{", "isNamed": False, "text": "{"},
                        {"type": "method_definition", "isNamed": True, "children": [leaf("identifier", "area")]},
                        {"type": "method_definition", "isNamed": True, "children": [leaf("block", "{}")]},
                        {"type": "ERROR", "isNamed": True, "text": "?"},
                    ],
                },
            ],
        },
        {"type": "function_declaration", "isNamed": True, "children": [leaf("identifier", "main"), leaf("x", "y", fieldName="name")]},
    ],
}


def walk(node, parent=None, depth=1, out=None):
    out = [] if out is None else out
    me = len(out) + 1
    out.append((me, parent, depth, node["type"], "children" not in node))
    for child in node.get("children", []):
        walk(child, me, depth + 1, out)
    return out


def test_flatten_is_preorder(spark):
    nodes = json_trees.json_nodes(parsed(spark, CLASS))
    got = [tuple(r) for r in nodes.orderBy("node_id").select("node_id", "parent_id", "depth", "kind", "is_leaf").collect()]
    assert got == walk(CLASS)


def test_stats_and_leaf_range_extra(spark):
    nodes = json_trees.json_nodes(parsed(spark, CLASS))
    row = tree_stats.tree_stats(nodes, KEYS).first()
    assert (row.nodes, row.max_depth, row.leaves, row.errors) == (14, 5, 8, 1)
    compat = tree_stats.tree_stats_compat(nodes, KEYS, "generic").first()
    assert (compat.compat_nodes, compat.compat_max_depth) == (14 + 3 * 8, 7)


def test_leaf_extra_equals_the_object_walk(spark):
    def ranged(node):
        point = {"line": 1, "col": 0}
        return {**node, "range": {"start": point, "end": point}, **({"children": [ranged(c) for c in node["children"]]} if "children" in node else {})}

    trees = parsed(spark, ranged(CLASS))
    compat = tree_stats.tree_stats_compat(json_trees.json_nodes(trees), KEYS, "generic").first()
    walked = json_trees.object_tree_stats(trees).first()
    assert (compat.compat_nodes, compat.compat_max_depth) == (walked.nodes, walked.max_depth)


def test_offset_dialect(spark):
    tree = {"kind": "SourceFile", "text": "a b", "range": {"start": 0, "end": 3},
            "children": [{"kind": "Identifier", "text": "a", "range": {"start": 0, "end": 1}},
                         {"kind": "Identifier", "text": "b", "range": {"start": 2, "end": 3}}]}
    nodes = json_trees.json_nodes(parsed(spark, tree), dialect="offsets").orderBy("node_id").collect()
    assert [(n.kind, n.text, n.start_off, n.end_off, n.start_line) for n in nodes] == [
        ("SourceFile", None, 0, 3, None), ("Identifier", "a", 0, 1, None), ("Identifier", "b", 2, 3, None)]


def test_zero_based_lines_are_shifted(spark):
    tree = {"type": "a", "text": "x", "range": {"start": {"line": 0, "col": 2}, "end": {"line": 1, "col": 0}}, "children": []}
    node = json_trees.json_nodes(parsed(spark, tree), dialect="named").first()
    assert (node.start_line, node.start_col, node.end_line, node.is_leaf, node.text) == (1, 2, 2, True, "x")


def test_named_only_skips_the_subtree(spark):
    tree = {"type": "a", "isNamed": True, "children": [
        {"type": "b", "isNamed": False, "children": [leaf("c", "1")]}, leaf("d", "2")]}
    kinds = [r.kind for r in json_trees.json_nodes(parsed(spark, tree), named_only=True).orderBy("node_id").collect()]
    assert kinds == ["a", "d"]


def test_outline(spark):
    rows = outlined(parsed(spark, CLASS)).orderBy("node_id").collect()
    assert [(r["class"], r["name"], r["outline_parent_id"]) for r in rows] == [
        ("CLASS", "Shape", None), ("METHOD", "area", 2), ("METHOD", "anonymous", 2), ("METHOD", "y", None)]
    assert (rows[0].start_line, rows[0].end_line, rows[0].end_col) == (1, 8, 1)


def test_parse_or_raw(spark):
    rows = json_trees.parse_or_raw(files(spark, '{"kind":"a"}', "  Module(\n  ", '{"error":"x"}', "", None)).orderBy("file_path").collect()
    assert [(r.status, r.raw_dump) for r in rows] == [("ok", None), ("raw", "Module("), ("error", None), ("raw", ""), ("raw", None)]


def object_walk(value, depth=1):
    """Plain recursion with the same rules, for comparison."""
    if not isinstance(value, (dict, list)):
        return 0, 0
    if isinstance(value, dict) and isinstance(value.get("children"), list):
        below = value["children"]
    else:
        fields = [v for k, v in value.items() if k != "parent"] if isinstance(value, dict) else value
        below = [i for v in fields for i in (v if isinstance(v, list) else [v])]
    counted = [object_walk(v, depth + 1) for v in below]
    return 1 + sum(n for n, _ in counted), max([depth] + [d for _, d in counted])


JSON_VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab", max_size=2),
    lambda inner: st.lists(inner, max_size=3)
    | st.dictionaries(st.sampled_from(["children", "parent", "range", "k"]), inner, max_size=3),
    max_leaves=25,
)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(JSON_VALUES, min_size=40, max_size=40))
def test_object_walk_on_random_json(spark, values):
    rows = json_trees.object_tree_stats(parsed(spark, *values)).collect()
    got = {int(r.file_path): (r.nodes, r.max_depth) for r in rows}
    assert got == {i: object_walk(v) for i, v in enumerate(values)}


def test_deep_tree_beyond_the_first_rounds(spark):
    text = '{"type":"n","children":[' * 300 + '{"type":"x","text":"t"}' + "]}" * 300
    trees = json_trees.parse_or_raw(files(spark, text))
    row = tree_stats.tree_stats(json_trees.json_nodes(trees), KEYS).first()
    assert (row.nodes, row.max_depth, row.leaves) == (301, 301, 1)
    walked = json_trees.object_tree_stats(trees).first()
    assert (walked.nodes, walked.max_depth) == (301, 301)


@pytest.mark.parametrize("depth", [520, 1500, 5000])
def test_any_depth(spark, depth):
    text = '{"type":"n","children":[' * depth + '{"type":"x","text":"t"}' + "]}" * depth
    trees = json_trees.parse_or_raw(files(spark, text))
    assert trees.first().status == "ok"
    row = tree_stats.tree_stats(json_trees.json_nodes(trees), KEYS).first()
    assert (row.nodes, row.max_depth, row.leaves) == (depth + 1, depth + 1, 1)
    walked = json_trees.object_tree_stats(trees).first()
    assert (walked.nodes, walked.max_depth) == (depth + 1, depth + 1)


def test_long_text(spark):
    """One text beyond twenty million characters."""
    text = '{"type":"n","children":[' + ",".join(['{"type":"x","text":"' + "t" * 200 + '"}'] * 100_000) + "]}"
    trees = json_trees.parse_or_raw(files(spark, text))
    assert tree_stats.tree_stats(json_trees.json_nodes(trees), KEYS).first().nodes == 100_001


JSON_TEXT = st.text('{}[]:,"\\01-.eE+ntruefalsk \n', max_size=12) | JSON_VALUES.map(json.dumps)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(JSON_TEXT, min_size=500, max_size=500))
def test_what_is_json(spark, texts):
    def refuse(_):
        raise ValueError

    def valid(text):
        try:
            json.loads(text, parse_constant=refuse)
            return True
        except ValueError:
            return False

    read = json_trees.parse_or_raw(files(spark, *texts)).collect()
    assert {int(r.file_path): r.status != "raw" for r in read} == {i: valid(t) for i, t in enumerate(texts)}


def test_strings_of_any_spelling(spark):
    said = 'quote " back \\ \n é 漢 \u0001 😀' + "\\\"" * 5000
    trees = [leaf("x", said), {"t\u0079pe": "k", "children": []}]
    texts = [json.dumps(trees[0]), json.dumps(trees[0], ensure_ascii=False), '{"t\\u0079pe":"k\\u00e9"}']
    rows = json_trees.json_nodes(json_trees.parse_or_raw(files(spark, *texts))).orderBy("file_path").collect()
    assert [r.text for r in rows[:2]] == [said, said] and rows[2].kind == "ké"


def test_only_the_tree_is_walked(spark):
    """Objects elsewhere are no nodes, wherever children are listed; the last of equal keys counts."""
    text = '{"meta":{"children":[{"type":"no"}]},"type":"a","type":"b","children":[{"type":"c","extra":[{"type":"no"}]},5,null,[{"type":"no"}]]}'
    rows = json_trees.json_nodes(json_trees.parse_or_raw(files(spark, text))).orderBy("node_id").collect()
    assert [(r.kind, r.depth, r.parent_kind) for r in rows] == [("b", 1, None), ("c", 2, "b")]


def nested_outline(node, out):
    """The outline by a plain recursion."""
    here = out
    if node["type"] in OUTLINE_CLASS_BY_KIND:
        kids = node.get("children", [])
        named = [k for k in kids if k.get("fieldName") == "name"] or [k for k in kids if k["type"] in ("identifier", "type_identifier")]
        zero = {"line": 0, "col": 0}
        item = {
            "type": OUTLINE_CLASS_BY_KIND[node["type"]],
            "name": named[0].get("text") if named else "anonymous",
            "range": node.get("range", {"start": zero, "end": zero}),
            "children": [],
        }
        out.append(item)
        here = item["children"]
    for child in node.get("children", []):
        nested_outline(child, here)
    return out


KINDS = ["class_declaration", "method_definition", "block", "interface_declaration", "identifier"]
TREES = st.recursive(
    st.sampled_from(KINDS).map(lambda k: leaf(k, k[:2])),
    lambda inner: st.builds(lambda k, c: {"type": k, "isNamed": True, "children": c}, st.sampled_from(KINDS[:4]), st.lists(inner, min_size=1, max_size=4)),
    max_leaves=25,
)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TREES, min_size=30, max_size=30))
def test_outline_documents_of_random_trees(spark, trees):
    def leafy(node):
        # A name that is no leaf is spelled by its leaves; keep the recursion above plain.
        return [n for n in walk(node) if n[3] == "identifier" and not n[4]] == []

    trees = [t for t in trees if leafy(t)]
    arrays = json_trees.node_arrays(parsed(spark, *trees))
    want = {str(i): nested_outline(t, []) for i, t in enumerate(trees)}
    for each in (arrays, outlines.gathered(json_trees.json_nodes(parsed(spark, *trees)), KEYS)):
        got = {r.file_path: json.loads(r.outline) for r in outlines.outline_documents(each, KEYS, OUTLINE_CLASS_BY_KIND).collect()}
        assert got == want


def test_name_that_is_not_a_leaf(spark):
    tree = {"type": "class_declaration", "children": [
        {"type": "path", "fieldName": "name", "children": [leaf("identifier", "a"), leaf("dot", "."), leaf("identifier", "b")]}]}
    assert [r["name"] for r in outlined(parsed(spark, tree)).collect()] == ["a.b"]


def test_files_without_nodes_stay_in_the_totals(spark):
    read = json_trees.parse_or_raw(files(spark, json.dumps(CLASS), "not json", "5", None))
    nodes = json_trees.json_nodes(read)
    found = tree_stats.tree_stats_compat(nodes, KEYS, "generic", read).orderBy("file_path").collect()
    assert [(r.nodes, r.max_depth, r.compat_max_depth) for r in found] == [(14, 5, 7), (0, 0, 0), (0, 0, 0), (0, 0, 0)]
    assert tree_stats.error_nodes(nodes, KEYS, read).count() == 4


def test_roots_that_are_no_trees(spark):
    read = json_trees.parse_or_raw(files(spark, "5", "[1]", '{"error":"x"}'))
    assert [r.status for r in read.orderBy("file_path").collect()] == ["no_tree", "no_tree", "error"]


def stack_of_tags(tags):
    """Depth and parent of each element by a plain stack."""
    stack, out = [], []
    for tag in tags:
        if tag == "/":
            if stack:
                stack.pop()
        else:
            out.append((len(out) + 1, stack[-1] if stack else None, len(stack) + 1))
            if tag != "br":
                stack.append(len(out))
    return out, set(stack)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["p", "b", "br", "/", "/"]), max_size=30), min_size=30, max_size=30))
def test_markup_against_a_stack(spark, pages):
    html = ["".join("</p>" if t == "/" else f"<{t}>" for t in tags) for tags in pages]
    rows = markup_trees.markup_nodes(files(spark, *html)).collect()
    for i, tags in enumerate(pages):
        mine = sorted((r for r in rows if r.file_path == str(i)), key=lambda r: r.node_id)
        expected, left_open = stack_of_tags(tags)
        assert [(r.node_id, r.parent_id, r.depth) for r in mine] == expected
        assert {r.node_id for r in mine if r.is_error} == left_open


def test_markup_details(spark):
    html = '<!DOCTYPE html><HTML><!-- <p> --><script>var t="</p>";</script><p>a <br>b<img/>c</p><div>'
    rows = markup_trees.markup_nodes(files(spark, html)).orderBy("node_id").collect()
    assert [(r.kind, r.depth, r.text, r.is_error) for r in rows] == [
        ("html", 1, None, True), ("script", 2, "", False), ("p", 2, None, False), ("br", 3, "", False),
        ("img", 3, "", False), ("div", 2, "", True)]
    assert [r.parent_kind for r in rows] == [None, "html", "html", "p", "p", "html"]


def test_spelled_dump(spark):
    dump = "TranslationUnit: 'a.c'\n  FunctionDecl: 'main'\n    asm label: ''\n  VarDecl: 'x'\n"
    rows = dump_trees.dump_nodes(files(spark, dump)).orderBy("node_id").collect()
    assert [(r.kind, r.text, r.parent_id, r.depth, r.closes) for r in rows] == [
        ("TranslationUnit", "a.c", None, 1, 0), ("FunctionDecl", "main", 1, 2, 0), ("asm label", "", 2, 3, 1), ("VarDecl", "x", 1, 2, 1)]


def test_dump_whose_indent_skips_levels(spark):
    dump = "A: ''\n      B: ''\n    C: ''\nD: ''\n    E: ''"
    rows = dump_trees.dump_nodes(files(spark, dump)).orderBy("node_id").collect()
    assert [(r.kind, r.parent_id) for r in rows] == [("A", None), ("B", 1), ("C", 1), ("D", None), ("E", 4)]


def test_constructor_dump(spark):
    dump = "Module(\n    body=[\n        Expr(\n            value=Name(id='x'))])"
    rows = dump_trees.dump_nodes(files(spark, dump), width=4, spelled=False).orderBy("node_id").collect()
    assert [(r.kind, r.field_name, r.depth) for r in rows] == [
        ("Module", None, 1), (None, "body", 2), ("Expr", None, 3), ("Name", "value", 4)]
    estimate = dump_trees.dump_estimate(files(spark, dump, "invalid syntax")).orderBy("file_path").collect()
    assert [(r.nodes, r.max_depth, r.status) for r in estimate] == [(3, 4, "ok"), (1, 1, "error")]


def test_line_tree_places(spark):
    rows = line_trees.line_nodes(files(spark, "ab c\n\nd")).orderBy("node_id").collect()
    assert [(r.kind, r.text, r.start_line, r.start_col, r.start_off, r.end_off, r.closes) for r in rows] == [
        ("document", None, 1, 0, 0, 7, 0), ("line", None, 1, 0, 0, 4, 0), ("token", "ab", 1, 0, 0, 2, 0),
        ("token", "c", 1, 3, 3, 4, 1), ("line", None, 2, 0, 5, 5, 0), ("token", "", 2, 0, 5, 5, 1),
        ("line", None, 3, 0, 6, 7, 0), ("token", "d", 3, 0, 6, 7, 2)]


def test_line_tree_sizes_agree_with_the_nodes(spark):
    f = files(spark, "", None, "a", "a b\nc", "\n\n", " é ", "x\n")
    nodes = tree_stats.tree_stats(line_trees.line_nodes(f), KEYS).select("file_path", "nodes", "max_depth")
    sizes = line_trees.line_tree_sizes(f).select("file_path", "nodes", "max_depth")
    assert sorted(nodes.collect()) == sorted(sizes.collect())


def test_renest_gives_the_tree_back(spark):
    def filled(node):
        zero = {"line": 0, "col": 0}
        out = {k: v for k, v in node.items() if k != "children"}
        out.setdefault("range", {"start": zero, "end": zero})
        if "children" in node:
            out["children"] = [filled(c) for c in node["children"]]
        return out

    nodes = json_trees.json_nodes(parsed(spark, CLASS, leaf("only", 'quote " \\ \n é')))
    pieces = renest.json_fragments(nodes, KEYS).orderBy("file_path", "node_id").collect()
    whole = {f: "".join(p.fragment for p in pieces if p.file_path == f) for f in "01"}
    assert json.loads(whole["0"]) == filled(CLASS)
    assert json.loads(whole["1"])["text"] == 'quote " \\ \n é'


def test_renested_documents_are_whole(spark, tmp_path):
    """A document a turn, also where turns repeat their keys."""
    from treeloom.plans import queries

    said = ["a b\nc", "a b\nc", "", 'quote " é', "one\n\ntwo three"]
    rows = [(1, 1, said[0]), (1, 1, said[1]), (None, 2, said[2]), (2, 1, said[3]), (2, 1, said[4])]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.renest_json(spark, str(tmp_path)).collect()
    trees = [json.loads(r.json) for r in found]
    spelled = lambda t: "\n".join(" ".join(w["text"] for w in line["children"]) for line in t["children"]) if "children" in t else t["text"]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted(((r.conv_id, r.turn, spelled(t)) for r, t in zip(found, trees)), key=key) == sorted(rows, key=key)


def test_line_nodes_become_rows_before_they_have_fields(spark):
    texts = ["", None, "a", "a b", "\n", " ", "é ü\n\n x  y\nz\n"]
    df = spark.createDataFrame([("r", str(i), t) for i, t in enumerate(texts)], "repo string, file_path string, content string")
    made = line_trees.line_nodes(df)
    # Only a word and its place are built for each node before it is a row.
    assert "posexplode(concat(" in made._jdf.queryExecution().optimizedPlan().toString()
    want = set()
    for i, text in enumerate(texts):
        held = text.split("\n") if text else []
        end = (max(len(held), 1), len(held[-1]) if held else 0)
        want.add((str(i), 1, None, 1, 0, 0, "document", None, "" if not held else None, 1, 0, *end, 0, len(text or ""), not held))
        at, node = 0, 2
        for n, line in enumerate(held):
            own, col, words = node, 0, line.split(" ")
            want.add((str(i), own, 1, 2, n, 0, "line", "document", None, n + 1, 0, n + 1, len(line), at, at + len(line), False))
            for j, w in enumerate(words):
                closes = 0 if j < len(words) - 1 else 1 if n < len(held) - 1 else 2
                want.add((str(i), own + 1 + j, own, 3, j, closes, "token", "line", w, n + 1, col, n + 1, col + len(w), at + col, at + col + len(w), True))
                col += len(w) + 1
            at, node = at + len(line) + 1, own + 1 + len(words)
    names = ["file_path", "node_id", "parent_id", "depth", "ordinal", "closes", "kind", "parent_kind", "text", "start_line", "start_col", "end_line", "end_col", "start_off", "end_off", "is_leaf"]
    rows = [tuple(r) for r in made.select(*names).collect()]
    assert len(rows) == len(want) and set(rows) == want
