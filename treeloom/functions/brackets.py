"""JSON texts as trees: which piece encloses which.

Texts are cut into pieces (``json_text``), a run of texts at a time; pieces are nested by their
sorts, and a node reads its fields from the pieces that hold them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .json_text import ARRAY, END_ARRAY, END_OBJECT, FALSE, KEYS, NULL, OBJECT, SCALAR, Cut, runs
from .nesting import NEST_TYPE, _nodes, _parents

NUMBER = {name: i + 1 for i, name in enumerate(KEYS)}
# Where a node's fields stand among its pieces.
POINTS = ["start_line", "start_col", "end_line", "end_col", "start", "end"]
SLOTS = ["type", "kind", "text", "fieldName", "isNamed", *POINTS]

_PLACE = ["parent", "depth", "ordinal", "closes", "is_leaf"]
_STRINGS = ["kind", "parent_kind", "field_name", "text"]
_PLACES = ["start_line", "start_col", "end_line", "end_col", "start_off", "end_off"]
NODE_TYPE = T.StructType(
    [
        T.StructField("node_id", T.IntegerType()),
        *[T.StructField(f, NEST_TYPE.elementType[f].dataType) for f in _PLACE],
        T.StructField("kind", T.StringType()),
        T.StructField("parent_kind", T.StringType()),
        T.StructField("is_named", T.BooleanType()),
        T.StructField("field_name", T.StringType()),
        T.StructField("text", T.StringType()),
        *[T.StructField(f, T.IntegerType()) for f in _PLACES],
    ]
)
ROOT_FIELDS = [
    T.StructField("valid", T.BooleanType()),  # one value and nothing else
    T.StructField("object", T.BooleanType()),  # that is an object
    T.StructField("error", T.BooleanType()),  # with an error
    T.StructField("kind", T.BooleanType()),  # with a type or kind
]
ROOT_TYPE = T.StructType(ROOT_FIELDS)
TREE_TYPE = T.StructType([ROOT_FIELDS[0], T.StructField("nodes", T.ArrayType(NODE_TYPE))])
SIZES = T.StructType([T.StructField("nodes", T.LongType()), T.StructField("max_depth", T.IntegerType())])

_WHOLE = re.compile(r"[+-]?[0-9]+\Z", re.A)
_DECIMAL = re.compile(r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[fFdD]?\Z", re.A)
_HEXADECIMAL = re.compile(r"([+-]?0[xX](?:[0-9a-fA-F]+\.?|[0-9a-fA-F]*\.[0-9a-fA-F]+)[pP][+-]?[0-9]+)[fFdD]?\Z", re.A)
_TRIMMED = "".join(map(chr, [*range(0x21), *range(0x7F, 0xA0), 0x1680, *range(0x2000, 0x2007), *range(0x2008, 0x200B), 0x2028, 0x2029, 0x205F, 0x3000]))


def whole(said: str) -> int | None:
    """A position as a whole number, as a cast to one or else to a number reads it; None if it is
    none."""
    plain = said.strip(_TRIMMED)
    if _WHOLE.match(plain) and -(2**31) <= int(plain) < 2**31:
        return int(plain)
    plain = said.strip(_TRIMMED[:0x21])
    decimal, hexadecimal = _DECIMAL.match(plain), _HEXADECIMAL.match(plain)
    try:
        value = float(decimal[1]) if decimal else float.fromhex(hexadecimal[1]) if hexadecimal else None
    except OverflowError:
        return None
    if value is None or not -(2**31) - 1 < value < 2**31:
        return None
    return int(value)


def _whole_numbers(said: pa.Array) -> pa.Array:
    plain = pc.match_substring_regex(said, r"\A-?[0-9]{1,9}\z")
    quick = pc.if_else(plain, said, pa.scalar(None, said.type)).cast(pa.int32())
    odd = np.flatnonzero(pc.fill_null(pc.invert(plain), False).to_numpy(zero_copy_only=False))
    if not len(odd):
        return quick
    mask = np.zeros(len(said), bool)
    mask[odd] = True
    read: dict[str, int | None] = {}
    values = [read[x] if x in read else read.setdefault(x, whole(x)) for x in said.take(pa.array(odd)).to_pylist()]
    return pc.replace_with_mask(quick, pa.array(mask), pa.array(values, pa.int32()))


class Pieces:
    """The pieces of a run of texts, row after row, and what encloses each."""

    def __init__(self, cut: Cut):
        self.cut, self.rows, self.row, self.starts = cut, cut.rows, cut.row, cut.starts
        self.sort, self.key = cut.sort, cut.key
        self.opens, ends = (self.sort == OBJECT) | (self.sort == ARRAY), (self.sort == END_OBJECT) | (self.sort == END_ARRAY)
        step = self.opens.astype(np.int64) - ends
        total = np.cumsum(step)
        level = total - np.r_[0, total][self.starts[self.row]] if len(step) else total
        # A piece lies one level below what encloses it; an end is seen as inside of what it ends.
        self.level = level + np.where(self.opens, 0, np.where(ends, 2, 1))
        self.up = _parents(self.level, self.row, self.opens) if len(level) else level
        self.valid = self._valid(level, ends)

    def _valid(self, level: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n, up = len(level), self.up
        first = np.zeros(n, bool)
        first[self.starts[:-1][np.diff(self.starts) > 0]] = True
        inside = np.where(up >= 0, self.sort[np.maximum(up, 0)], SCALAR)
        comma, keyed = self.cut.comma, self.cut.keyed
        # The first piece of all, or of what encloses it, has no comma before it; the others have.
        leads = first | (up == np.arange(n) - 1) & (up >= 0)
        last = np.ones(n, bool)
        last[:-1] = self.row[1:] != self.row[:-1]
        good = (level >= 0) & ((level == 0) == last) & (first | (up >= 0))
        good &= np.where(ends, inside == self.sort - (END_OBJECT - OBJECT), (comma != leads) & (keyed == (inside == OBJECT)))
        bad = np.bincount(self.row[~good], minlength=self.rows) > 0 if n else np.zeros(self.rows, bool)
        return ~bad & ~self.cut.broken & (np.diff(self.starts) > 0)

    def downwards(self, chosen: np.ndarray):
        """The places in ``chosen`` (ascending), a level at a time."""
        order = chosen[np.argsort(self.level[chosen], kind="stable")]
        levels = self.level[order]
        yield from np.split(order, np.flatnonzero(np.diff(levels)) + 1) if len(order) else ()


def _rows(texts: Iterator[pa.Array], of: Callable[[Pieces], pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        for data, bounds in runs(column):
            yield of(Pieces(Cut(data, bounds)))


def _root(p: Pieces) -> pa.Array:
    n = len(p.sort)
    over = np.where(p.up >= 0, p.up, n)
    filled = np.diff(p.starts) > 0
    first = np.where(filled, p.starts[:-1], n)
    is_object = p.valid & (np.append(p.sort, 0)[first] == OBJECT)
    scalar = np.isin(p.sort, (SCALAR, FALSE))

    def says(*names: str) -> np.ndarray:
        said = scalar & np.isin(p.key, [NUMBER[x] for x in names]) & (over == (first[p.row] if n else 0))
        return is_object & (np.bincount(p.row[said], minlength=p.rows) > 0)

    flags = [p.valid, is_object, says("error"), says("type", "kind")]
    return pa.StructArray.from_arrays([pa.array(f, pa.bool_()) for f in flags], names=ROOT_TYPE.names)


def _tree(p: Pieces, named_only: bool) -> pa.Array:
    n, up, key = len(p.sort), p.up, p.key
    over = np.where(up >= 0, up, n)  # n: a piece that is nothing
    beyond = np.append(over, n)[over]
    # Unnamed objects are none with all below them, but for roots.
    unnamed = np.zeros(n + 1, bool)
    if named_only:
        unnamed[over[(key == NUMBER["isNamed"]) & (p.sort == FALSE)]] = True
    good = np.zeros(n + 1, bool)
    sorts, keys = np.append(p.sort, 0), np.append(key, 0)
    sound = p.valid[p.row] if n else np.zeros(0, bool)
    for here in p.downwards(np.flatnonzero(p.opens & sound)):
        root, listed = over[here] == n, p.sort[here] == ARRAY
        held = good[over[here]]
        tree = np.where(listed, held & (key[here] == NUMBER["children"]), held & (sorts[over[here]] == ARRAY))
        good[here] = np.where(root, ~listed, tree & ~(unnamed[here] & ~listed))
    at = np.flatnonzero(good[:n] & (p.sort == OBJECT))
    # Fields: those of a node, of its range, and of the ends of its range.
    node = np.zeros(n + 1, bool)
    node[at] = True
    index = np.full(n + 1, -1)
    index[at] = np.arange(len(at))
    ranges = np.append((p.sort == OBJECT) & (key == NUMBER["range"]) & node[over], False)
    points = np.append((p.sort == OBJECT) & ((key == NUMBER["start"]) | (key == NUMBER["end"])) & ranges[over], False)
    any_scalar = (p.sort == SCALAR) | (p.sort == FALSE) | (p.sort == NULL)
    scalar = any_scalar & (p.sort != NULL)
    # The spelling of each field, or -1. The last of equal keys counts.
    slots = {name: np.full(len(at), -1) for name in SLOTS}

    def put(which: np.ndarray, owner: np.ndarray, slot: str) -> None:
        slots[slot][index[owner[which]]] = p.cut.at[which]

    of_node, of_range, of_point = (np.flatnonzero(x) for x in (scalar & node[over], any_scalar & ranges[over], any_scalar & points[over]))
    for name in ("type", "kind", "text", "fieldName", "isNamed"):
        put(of_node[key[of_node] == NUMBER[name]], over, name)
    above = np.append(over, n)[beyond]
    for name in ("start", "end"):
        put(of_range[key[of_range] == NUMBER[name]], beyond, name)
        of_end = of_point[keys[over[of_point]] == NUMBER[name]]
        for what in ("line", "col"):
            put(of_end[key[of_end] == NUMBER[what]], above, f"{name}_{what}")
    row = p.row[at]
    counts = np.bincount(row, minlength=p.rows)
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    level = (p.level[at] + 1) // 2
    nothing = np.zeros(len(at), np.int64)
    placed = _nodes(level, row, starts, np.ones(len(at), bool), nothing, np.zeros(len(at), bool)).values
    leaf = placed.field("is_leaf").to_numpy(zero_copy_only=False)
    kind = p.cut.said(np.where(slots["type"] >= 0, slots["type"], slots["kind"]))
    parent = pc.add(placed.field("parent"), pa.array((starts[row] - 1).astype(np.int32)))
    fields = {
        "node_id": pa.array((np.arange(len(at)) - starts[row] + 1).astype(np.int32)),
        **{f: placed.field(f) for f in _PLACE},
        "kind": kind,
        "parent_kind": kind.take(parent),
        "is_named": pc.equal(pc.index_in(p.cut.said(slots["isNamed"]), value_set=pa.array(["false", "true"], kind.type)), 1),
        "field_name": p.cut.said(slots["fieldName"]),
        "text": p.cut.said(np.where(leaf, slots["text"], -1)),
        **{f: _whole_numbers(p.cut.said(slots[s])) for f, s in zip(_PLACES, POINTS)},
    }
    structs = pa.StructArray.from_arrays([fields[f] for f in NODE_TYPE.names], names=NODE_TYPE.names)
    nodes = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), structs)
    return pa.StructArray.from_arrays([pa.array(p.valid), nodes], names=TREE_TYPE.names)


@F.arrow_udf(returnType=ROOT_TYPE)
def root_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Whether a text is JSON, and what its root says of itself."""
    yield from _rows(texts, _root)


@F.arrow_udf(returnType=TREE_TYPE)
def tree_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Whether a text is JSON, and the nodes of its tree in preorder: the root object and the
    objects in a node's array of children."""
    yield from _rows(texts, lambda p: _tree(p, False))


@F.arrow_udf(returnType=TREE_TYPE)
def named_tree_of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The same without unnamed nodes and all below them."""
    yield from _rows(texts, lambda p: _tree(p, True))


@F.arrow_udf(returnType=SIZES)
def object_sizes(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Nodes and depth of the plain-object walk: objects and arrays are nodes; an object with an
    array of ``children`` is followed there alone, else below every key but ``parent``; an array
    below a key, or in an array that is a node, stands for its items."""
    yield from _rows(texts, _sizes)


def _sizes(p: Pieces) -> pa.Array:
    n = len(p.sort)
    over = np.where(p.up >= 0, p.up, n)
    sort, key = np.append(p.sort, SCALAR), np.append(p.key, 0)
    opens = np.flatnonzero(p.opens & (p.valid[p.row] if n else np.zeros(0, bool)))
    # The array of children an object is followed to; the last of several.
    lists = opens[(sort[opens] == ARRAY) & (key[opens] == NUMBER["children"]) & (sort[over[opens]] == OBJECT)]
    followed = np.full(n + 1, -1)
    followed[over[lists]] = lists
    stands, seen, depth = np.zeros(n + 1, bool), np.zeros(n + 1, bool), np.zeros(n + 1, np.int64)
    seen[n] = True
    for here in p.downwards(opens):
        above = over[here]
        inside_object = sort[above] == OBJECT
        stands[here] = (sort[here] == ARRAY) & (inside_object | (sort[above] == ARRAY) & ~stands[above])
        open_ = np.where(followed[above] >= 0, followed[above] == here, key[here] != NUMBER["parent"])
        seen[here] = seen[above] & (~inside_object | open_)
        depth[here] = depth[above] + ~stands[here]
    counted = opens[seen[opens] & ~stands[opens]]
    most = np.zeros(p.rows, np.int64)
    np.maximum.at(most, p.row[counted], depth[counted])
    nodes = np.bincount(p.row[counted], minlength=p.rows) if p.rows else most
    return pa.StructArray.from_arrays([pa.array(nodes, pa.int64()), pa.array(most.astype(np.int32))], names=SIZES.names)
