"""Positions inside one row's arrays: the one place that needs Python.

A running total along an array has no linear-time built-in, and doing it with windows
would shuffle every token of the corpus. These helpers see only small integer arrays,
work on many rows at a time, and keep the tree builders free of shuffles.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
# Values of an Arrow batch looked at together. What a worker holds beside its batch follows this
# number, unless one row has more.
TOGETHER = 1 << 18

NEST_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("at", T.IntegerType()),  # index of the token, 0-based
            T.StructField("parent", T.IntegerType()),  # node number of the parent, 1-based
            T.StructField("depth", T.IntegerType()),  # root = 1
            T.StructField("ordinal", T.IntegerType()),  # place among its siblings, 0-based
            T.StructField("closes", T.IntegerType()),  # enclosing nodes that end with this one
            T.StructField("is_leaf", T.BooleanType()),
            T.StructField("is_open", T.BooleanType()),  # never closed
        ]
    )
)


def _in_runs(nest: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """``nest`` given a batch's rows in runs of about ``TOGETHER`` values of its list columns."""

    @wraps(nest)
    def run(*columns: pa.Array) -> pa.Array:
        sizes = sum(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        upto, begin, parts = np.r_[0, np.cumsum(sizes)], 0, []
        most = TOGETHER * len(columns)
        while begin < len(sizes):
            end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + most, "right")) - 1)
            parts.append(nest(*[c.slice(begin, end - begin) for c in columns]))
            begin = end
        return parts[0] if len(parts) == 1 else pa.concat_arrays(parts) if parts else nest(*columns)

    return run


def _split(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row starts of a list column; a missing row counts as empty."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _parents(level: np.ndarray, row: np.ndarray, holds: np.ndarray) -> np.ndarray:
    """For each node, the last earlier node of its row one level up that may hold children."""
    n = len(level)
    holders = np.flatnonzero(holds)
    if len(holders) == 0:
        return np.full(n, -1, np.int64)
    # One sortable number per (level, place); the last holder before a node is of its row, or
    # its row has none.
    held = level[holders]
    order = np.argsort(held.astype(np.int16) if abs(held).max() < 1 << 15 else held, kind="stable")
    keys = held[order] * n + holders[order]
    hit = np.searchsorted(keys, (level - 1) * n + np.arange(n)) - 1
    found = holders[order][np.maximum(hit, 0)]
    ok = (level > 1) & (hit >= 0) & (level[found] == level - 1) & (row[found] == row)
    return np.where(ok, found, -1)


def _nodes(level, row, starts, holds, at, is_open) -> pa.Array:
    """Assemble the per-node structs for nodes given in preorder, row by row."""
    n = len(level)
    parent = _parents(level, row, holds)
    following = np.ones(n, np.int64)
    if n:
        same_row = row[1:] == row[:-1]
        following[:-1] = np.where(same_row, level[1:], 1)
    last = np.ones(n, bool)
    if n:
        last[:-1] = row[1:] != row[:-1]
    is_leaf = last | (following <= level)
    closes = np.where(is_leaf, level - following, 0)
    # Siblings in order: number them within (row, parent).
    by_parent = np.lexsort((np.arange(n), parent, row))
    new = np.ones(n, bool)
    if n:
        new[1:] = (parent[by_parent][1:] != parent[by_parent][:-1]) | (row[by_parent][1:] != row[by_parent][:-1])
    run_start = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.empty(0, np.int64)
    ordinal = np.empty(n, np.int64)
    ordinal[by_parent] = np.arange(n) - run_start
    number = parent - starts[row] + 1 if n else parent
    fields = [
        pa.array(at.astype(np.int32)),
        pa.array(number.astype(np.int32), mask=parent < 0),
        pa.array(level.astype(np.int32)),
        pa.array(ordinal.astype(np.int32)),
        pa.array(closes.astype(np.int32)),
        pa.array(is_leaf),
        pa.array(is_open),
    ]
    structs = pa.StructArray.from_arrays(fields, names=NEST_TYPE.elementType.names)
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), structs)


@F.arrow_udf(returnType=NEST_TYPE)
@_in_runs
def nest_by_steps(steps: pa.Array) -> pa.Array:
    """Nodes from tag steps: 1 opens, 0 is a childless element, -1 closes the innermost one."""
    values, token_starts = _split(steps)
    token_row = np.repeat(np.arange(len(steps), dtype=np.int64), np.diff(token_starts))
    total = np.cumsum(values)
    total = total - np.r_[0, total][token_starts[token_row]] if len(values) else total
    # An offset by row starts each row's running minimum anew, forwards and backwards.
    apart = token_row << 40
    lowest = np.minimum.accumulate(total - apart) + apart
    # A close with nothing open is ignored, so the total never rests below zero.
    after = total - np.minimum(lowest, 0)
    # Lowest level reached by any later token.
    onwards = np.minimum.accumulate((after + apart)[::-1])[::-1] - apart
    rest = np.full(len(values), np.iinfo(np.int64).max)
    rest[:-1] = np.where(token_row[1:] == token_row[:-1], onwards[1:], rest[:-1])
    picked = np.flatnonzero(values >= 0)
    holds = values[picked] == 1
    level = after[picked] + np.where(holds, 0, 1)
    row = token_row[picked]
    counts = np.bincount(row, minlength=len(steps)) if len(steps) else np.empty(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    at = picked - token_starts[row]
    return _nodes(level, row, starts, holds, at, holds & (rest[picked] >= level))


@F.arrow_udf(returnType=NEST_TYPE)
@_in_runs
def nest_by_levels(levels: pa.Array) -> pa.Array:
    """Nodes from indent levels (root = 1), one per line; a node's parent is the nearest
    earlier line indented less."""
    values, starts = _split(levels)
    level = values.copy()
    jumps = np.flatnonzero(np.diff(values, prepend=0) > 1)
    for index in np.unique(np.searchsorted(starts, jumps, side="right") - 1):
        begin, end = starts[index], starts[index + 1]
        level[begin:end] = _closed_up(values[begin:end])
    row = np.repeat(np.arange(len(levels), dtype=np.int64), np.diff(starts))
    return _nodes(level, row, starts, np.ones(len(level), bool), np.arange(len(level)) - starts[row], np.zeros(len(level), bool))


def _closed_up(values: np.ndarray) -> np.ndarray:
    """Levels without gaps, for the rare dump whose indent grows by more than one step."""
    stack: list[int] = []
    out = np.empty(len(values), np.int64)
    for i, value in enumerate(values):
        while stack and stack[-1] >= value:
            stack.pop()
        stack.append(value)
        out[i] = len(stack)
    return out


@F.arrow_udf(returnType=T.ArrayType(T.IntegerType()))
@_in_runs
def starts_of(lengths: pa.Array) -> pa.Array:
    """Start of each piece when pieces of these lengths are laid end to end."""
    values, starts = _split(lengths)
    before = np.concatenate([[0], np.cumsum(values)])
    row = np.repeat(np.arange(len(lengths), dtype=np.int64), np.diff(starts))
    placed = before[:-1] - before[starts[row]]
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(placed.astype(np.int32)))


MARKED_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("at", T.IntegerType()),  # index of a marked node, 0-based
            T.StructField("up", T.IntegerType()),  # index of the nearest marked node around it
            T.StructField("level", T.IntegerType()),  # marked nodes around it, itself included
            T.StructField("first", T.BooleanType()),  # first of the marked nodes directly below the same one
            T.StructField("closes", T.IntegerType()),  # marked nodes that end before the next one begins
            T.StructField("name", T.IntegerType()),  # index of the child that names it
            T.StructField("name_end", T.IntegerType()),  # index of the last node below that child
        ]
    )
)


def subtree_ends(level: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each node, given in preorder, the last node below it, or itself."""
    n = len(level)
    parent, end = _parents(level, row, np.ones(n, bool)), np.arange(n)
    order = np.argsort(-level, kind="stable")
    for here in np.split(order, np.flatnonzero(np.diff(level[order])) + 1) if n else ():
        here = here[parent[here] >= 0]
        np.maximum.at(end, parent[here], end[here])
    return end


@F.arrow_udf(returnType=MARKED_TYPE)
@_in_runs
def nest_marked(levels: pa.Array, marks: pa.Array) -> pa.Array:
    """The marked nodes of trees in preorder, nested among themselves. ``levels`` has every
    node's depth; a mark is 1 for a marked node, plus 2 for a node that may name its parent, or
    4 for one that does so before those."""
    level, starts = _split(levels)
    mark = _split(marks)[0]
    n = len(level)
    row = np.repeat(np.arange(len(levels), dtype=np.int64), np.diff(starts))
    parent = _parents(level, row, np.ones(n, bool)) if n else level
    marked = np.append(mark & 1 > 0, False)
    up, deep = np.full(n + 1, -1), np.zeros(n + 1, np.int64)
    order = np.argsort(level, kind="stable")
    for here in np.split(order, np.flatnonzero(np.diff(level[order])) + 1) if n else ():
        above = parent[here]
        up[here] = np.where(marked[above], above, up[above])
        deep[here] = deep[above] + marked[here]
    name = np.full(n + 1, -1)
    for rank in (2, 4):
        # The first such child is written last.
        named = np.flatnonzero((mark & rank > 0) & (parent >= 0))[::-1]
        name[parent[named]] = named
    end = subtree_ends(level, row)
    at = np.flatnonzero(marked[:n])
    depth, line, local = deep[at], row[at], np.arange(n) - (starts[row] if n else 0)
    last = np.ones(len(at), bool)
    last[:-1] = line[1:] != line[:-1]
    following = np.append(depth[1:], 1) if len(at) else depth
    closes = np.where(last, depth, depth - following + 1)
    # The first below a marked node comes right after it, and the first of a row has none.
    first = np.ones(len(at), bool)
    first[1:] = (line[1:] != line[:-1]) | (up[at][1:] == at[:-1])
    place = lambda x: pa.array(np.where(x >= 0, local[np.maximum(x, 0)] if n else x, 0).astype(np.int32), mask=x < 0)
    named = name[at]
    fields = [
        place(at),
        place(up[at]),
        pa.array(depth.astype(np.int32)),
        pa.array(first),
        pa.array(closes.astype(np.int32)),
        place(named),
        place(np.where(named >= 0, end[np.maximum(named, 0)] if n else named, -1)),
    ]
    structs = pa.StructArray.from_arrays(fields, names=MARKED_TYPE.elementType.names)
    counts = np.bincount(line, minlength=len(levels)) if len(levels) else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), structs)


DIFFERENCES = T.ArrayType(
    T.StructType(
        [
            T.StructField("path", T.ArrayType(T.IntegerType())),  # places among siblings, from the root down
            T.StructField("left", T.IntegerType()),  # index of the node on either side
            T.StructField("right", T.IntegerType()),
            T.StructField("left_nodes", T.IntegerType()),  # nodes of its subtree
            T.StructField("right_nodes", T.IntegerType()),
        ]
    )
)


class _Subtrees:
    """Trees of a batch in preorder, with a hash of every subtree, made bottom-up."""

    def __init__(self, levels: pa.Array, hashes: pa.Array):
        level, self.starts = _split(levels)
        n = len(level)
        self.own = hashes.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        row = np.repeat(np.arange(len(levels), dtype=np.int64), np.diff(self.starts))
        self.parent = _parents(level, row, np.ones(n, bool)) if n else level
        self.ends = subtree_ends(level, row)
        self.whole = self.own.copy()
        order = np.argsort(-level, kind="stable")
        place = np.zeros(n, np.uint64)
        # Siblings in order: the place of each among those of its parent.
        sibling = np.lexsort((np.arange(n), self.parent, row))
        if n:
            new = np.r_[True, (self.parent[sibling][1:] != self.parent[sibling][:-1]) | (row[sibling][1:] != row[sibling][:-1])]
            run = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            place[sibling] = (np.arange(n) - run).astype(np.uint64)
        for here in np.split(order, np.flatnonzero(np.diff(level[order])) + 1) if n else ():
            mixed = (self.whole[here] ^ (self.whole[here] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + place[here]
            self.whole[here] = mixed ^ (mixed >> np.uint64(32))
            below = here[self.parent[here] >= 0]
            np.add.at(self.whole, self.parent[below], self.whole[below] * np.uint64(0x9E3779B97F4A7C15))

    def children(self, at: int) -> list[int]:
        out, child = [], at + 1
        while child <= self.ends[at]:
            out.append(child)
            child = int(self.ends[child]) + 1
        return out

    def roots(self, row: int) -> list[int]:
        out, child = [], int(self.starts[row])
        while child < self.starts[row + 1]:
            out.append(child)
            child = int(self.ends[child]) + 1
        return out


def _descend(left: _Subtrees, right: _Subtrees, row: int):
    """The topmost differences of one tree, in preorder. Equal subtrees are not entered."""
    pairs = [((), left.roots(row), right.roots(row))]
    while pairs:
        path, ours, theirs = pairs.pop()
        below = []
        for i in range(max(len(ours), len(theirs))):
            a, b = (side[i] if i < len(side) else None for side in (ours, theirs))
            if a is not None and b is not None:
                if left.whole[a] == right.whole[b]:
                    continue
                if left.own[a] == right.own[b]:
                    below.append(((*path, i), left.children(a), right.children(b)))
                    continue
            sizes = [None if at is None else int(side.ends[at]) - at + 1 for side, at in ((left, a), (right, b))]
            at = [None if at is None else at - int(side.starts[row]) for side, at in ((left, a), (right, b))]
            yield list((*path, i)), *at, *sizes
        pairs.extend(reversed(below))


@F.arrow_udf(returnType=DIFFERENCES)
@_in_runs
def tree_differences(left_levels: pa.Array, left_hashes: pa.Array, right_levels: pa.Array, right_hashes: pa.Array) -> pa.Array:
    """Where two trees differ, from every node's depth and own hash in preorder. Nodes are paired
    by their place among their siblings; a pair whose own hashes are equal is entered only where
    the hashes of its subtrees differ, another is a difference as a whole."""
    left, right = _Subtrees(left_levels, left_hashes), _Subtrees(right_levels, right_hashes)
    found = [[dict(zip(DIFFERENCES.elementType.names, d)) for d in _descend(left, right, row)] for row in range(len(left_levels))]
    kind = pa.list_(pa.struct([("path", pa.list_(pa.int32())), *((n, pa.int32()) for n in DIFFERENCES.elementType.names[1:])]))
    return pa.array(found, kind)
