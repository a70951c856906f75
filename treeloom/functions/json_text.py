"""JSON texts cut into pieces, a run of texts at a time.

Bytes are told apart by arrays: quotes that no backslash escapes pair up into strings, what stands
outside of them is brackets, commas, colons, blanks and words. A piece is a value or a closing
bracket, with the comma and key before it; its code (``brackets``) says what it is, and what it
spells is read only where a field of a node is wanted. Nothing calls itself, so neither long
strings nor many escapes exhaust a stack.

Texts are looked at about ``TOGETHER`` bytes at once, whatever the size of an Arrow batch, so what
a worker holds beside the batch has a bound unless one text is larger.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of texts cut at once.
TOGETHER = 1 << 20
KEYS = ["type", "kind", "text", "fieldName", "isNamed", "children", "range", "start", "end", "line", "col", "error", "parent"]
# Sorts of a piece.
SCALAR, OBJECT, ARRAY, NULL, FALSE, END_OBJECT, END_ARRAY, BAD = range(8)

_NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_WORD = rf"\A(?:{_NUMBER}|true|false|null)\z"
# Sorts of a byte, and of what begins there: a word, a blank, a string, a bracket, a colon, a comma.
_OTHER, _BLANK, _QUOTE, _OPEN_OBJECT, _OPEN_ARRAY, _CLOSE_OBJECT, _CLOSE_ARRAY, _COLON, _COMMA, _NONE = range(10)
_SORTS = np.zeros(256, np.uint8)
for _sort, _bytes in ((_BLANK, b" \t\n\r"), (_QUOTE, b'"'), (_OPEN_OBJECT, b"{"), (_OPEN_ARRAY, b"["), (_CLOSE_OBJECT, b"}"), (_CLOSE_ARRAY, b"]"), (_COLON, b":"), (_COMMA, b",")):
    _SORTS[list(_bytes)] = _sort
_PIECE_SORTS = np.full(10, BAD, np.int64)
_PIECE_SORTS[[_OTHER, _QUOTE, _OPEN_OBJECT, _OPEN_ARRAY, _CLOSE_OBJECT, _CLOSE_ARRAY]] = [SCALAR, SCALAR, OBJECT, ARRAY, END_OBJECT, END_ARRAY]


def _members(chars: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(chars)] = True
    return found


_BEGINS_VALUE = _members(bytes([_OTHER, _QUOTE, _OPEN_OBJECT, _OPEN_ARRAY]))
_ESCAPES, _HEX = _members(b'"\\/bfnrtu'), _members(b"0123456789abcdefABCDEF")


def runs(texts: pa.Array, together: int = TOGETHER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of a string column, some rows at a time, and where each row begins, with the end
    of the last. A missing text has no bytes."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    upto = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + together, "right")) - 1)
        yield every[upto[begin] : upto[end]], upto[begin : end + 1] - upto[begin]
        begin = end


def _unescaped(literal: str) -> str:
    # Half a surrogate pair is no character.
    return json.loads(f'"{literal}"').encode("utf-8", "replace").decode()


class Cut:
    """The pieces of a run of texts, row after row: ``row``, ``sort``, ``key`` (the number of its
    key among ``KEYS`` from 1, 0 for another or none), ``keyed`` and ``comma``, and ``starts``, the
    first piece of each row. ``broken`` tells rows that hold what is no piece."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.rows, n = len(bounds) - 1, len(data)
        self.broken = np.zeros(self.rows, bool)
        begins = bounds[:-1][np.diff(bounds) > 0]
        sorts = _SORTS[data]
        opens, closes, slashes = self._strings(data, bounds, begins, sorts)
        inside = np.zeros(n + 1, np.int8)
        inside[opens] += 1
        inside[closes + 1] -= 1
        inside = np.cumsum(inside[:n], dtype=np.int8).view(bool)
        self._characters(data, bounds, inside, slashes)
        # Words: runs of anything else outside of strings.
        other = (sorts == _OTHER) & ~inside
        first, last = other.copy(), other.copy()
        first[1:] &= ~other[:-1]
        last[:-1] &= ~other[1:]
        edge = begins[begins > 0]
        first[begins] = other[begins]
        last[edge - 1] = other[edge - 1]
        marks = (sorts > _QUOTE) & ~inside
        marks |= first
        marks[opens] = True
        at = np.flatnonzero(marks)
        kinds = sorts[at]
        row = np.repeat(np.arange(self.rows), np.diff(np.searchsorted(at, bounds)))
        self._spell(data, opens, closes, slashes, inside, other, first, last, at, kinds)
        self._pieces(kinds, row)

    def _fail(self, places: np.ndarray, bounds: np.ndarray) -> None:
        self.broken[np.searchsorted(bounds, places, "right") - 1] = True

    def _strings(self, data, bounds, begins, sorts):
        """Where strings open and close, and the backslashes that escape what follows."""
        quote = sorts == _QUOTE
        slashes = np.flatnonzero(data == 0x5C)
        if len(slashes):
            apart = np.r_[True, np.diff(slashes) != 1] | np.isin(slashes, begins)
            place = np.arange(len(slashes))
            slashes = slashes[(place - np.maximum.accumulate(np.where(apart, place, 0))) % 2 == 0]
            after = slashes + 1
            after = after[(after < len(data)) & ~np.isin(after, begins)]
            quote[after] = False
        quotes = np.flatnonzero(quote)
        per_row = np.diff(np.searchsorted(quotes, bounds))
        odd = per_row % 2 == 1
        self.broken |= odd
        quotes = np.delete(quotes, np.cumsum(per_row)[odd] - 1)
        return quotes[0::2], quotes[1::2], slashes

    def _characters(self, data, bounds, inside, slashes):
        """Bare control characters and what no backslash may come before."""
        control = np.flatnonzero((data < 0x20) & inside)
        self._fail(control, bounds)
        if len(slashes):
            padded = np.r_[data, np.zeros(6, np.uint8)]
            good = inside[slashes] & _ESCAPES[padded[slashes + 1]]
            long_ = padded[slashes + 1] == ord("u")
            for i in range(2, 6):
                good &= ~long_ | _HEX[padded[slashes + i]]
            self._fail(slashes[~good], bounds)

    def _spell(self, data, opens, closes, slashes, inside, other, first, last, at, kinds):
        """What each string (without its quotes) and word spells as written, in order."""
        inner = inside | other
        inner[opens] = inner[closes] = False
        length = np.zeros(len(at), np.int64)
        string, word = kinds == _QUOTE, kinds == _OTHER
        length[string] = closes - opens - 1
        length[word] = np.flatnonzero(last) - at[word] + 1
        spells = np.flatnonzero(string | word)
        ends = np.r_[0, np.cumsum(length[spells])]
        kind, size = (pa.large_string(), np.int64) if ends[-1] >= 2**31 else (pa.string(), np.int32)
        written = np.ascontiguousarray(data[inner])
        self.spelled = pa.Array.from_buffers(kind, len(spells), [None, pa.py_buffer(ends.astype(size)), pa.py_buffer(written)])
        self.spelling = np.full(len(at) + 1, -1)
        self.spelling[spells] = np.arange(len(spells))
        self.escaped = np.zeros(len(spells) + 1, bool)
        if len(slashes) and len(opens):
            of = np.searchsorted(opens, slashes, "right") - 1
            held = (of >= 0) & inside[slashes]
            self.escaped[self.spelling[np.flatnonzero(string)[of[held]]]] = True

    def _pieces(self, kinds, row):
        n = len(kinds)
        same = row[1:] == row[:-1]
        before, after = np.full(n, _NONE, np.uint8), np.full(n, _NONE, np.uint8)
        before[1:][same] = kinds[:-1][same]
        after[:-1][same] = kinds[1:][same]
        named = (kinds == _QUOTE) & (after == _COLON)
        begins = _BEGINS_VALUE[kinds] & ~named
        then = np.append(begins[1:], False)
        bad = (kinds == _COLON) & ((before != _QUOTE) | (after == _NONE) | ~then)
        bad |= (kinds == _COMMA) & ~_BEGINS_VALUE[after]
        # Values that are words.
        self.sort = _PIECE_SORTS[kinds]
        words = np.flatnonzero(kinds == _OTHER)
        said = self.spelled.take(pa.array(self.spelling[words]))
        fits = pc.match_substring_regex(said, _WORD).to_numpy(zero_copy_only=False)
        for sort, word in ((NULL, "null"), (FALSE, "false")):
            self.sort[words[pc.equal(said, word).to_numpy(zero_copy_only=False)]] = sort
        bad[words[~fits]] = True
        self.broken[row[bad]] = True
        kept = np.flatnonzero(begins | (kinds == _CLOSE_OBJECT) | (kinds == _CLOSE_ARRAY))
        self.row, self.sort = row[kept], self.sort[kept]
        self.keyed = (before[kept] == _COLON) & begins[kept]
        lead = np.where(self.keyed, before[np.maximum(kept - 2, 0)], before[kept])
        self.comma = (lead == _COMMA) & begins[kept]
        self.at = self.spelling[kept]
        # Keys.
        self.key = np.zeros(len(kept), np.int64)
        keyed = np.flatnonzero(self.keyed & ~self.broken[self.row])
        self.key[keyed] = self._key_numbers(self.spelling[kept[keyed] - 2])
        self.starts = np.r_[0, np.cumsum(np.bincount(self.row, minlength=self.rows))].astype(np.int64)

    def _key_numbers(self, at: np.ndarray) -> np.ndarray:
        found = pc.index_in(self.said(at), value_set=pa.array(KEYS, self.spelled.type))
        return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1

    def said(self, at: np.ndarray) -> pa.Array:
        """What the spellings ``at`` say, escapes read; null where it is negative."""
        at = at.astype(np.int64)
        said = self.spelled.take(pa.array(at, mask=at < 0))
        odd = np.flatnonzero((at >= 0) & self.escaped[at])
        if not len(odd):
            return said
        mask = np.zeros(len(at), bool)
        mask[odd] = True
        read = [_unescaped(x) for x in said.take(pa.array(odd)).to_pylist()]
        return pc.replace_with_mask(said, pa.array(mask), pa.array(read, said.type))
