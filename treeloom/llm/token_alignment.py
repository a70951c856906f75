"""Links between the tokens of two tokenizers, by token-byte incidence matrices.

Tokens of one text as a matrix: a row per token, a column per byte. Both tokenizers' matrices
are built by hand in CSR form, for many texts one below the other. Row by row (Gustavson's
method) the product A x B^T finds which tokens overlap, and in how many bytes. Offsets where tokens of
both end cut a text into groups; the product of the two token-group incidence matrices finds all
pairs of tokens that share a group. In a group of many links, equal ids share one row with
their number, so a long stretch without a common end costs its distinct ids, not its tokens.

Pre-tokens of one tokenizer and pieces of the other both begin at blanks and line feeds. A text
cut there falls into blocks that no token crosses, so its matrices are block-diagonal, and every
distinct block is multiplied once per Python worker; a text's links are the product of its block
counts with the blocks' links. Texts with runs of white space or characters whose class depends
on the Unicode version are one block.

Each text keeps its distinct id pairs and how often it holds them. Pairs are counted over the
corpus by one aggregation with map-side combining. Texts meet the counts pair by pair: the most
frequent pairs, at most ``HEAD``, by broadcast; the others through a shuffled join on keys none
of which is frequent. The highest count of each id is a table no larger than the vocabulary.

Null and empty texts, and texts that either tokenizer does not give back byte for byte, have no
tokens: zeros and an empty digest. Repeated rows stay and count as documents of their own. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pretokens import SETTLED, byte_letters, vocabulary_path
from .shared import least_count, stored, table

HEAD = 400_000
# Bytes of text aligned at once, blocks a worker keeps, links made at once, and links from which
# a group is collapsed.
TOGETHER = 1 << 20
REMEMBERED = 250_000
LINKS = 1 << 22
LARGE = 64
# One token of both vocabularies, with the blank before it.
LEAD = "x"
# Characters of blocks encoded in a row.
ROW = 20_000
BLANK = "▁"
BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")


# Matrices ----------------------------------------------------------------------------------


@dataclass
class Csr:
    """A sparse matrix by rows: row i has the columns ``columns[starts[i]:starts[i + 1]]``."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    @classmethod
    def of_lengths(cls, lengths: np.ndarray) -> Csr:
        """Rows that cover consecutive columns, each as many as its length."""
        starts = np.r_[0, np.cumsum(lengths)]
        return cls(starts, np.arange(starts[-1]), np.ones(starts[-1], np.int64))

    @classmethod
    def of_labels(cls, labels: np.ndarray, values: np.ndarray | None = None) -> Csr:
        """Rows of one entry each, in the column that is the row's label."""
        return cls(np.arange(len(labels) + 1), labels, np.ones(len(labels), np.int64) if values is None else values)

    def transposed(self, n_columns: int) -> Csr:
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        order = np.argsort(self.columns, kind="stable")
        starts = np.r_[0, np.cumsum(np.bincount(self.columns, minlength=n_columns))]
        return Csr(starts, rows[order], self.values[order])

    def row_blocks(self, other: Csr, most: int) -> Iterator[tuple[int, int]]:
        """Ranges of rows whose products with ``other`` have about ``most`` terms at most."""
        terms = np.r_[0, np.cumsum(np.diff(other.starts)[self.columns])][self.starts]
        begin, n = 0, len(self.starts) - 1
        while begin < n:
            end = max(begin + 1, int(np.searchsorted(terms, terms[begin] + most, "right")) - 1)
            yield begin, min(end, n)
            begin = min(end, n)

    def product(self, other: Csr, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows ``begin`` to ``end`` of self x other: row, column and value of every term. Each
        entry of a row brings in the row of ``other`` that its column names."""
        own = slice(self.starts[begin], self.starts[end])
        named, weight = self.columns[own], self.values[own]
        rows = np.repeat(np.arange(begin, end), np.diff(self.starts[begin : end + 1]))
        sizes = other.starts[named + 1] - other.starts[named]
        upto = np.cumsum(sizes)
        at = np.arange(upto[-1] if len(upto) else 0) + np.repeat(other.starts[named] - (upto - sizes), sizes)
        return np.repeat(rows, sizes), other.columns[at], np.repeat(weight, sizes) * other.values[at]


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys merged, in ascending order."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(keys) else values


# Tokens ------------------------------------------------------------------------------------


class ByteSide:
    """Ids of the byte-level vocabulary; special tokens' strings are plain text."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary_path(name))
        self.library.encode_special_tokens = True
        spelled = {letter: byte for byte, letter in byte_letters().items()}
        self.bytes = [b""] * self.library.get_vocab_size()
        for token, i in self.library.get_vocab().items():
            self.bytes[i] = bytes(spelled[ord(c)] for c in token)
        self.lengths = np.array([len(b) for b in self.bytes])
        # In this vocabulary ids are in the order of the merges.
        special = self.library.get_added_tokens_decoder()
        ranks = {token: i for i, token in enumerate(self.bytes) if i not in special}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with a blank before it."""
        return [e.ids for e in self.library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def settled(self, texts: list[str]) -> list[list[int]]:
        """The same of texts whose characters' classes are settled."""
        return [self.fast.encode_ordinary(" " + t) for t in texts]


class PieceSide:
    """Ids of the sentencepiece vocabulary, which adds the blank itself."""

    def __init__(self, name: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(name))
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        found = [BYTE.match(p) if self.model.is_byte(i) else None for i, p in enumerate(pieces)]
        self.bytes = [bytes([int(m[1], 16)]) if m else p.replace(BLANK, " ").encode() for m, p in zip(found, pieces)]
        self.lengths = np.array([len(b) for b in self.bytes])
        # Whether no piece goes across a blank or line feed.
        self.cuts = not any("\n" in p or BLANK in p[1:] and p.strip(BLANK) for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with a blank before it."""
        return self.model.encode(texts, num_threads=1)

    settled = encode


# Alignment ---------------------------------------------------------------------------------


def _incidence(group: np.ndarray, ids: np.ndarray, large: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, id and number of every row of a token-group incidence matrix: a row per token, or
    in large groups a row per distinct id."""
    big = large[group]
    if not big.any():
        return group, ids, np.ones(len(ids), np.int64)
    keys, n = np.unique(group[big] << 32 | ids[big], return_counts=True)
    return (
        np.r_[group[~big], keys >> 32],
        np.r_[ids[~big], keys & 0xFFFFFFFF],
        np.r_[np.ones(len(ids) - len(group[big]), np.int64), n],
    )


@dataclass
class Links:
    """What is known of each of several blocks or texts, in order: whether its tokens spell it,
    counts, and a matrix of its id pairs (a * 65536 + b) and how often each is linked."""

    spelled: np.ndarray
    counts: np.ndarray
    pairs: Csr
    said: list[str]

    @classmethod
    def none(cls) -> Links:
        empty = np.zeros(0, np.int64)
        return cls(np.zeros(0, bool), np.zeros((len(COUNTS), 0), np.int64), Csr(np.zeros(1, np.int64), empty, empty), [])

    def __len__(self) -> int:
        return len(self.spelled)

    def joined(self, other: Links) -> Links:
        mine, more = self.pairs, other.pairs
        starts = np.r_[mine.starts, more.starts[1:] + mine.starts[-1]]
        pairs = Csr(starts, np.r_[mine.columns, more.columns], np.r_[mine.values, more.values])
        return Links(np.r_[self.spelled, other.spelled], np.c_[self.counts, other.counts], pairs, self.said + other.said)

    def first(self, n: int) -> Links:
        end = self.pairs.starts[n]
        pairs = Csr(self.pairs.starts[: n + 1], self.pairs.columns[:end], self.pairs.values[:end])
        return Links(self.spelled[:n], self.counts[:, :n], pairs, self.said[:n])


COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_overlaps"]


def _rows_of(keys: np.ndarray, values: np.ndarray, rows: int) -> Csr:
    """Ascending keys of row * 2^32 + column."""
    return Csr(np.searchsorted(keys, np.arange(rows + 1) << 32), keys & 0xFFFFFFFF, values)


def _marked(block: str) -> bool:
    """Whether a block is a whole text."""
    return block[:1] == "\0"


def _rows(blocks: list[str]) -> list[str]:
    """Blocks one behind the other, in texts of about ``ROW`` characters."""
    upto = np.cumsum([len(x) for x in blocks])
    edges = np.unique(np.r_[0, np.searchsorted(upto, np.arange(0, upto[-1] if len(upto) else 0, ROW), "right"), len(blocks)])
    return ["".join(blocks[i:j]) for i, j in zip(edges, edges[1:])]


def align(a_side, b_side, blocks: list[str]) -> Links:
    """Links of each block: a word with a blank before it, or without one where the block begins
    with a line feed; whole texts come last, each marked by a leading NUL character. The others
    are encoded in long rows, each behind a token that belongs to none of them."""
    cut = [x if x[:1] == "\n" else " " + x for x in blocks if not _marked(x)]
    rows, whole = [LEAD + row for row in _rows(cut)], [x[1:] for x in blocks[len(cut) :]]
    ids_a, ids_b = ([*side.settled(rows), *side.encode(whole)] for side in (a_side, b_side))
    texts = [b" " + t.encode() for t in rows + whole]
    spells = lambda side, ids, text: b"".join(map(side.bytes.__getitem__, ids)) == text
    ok = np.array([spells(a_side, x, t) and spells(b_side, y, t) for x, y, t in zip(ids_a, ids_b, texts)], bool)
    if not ok[: len(rows)].all():
        raise ValueError("a vocabulary does not spell settled texts")
    for i in range(len(rows)):
        # The lead is one token of both.
        ids_a[i], ids_b[i] = ids_a[i][1:], ids_b[i][1:]
    fine = ok[len(rows) :]
    spelled = np.r_[np.ones(len(cut), bool), fine]
    a, b = (np.array(list(chain.from_iterable(x for x, good in zip(ids, ok) if good)), np.int64) for ids in (ids_a, ids_b))
    sizes = [len(x.encode()) for x in cut] + [len(x.encode()) + 1 if good else 0 for x, good in zip(whole, fine)]
    ends = np.cumsum(np.array(sizes, np.int64))
    bytes_a, bytes_b = Csr.of_lengths(a_side.lengths[a]), Csr.of_lengths(b_side.lengths[b])
    ends_a, ends_b = bytes_a.starts[1:], bytes_b.starts[1:]
    to_a, to_b = (np.searchsorted(e, ends, "right") for e in (ends_a, ends_b))
    n_a, n_b = (np.diff(np.r_[0, to]) for to in (to_a, to_b))
    # Blocks of both sides lie at the same offsets, since their bytes are the same.
    meets = np.searchsorted(ends_b, ends_a)
    cut_a = ends_b[meets] == ends_a if len(b) else np.zeros(0, bool)
    cut_b = np.zeros(len(b), bool)
    cut_b[meets[cut_a]] = True
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    groups = int(cut_a.sum())
    in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    to_group = np.r_[0, np.cumsum(cut_a)][to_a]
    upto = lambda amounts, ends: np.diff(np.r_[0, np.r_[0, np.cumsum(amounts)][ends]])
    # Overlaps: the product over bytes.
    over, by_byte = np.zeros(len(a), np.int64), bytes_b.transposed(int(ends_a[-1]) if len(a) else 0)
    for begin, end in bytes_a.row_blocks(by_byte, LINKS):
        rows, columns, _ = bytes_a.product(by_byte, begin, end)
        new = np.r_[True, (rows[1:] != rows[:-1]) | (columns[1:] != columns[:-1])]
        over += np.bincount(rows[new], minlength=len(a))
    # Links: the product over groups.
    large = in_a * in_b > LARGE
    rows_a, ids_a, times_a = _incidence(group_a, a, large)
    rows_b, ids_b, times_b = _incidence(group_b, b, large)
    side_a, side_b = Csr.of_labels(rows_a, times_a), Csr.of_labels(rows_b, times_b).transposed(groups)
    block_of = np.repeat(np.arange(len(blocks)), np.diff(np.r_[0, to_group]))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for begin, end in side_a.row_blocks(side_b, LINKS):
        rows, columns, values = side_a.product(side_b, begin, end)
        found.append(summed(block_of[rows_a[rows]] << 32 | ids_a[rows] << 16 | ids_b[columns], values))
    pairs = _rows_of(*summed(*map(np.concatenate, zip(*found))), len(blocks))
    counts = np.stack([n_a, n_b, np.diff(np.r_[0, to_group]), upto(in_a * in_b, to_group), upto(over, to_a)])
    # Groups written out: within a group the ids of A, then those of B.
    order = np.argsort(np.r_[group_a * 2, group_b * 2 + 1], kind="stable")
    codes = list(map(_NUMERALS.__getitem__, np.r_[a * 4 + cut_a, b * 4 + cut_b * 2][order].tolist()))
    places = np.r_[0, np.cumsum(n_a + n_b)].tolist()
    said = ["".join(codes[i:j])[:-1] for i, j in zip(places, places[1:])]
    return Links(spelled, counts, pairs, said)


class _Numerals(dict):
    """A number in decimal and the mark after it, by number * 4 + mark."""

    def __missing__(self, code: int) -> str:
        self[code] = f"{code >> 2}{',|;'[code & 3]}"
        return self[code]


_NUMERALS = _Numerals()


class Aligner:
    """Links of whole texts. The first ``REMEMBERED`` distinct blocks a worker meets are kept;
    later ones are multiplied anew for every slice of texts that holds them."""

    def __init__(self, a_name: str, b_name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a, self.b = ByteSide(a_name), PieceSide(b_name)
        self.unsettled = re.compile(f"[^{SETTLED}]").search
        self.runs = re.compile("[ \\t\\n\\r]{2}|\\A[ \\t\\n\\r]|[ \\t\\n\\r]\\Z").search
        self.kept, self.at = Links.none(), {}

    def odd(self, text: str) -> bool:
        """Whether a text is one block."""
        line = text.replace("\n", " ")
        if not self.b.cuts or line[0] == " " or line[-1] == " " or "  " in line:
            return True
        if text.isascii() and line.isprintable():
            return False
        return bool(self.unsettled(text) or self.runs(text))

    def cut(self, text: str | None) -> list[str]:
        if not text:
            return []
        return ["\0" + text] if self.odd(text) else text.replace("\n", " \n").split(" ")

    def links(self, texts: list[str | None]) -> Links:
        cuts = [self.cut(t) for t in texts]
        known, at = self.kept, self.at
        new = sorted(set(chain.from_iterable(cuts)).difference(at), key=_marked)
        if new:
            known = known.joined(align(self.a, self.b, new))
            at.update(zip(new, range(len(self.kept), len(known))))
        flat = np.fromiter(map(at.__getitem__, chain.from_iterable(cuts)), np.int64)
        sizes = np.array([len(c) for c in cuts], np.int64)
        ends = np.cumsum(sizes)
        total = lambda amounts: np.diff(np.r_[0, np.r_[0, np.cumsum(amounts)][ends]])
        spelled = total(~known.spelled[flat]) == 0
        counts = np.stack([total(row[flat]) * spelled for row in known.counts])
        said = [";".join(map(known.said.__getitem__, flat[i:j].tolist())) if ok else "" for i, j, ok in zip(ends - sizes, ends, spelled)]
        room = max(0, REMEMBERED - len(self.kept))
        for x in new[room:]:
            del at[x]
        self.kept = known.first(len(self.kept) + min(room, len(new)))
        # A text's links: its row of block counts times the blocks' rows of pairs.
        held = _rows_of(*summed(np.repeat(np.arange(len(texts)) << 32, sizes) | flat, np.ones(len(flat), np.int64)), len(texts))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for begin, end in held.row_blocks(known.pairs, LINKS):
            rows, pairs, times = held.product(known.pairs, begin, end)
            here = spelled[rows]
            found.append(summed(rows[here] << 32 | pairs[here], times[here]))
        pairs = _rows_of(*map(np.concatenate, zip(*found)), len(texts))
        return Links(spelled, counts, pairs, said)


def _aligner(a_name: str, b_name: str) -> Aligner:
    """One for each pair of vocabularies and Python worker."""
    home = sys.modules.setdefault("_aligners_of_worker", types.ModuleType("_aligners_of_worker"))
    kept = vars(home).setdefault("kept", {})
    if (a_name, b_name) not in kept:
        kept[a_name, b_name] = Aligner(a_name, b_name)
    return kept[a_name, b_name]


_MADE = ", ".join(f"{c} bigint" for c in COUNTS) + ", groups_sha256 string, pairs array<int>, times array<bigint>"


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``TOGETHER`` bytes."""
    begin, upto = 0, np.r_[0, np.cumsum(sizes)]
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + TOGETHER, "right")) - 1)
        yield begin, end
        begin = end


def _align(a_name: str, b_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(a_name, b_name)
        for batch in batches:
            text = batch.column("text")
            sizes = np.array([n or 0 for n in pa.compute.binary_length(text).to_pylist()], np.int64)
            for begin, end in _slices(sizes):
                got = aligner.links(text.slice(begin, end - begin).to_pylist())
                digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in got.said]
                starts = pa.array(got.pairs.starts, pa.int32())
                columns = [
                    *(batch.column(c).slice(begin, end - begin) for c in ("row_", "doc_id")),
                    *(pa.array(row, pa.int64()) for row in got.counts),
                    pa.array(digests, pa.string()),
                    pa.ListArray.from_arrays(starts, pa.array(got.pairs.columns.astype(np.uint32).view(np.int32))),
                    pa.ListArray.from_arrays(starts, pa.array(got.pairs.values)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row_", "doc_id", *COUNTS, "groups_sha256", "pairs", "times"])

    return run


def alignments(docs: DataFrame, a_name: str, b_name: str) -> DataFrame:
    """For each row of ``docs`` (doc_id, text), stored: row_ (its number), doc_id, its counts,
    and pairs and times: its distinct linked id pairs and how often it holds each."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row_"), "doc_id", "text")
    return stored(numbered.mapInArrow(_align(a_name, b_name), f"row_ bigint, doc_id {kind}, {_MADE}"), "aligned")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (whether none of its A id's has more), stored."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = stored(counts, "counts")
    a = F.shiftrightunsigned("pair", 16)
    # One row for each id of a vocabulary of fewer than 65,536.
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    met = counts.withColumn("a", a).join(F.broadcast(highest), "a")
    return stored(met.select("pair", "n", (F.col("n") == F.col("most")).cast("bigint").alias("best")), "pair-counts")


def linked(docs: DataFrame, a_name: str, b_name: str, head: int = HEAD) -> DataFrame:
    """``alignments`` of ``docs`` without pairs, and n_best and count_sum of every row."""
    aligned = alignments(docs, a_name, b_name)
    counts = pair_counts(aligned)
    least = least_count(counts, head)
    each = aligned.select("row_", F.inline(F.arrays_zip("pairs", "times")).alias("pair", "times"))
    frequent = counts.filter(F.col("n") >= least)
    met = each.join(F.broadcast(frequent), "pair", "left")
    part = lambda rows: rows.groupBy("row_").agg(
        F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    )
    sums = part(met.filter(F.col("n").isNotNull()))
    others = counts.filter(F.col("n") < least)
    if not others.isEmpty():
        rest = met.filter(F.col("n").isNull()).select("row_", "pair", "times").join(others, "pair")
        sums = sums.unionByName(part(rest)).groupBy("row_").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
    own = [c for c in aligned.columns if c not in ("row_", "pairs", "times")]
    return aligned.select("row_", *own).join(sums, "row_", "left").select(*own, zero("n_best"), zero("count_sum"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linked(docs, "byte_bpe_50k.json", "piece_bpe_32k.model")
