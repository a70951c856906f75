"""Token counts from pre-token frequencies, without any ids.

A byte-pair encoder never merges across pre-tokens, so a text has as many tokens as its
pre-tokens have pieces. Every text is cut once, into the frequencies of its distinct pre-tokens,
which are written to the shared folder. The corpus' distinct pre-tokens are counted from there by
one aggregation and each is encoded once. Texts then meet these counts pre-token by pre-token:

* the most frequent pre-tokens, at most ``HEAD`` of them, are broadcast. A pre-token is known by
  itself or, where it has more than ``WIDE`` bytes, by its MD5, so the bound in rows is one in bytes;
* the others go through a shuffled join of (row, pre-token, frequency). None of them is
  frequent, so no key of that join is hot.

Texts are cut before blanks and line feeds, where a pre-token must end, and each distinct chunk a
worker meets is cut into pre-tokens once; texts with runs of white space or characters whose
class depends on the Unicode version are cut by the library.

Null texts count as empty: no bytes, no tokens. Repeated rows stay, each with its own result.
An empty table gives no rows. Special tokens' strings inside a text count as one token each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pretokens import Encoder, Remembered, byte_encoder
from .shared import least_count, stored, table

HEAD = 300_000
# Longer pre-tokens, in bytes, are known by their MD5.
WIDE = 64
LIMIT = 1024
# Fixed value: the special token of the vocabulary.
SPECIAL = "<|endoftext|>"


class Cutter:
    """The pre-tokens of texts and how often each occurs."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.library = encoder.library.pre_tokenizer.pre_tokenize_str
        self.chunks = Remembered(lambda chunk: encoder.find(chunk[1:] if chunk[:1] == "\0" else chunk if chunk[:1] == "\n" else " " + chunk))

    def _part(self, text: str) -> Counter:
        if self.encoder.unsettled(text):
            return Counter(text[a:b] for _, (a, b) in self.library(text))
        if self.encoder.runs(text):
            return Counter(self.encoder.find(text))
        found = Counter()
        # Chunks as in Encoder.encode: the first one is marked, the others have lost their blank.
        for chunk, n in Counter(("\0" + text).replace("\n", " \n").split(" ")).items():
            for token in self.chunks[chunk]:
                found[token] = found.get(token, 0) + n
        return found

    def frequencies(self, text: str | None) -> tuple[int, Counter]:
        """The number of special tokens, and of each pre-token between them."""
        parts = text.split(SPECIAL) if text else []
        found = self._part(parts[0]) if parts else Counter()
        for part in parts[1:]:
            found.update(self._part(part))
        return max(len(parts) - 1, 0), found


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter = Cutter(byte_encoder())
    for batch in batches:
        specials, tokens, times, sizes = [], [], [], [0]
        for text in batch.column("text").to_pylist():
            special, found = cutter.frequencies(text)
            specials.append(special)
            tokens.extend(found)
            times.extend(found.values())
            sizes.append(len(tokens))
        starts = pa.array(sizes, pa.int32())
        lists = [pa.ListArray.from_arrays(starts, pa.array(tokens, pa.string())), pa.ListArray.from_arrays(starts, pa.array(times, pa.int32()))]
        own = [batch.column(c) for c in ("row_", "doc_id", "n_bytes")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(specials, pa.int64()), *lists], ["row_", "doc_id", "n_bytes", "specials", "tokens", "times"])


def frequencies(docs: DataFrame) -> DataFrame:
    """A stored row for each row of ``docs``: row_ (its number), doc_id, n_bytes, specials, and
    tokens and times: its distinct pre-tokens and how often each occurs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes")
    rows = docs.select(F.monotonically_increasing_id().alias("row_"), "doc_id", size, "text")
    schema = f"row_ bigint, doc_id {kind}, n_bytes bigint, specials bigint, tokens array<string>, times array<int>"
    return stored(rows.mapInArrow(_cut, schema), "frequencies", compression="zstd")


def _key(token: Column) -> Column:
    """No more than ``WIDE`` bytes that tell pre-tokens apart: none mixes NUL with digits or letters."""
    return F.when(F.octet_length(token) > WIDE, F.concat(F.lit("\0" * (WIDE - 32)), F.md5(token.cast("binary")))).otherwise(token)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = byte_encoder()._token
    for batch in batches:
        pieces = pa.array([len(encode(t)) // 4 for t in batch.column("token").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("n"), pieces], ["token", "n", "pieces"])


def piece_table(rows: DataFrame) -> DataFrame:
    """key, n (texts that hold it), pieces: each distinct pre-token encoded once."""
    counted = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    encoded = counted.mapInArrow(_count, "token string, n bigint, pieces bigint")
    return encoded.select(_key(F.col("token")).alias("key"), "n", "pieces")


def token_counts(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of ``docs`` (doc_id, text)."""
    rows = frequencies(docs.select("doc_id", "text"))
    pieces = stored(piece_table(rows), "pieces")
    least = least_count(pieces, head)
    each = rows.select("row_", F.inline(F.arrays_zip("tokens", "times")).alias("token", "times"))
    met = each.select("row_", _key(F.col("token")).alias("key"), "times").join(
        F.broadcast(pieces.filter(F.col("n") >= least).select("key", "pieces")), "key", "left"
    )
    part = lambda found: found.groupBy("row_").agg(F.sum(F.col("times") * F.col("pieces")).alias("found"))
    sums = part(met.filter(F.col("pieces").isNotNull()))
    others = pieces.filter(F.col("n") < least).select("key", "pieces")
    if not others.isEmpty():
        rest = met.filter(F.col("pieces").isNull()).select("row_", "key", "times").join(others, "key")
        sums = sums.unionByName(part(rest)).groupBy("row_").agg(F.sum("found").alias("found"))
    n_tokens = (F.coalesce("found", F.lit(0)) + F.col("specials")).cast("bigint").alias("n_tokens")
    return rows.select("row_", "doc_id", "n_bytes", "specials").join(sums, "row_", "left").select("doc_id", "n_bytes", n_tokens)


def op10_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
