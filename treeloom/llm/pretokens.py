"""Token ids of whole texts, each distinct piece of text encoded once per Python worker.

A byte-pair encoder works inside one pre-token at a time. Texts are cut before single blanks
and line feeds, where a pre-token must end, then each distinct chunk into pre-tokens, and the
vocabulary's model encodes each distinct pre-token. Texts with runs of white space, with
characters whose class or lower case differs between Unicode versions, or with a special
token's string are given whole to the library. Both ways give the library's own ids.
"""

from __future__ import annotations

import os
import re
import sys
import types
from array import array

# Letters, numbers and all characters whose class is settled: ASCII, Latin, Cyrillic, general
# punctuation, kana, Han, Hangul.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įĲ-ňŊ-žЀ-ҁҊ-ԓぁ-ゖァ-ヺ一-龥가-힣"
NUMBERS = "0-9²³¹¼-¾"
SETTLED = "\t\n\r\x20-\x7e\xa1-\xac\xae-įĲ-ňŊ-žЀ-ҁҊ-ԓ‐-‧‰-⁞€、。ぁ-ゖァ-ヺ一-龥가-힣"
BLANK = " \t\n\r"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
# The pre-token patterns of the two vocabularies, over settled characters.
BYTE_PATTERN = f"{ENDINGS}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANK}{LETTERS}{NUMBERS}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
WORD_PATTERN = f"{ENDINGS}|[{LETTERS}]+|[{NUMBERS}]|[^{BLANK}{LETTERS}{NUMBERS}]+"
SPECIAL_START = "<|"
# A worker keeps this many encoded chunks and pre-tokens; what it meets later is encoded again.
REMEMBERED = 450_000
# The id that ends a document.
END = 2


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(others)}


class Remembered(dict):
    """Values by key, worked out when first asked for."""

    def __init__(self, work):
        super().__init__()
        self.work = work

    def __missing__(self, key):
        value = self.work(key)
        if len(self) < REMEMBERED:
            self[key] = value
        return value


class Encoder:
    """Ids as little-endian unsigned 32-bit integers.

    ``lower``: the vocabulary lower-cases and drops white space; otherwise a blank belongs to
    the word after it.
    """

    def __init__(self, path: str, lower: bool):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.lower = lower
        self.unsettled = re.compile(f"[^{SETTLED}]").search
        self.runs = re.compile(f"[{BLANK}]{{2}}").search
        self.find = re.compile(WORD_PATTERN if lower else BYTE_PATTERN).findall
        self.letters = byte_letters()
        self.tokens = Remembered(self._token)
        self.chunks = Remembered(self._chunk)

    def whole(self, texts: list[str]) -> list[bytes]:
        """The library's ids of each text."""
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def encode(self, text: str | None) -> bytes:
        """The ids of one text; a missing text is empty."""
        if not text:
            return b""
        if SPECIAL_START in text or self.unsettled(text):
            return self.whole([text])[0]
        if self.lower:
            pieces = text.lower().split()
        elif self.runs(text):
            return self.whole([text])[0]
        else:
            # A chunk begins with its blank, which is left out, or with its line feed; the
            # first chunk has neither and is marked by a character no settled text holds.
            pieces = ("\0" + text).replace("\n", " \n").split(" ")
        return b"".join(map(self.chunks.__getitem__, pieces))

    def _chunk(self, chunk: str) -> bytes:
        if not self.lower:
            chunk = chunk[1:] if chunk[:1] == "\0" else chunk if chunk[:1] == "\n" else " " + chunk
        return b"".join(map(self.tokens.__getitem__, self.find(chunk)))

    def _token(self, token: str) -> bytes:
        spelled = token.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()


def _kept(name: str, lower: bool) -> Encoder:
    """One encoder for each vocabulary and Python worker, across the worker's tasks."""
    home = sys.modules.setdefault("_encoders_of_worker", types.ModuleType("_encoders_of_worker"))
    kept = vars(home).setdefault("kept", {})
    if name not in kept:
        kept[name] = Encoder(vocabulary_path(name), lower)
    return kept[name]


def byte_encoder(name: str = "byte_bpe_50k.json") -> Encoder:
    return _kept(name, lower=False)


def word_encoder(name: str = "word_bpe_49k.json") -> Encoder:
    return _kept(name, lower=True)
