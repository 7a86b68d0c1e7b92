"""Byte-level BPE encoding by tree concatenation, and decoding.

A text is cut where the pre-tokeniser cuts it.  A longer piece that it leaves whole is encoded as a tree:
its halves are encoded on their own, then a window around the join is encoded again and grows until its
first token is the left half's and its last token the right half's own.  A BPE token sequence is the
encoding of its text exactly if each neighbouring pair is, so the outer tokens and the window then are the
encoding of the whole.

Defined results: a null or empty text has no tokens and decodes to an empty text; the strings of special
tokens are found in texts as the tokenizers library does; rows are encoded one by one; other columns are
ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

#: Fixed value: the pattern of byte-level pre-tokenisation.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 256
#: What a worker keeps; beyond it, it starts afresh.
MAX_PIECES = 250_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next free one from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in set(prints) else chr(next(free)) for b in range(256)]


class _Pieces(dict):
    """Pre-token to its ids as little-endian 32-bit integers."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.codec.encode_piece(piece.encode().decode("latin-1").translate(self.codec.letters)), "<u4").tobytes()
        if len(piece) <= 40:
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, file: str):
        from tokenizers import Tokenizer

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(byte_letters()))
        bytes_of = {letter: b for b, letter in self.letters.items()}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        top = max([*spec["model"]["vocab"].values(), *special.values()])
        self.token = [""] * (top + 1)
        self.bytes = [b""] * (top + 1)
        for token, i in spec["model"]["vocab"].items():
            self.token[i] = token
            self.bytes[i] = bytes(bytes_of[c] for c in token)
        for token, i in special.items():
            self.bytes[i] = token.encode()
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in special.items()}
        self.cut_special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.cut = regex.compile(PATTERN).findall
        self.pieces = _Pieces(self)

    def _leaf(self, letters: str) -> list[int]:
        return [t.id for t in self.model.tokenize(letters)]

    def encode_piece(self, letters: str) -> list[int]:
        """Ids of one pre-token, given as byte letters."""
        if len(letters) <= LEAF:
            return self._leaf(letters)
        level = [self._leaf(letters[i : i + LEAF]) for i in range(0, len(letters), LEAF)]
        while len(level) > 1:
            level = [self._join(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        k = 2
        while True:
            a, b = left[-k:], right[:k]
            window = self._leaf("".join([self.token[i] for i in (*a, *b)]))
            agrees_left = len(a) == len(left) or window[0] == a[0]
            agrees_right = len(b) == len(right) or window[-1] == b[-1]
            if agrees_left and agrees_right:
                return left[: len(left) - len(a)] + window + right[len(b) :]
            k *= 2

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        pieces = self.pieces
        if len(pieces) > MAX_PIECES:
            pieces.clear()
        if self.cut_special is None or not self.cut_special.search(text):
            return b"".join(map(pieces.__getitem__, self.cut(text)))
        out = []
        for part in self.cut_special.split(text):
            out.extend([self.special[part]] if part in self.special else map(pieces.__getitem__, self.cut(part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(file: str) -> Codec:
    return Codec(file)


def _round_trip(file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(file)
        for batch in batches:
            texts = T.string_column(batch.column(1))
            for part in T.slices(batch.column(1)):
                ids = [c.encode(x.as_py()) for x in texts.slice(part.first, part.n)]
                back = [c.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.n), pa.array(ids, pa.binary()), pa.array(back, pa.string())], names=["doc_id", "ids", "decoded"])

    return run


def bpe_round_trip(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, ids`` (little-endian 32-bit integers) and ``decoded``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_round_trip(file), "doc_id long, ids binary, decoded string")
