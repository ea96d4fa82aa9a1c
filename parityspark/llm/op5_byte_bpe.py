"""Byte-level BPE encoding and decoding with a sentencepiece model made from a rank file.

The ranked byte strings become the pieces of a sentencepiece BPE model: every byte is written as one character
(U+0100 + byte), a piece scores minus its rank, and normalisation is the identity. Merging the best-scored pair,
leftmost first, is then merging the lowest rank, so each pre-token gets the ids of the rank file. Nothing is trained.

Null text counts as empty: no ids, no bytes. Repeated rows are encoded each for itself; extra columns are not read.
"""

from __future__ import annotations

import base64
import struct

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_rows, utf8

FIRST = 0x100  # character of byte 0
LONGEST_KEPT = 64  # longer pre-tokens are encoded anew each time, so that the memo stays small


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        n, low = n >> 7, n & 0x7F
        out.append(low | (0x80 if n else 0))
        if not n:
            return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value & 0xFFFFFFFFFFFFFFFF)


def _block(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _real(field: int, value: float) -> bytes:
    return _varint(field << 3 | 5) + struct.pack("<f", value)


def load_ranks(path: str) -> list[bytes]:
    """Byte strings of a rank file, in rank order."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    by_rank = sorted(ranks, key=ranks.get)
    if [ranks[x] for x in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    return by_rank


def to_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_SHIFT)


_SHIFT = {b: FIRST + b for b in range(256)}


def serialise(by_rank: list[bytes]) -> bytes:
    """The model file: field numbers and enum values are those of sentencepiece's public model format."""
    pieces = [_block(1, _block(1, to_chars(x).encode()) + _real(2, -float(i)) + _number(3, 1)) for i, x in enumerate(by_rank)]
    pieces.append(_block(1, _block(1, b"<unk>") + _real(2, 0.0) + _number(3, 2)))
    n = len(by_rank)
    trainer = _number(3, 2) + _number(4, n + 1) + _number(40, n) + _number(41, -1) + _number(42, -1) + _number(43, -1)
    normaliser = _block(1, b"identity") + _block(2, b"") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(2, trainer) + _block(3, normaliser)


class Codec:
    """Encoder and decoder of one vocabulary and one pre-token pattern."""

    def __init__(self, by_rank: list[bytes], pattern: str):
        self.bytes_of = by_rank
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(by_rank))
        self.kept = Memo(self._encode_one, 200_000)

    def _encode_one(self, token: str) -> list[int]:
        return self.model.encode(to_chars(token.encode()))

    def encode(self, text: str) -> list[int]:
        kept, ids = self.kept, []
        for token in self.split(text):
            ids += kept[token] if len(token) <= LONGEST_KEPT else self._encode_one(token)
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _maker(spark, path: str, pattern: str):
    """The rank file is read once, on the driver, and reaches the tasks as one broadcast of its own size."""
    ranks = spark.sparkContext.broadcast(load_ranks(path))
    return lambda: Codec(ranks.value, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every text."""
    codec_of = _maker(docs.sparkSession, path, pattern)

    def make():
        codec = codec_of()
        return lambda rows: {
            "doc_id": rows.column("doc_id"), "ids": [codec.encode(t.decode()) if t else [] for t in utf8(rows, "text")],
        }

    return map_rows(docs.select("doc_id", "text"), _with_key(docs, "ids array<int>"), make)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, decoded binary) of rows (doc_id, ids); null ids count as none."""
    codec_of = _maker(encoded.sparkSession, path, pattern)

    def make():
        codec = codec_of()
        return lambda rows: {"doc_id": rows.column("doc_id"), "decoded": [codec.decode(x or ()) for x in rows.column("ids").to_pylist()]}

    return map_rows(encoded.select("doc_id", "ids"), _with_key(encoded, "decoded binary"), make)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary): both directions in one pass, the second from the ids of the first."""
    codec_of = _maker(docs.sparkSession, path, pattern)

    def make():
        codec = codec_of()

        def step(rows: pa.RecordBatch) -> dict:
            ids = [codec.encode(t.decode()) if t else [] for t in utf8(rows, "text")]
            return {"doc_id": rows.column("doc_id"), "ids": ids, "decoded": [codec.decode(x) for x in ids]}

        return step

    return map_rows(docs.select("doc_id", "text"), _with_key(docs, "ids array<int>, decoded binary"), make)


def _with_key(df: DataFrame, rest: str) -> str:
    return f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {rest}"


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of rows (doc_id, ids, decoded)."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
