"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical after deleting the blanks `[\\x20\\x09-\\x0D]`. A first pass over the texts leaves one
narrow row a document: normalised length and hash of the normalised prefix. Rows whose length nobody shares leave first,
then rows whose (length, prefix) nobody shares. What survives is kept as a bitmap of BITS bits over hashed keys, whose size
does not depend on the input. A second pass reads the full content of texts whose key is in the bitmap; a key let in by
chance costs one more hash and changes nothing, since groups are formed by (length, full hash). Texts never move.

Of equal texts the row with the most code points in its original text stays, then the one with the smallest doc_id (null last),
then the first of equal rows in scan order. Groups of more than one HOT-th of all rows, at most HOT of them, are joined back apart, so that
no task receives one group's rows.

Null text counts as empty, and all texts without a character but blanks are equal. Long texts are read whole, one by one. Repeated rows are rows of
their own, exactly one of a group stays. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, drop
from .common import filter_rows, map_rows, mix, utf8

BLANKS = b" \t\n\x0b\x0c\r"
PREFIX = 64  # bytes of normalised text that the second step looks at
BITS = 1 << 24
HOT = 1000


def normalised(text: bytes | None) -> bytes:
    return (text or b"").translate(None, BLANKS)


def _key(text: bytes) -> tuple[int, int]:
    return len(text), xxhash.xxh3_64_intdigest(text[:PREFIX]) - (1 << 63)


def _place(*parts: np.ndarray) -> np.ndarray:
    """Bit of each key; several parts are mixed one after the other."""
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = mix(out ^ p.astype(np.int64).view(np.uint64))
    return (out % np.uint64(BITS)).astype(np.int64)


def bitmap(keys: DataFrame) -> np.ndarray:
    """Bitmap of BITS bits of all rows of ``keys`` (whole numbers), gathered as at most BITS / 64 words."""
    names = keys.columns

    def make():
        def step(batch):
            at = _place(*(batch.column(c).to_numpy(zero_copy_only=False) for c in names))
            return {"word": at >> 6, "bits": (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)}
        return step

    words = map_rows(keys, "word long, bits long", make).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS >> 6, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def _inside(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits.view(np.uint64)[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def shared_keys(docs: DataFrame) -> np.ndarray:
    """Bitmap of the (length, prefix hash) that at least two texts have."""

    def make():
        def step(batch):
            keys = [_key(normalised(t)) for t in utf8(batch, "text")]
            return {"len": [k[0] for k in keys], "prefix": [k[1] for k in keys]}
        return step

    narrow = cut(map_rows(docs.select("text"), "len long, prefix long", make), "lengths")
    lengths = docs.sparkSession.sparkContext.broadcast(bitmap(narrow.groupBy("len").agg(F.count("*").alias("n")).filter("n > 1").select("len")))
    same_length = filter_rows(narrow, lambda: lambda batch: _inside(lengths.value, _place(batch.column("len").to_numpy())))
    out = bitmap(same_length.groupBy("len", "prefix").agg(F.count("*").alias("n")).filter("n > 1").select("len", "prefix"))
    drop(narrow)
    return out


def hashed(docs: DataFrame, shared: np.ndarray, all_digests: bool = False) -> DataFrame:
    """(doc_id, points, len, survives, sha256) of every row; the hash is null where no other text can be equal, unless all are asked for."""
    known = docs.sparkSession.sparkContext.broadcast(shared)

    def make():
        def step(batch):
            texts = [normalised(t) for t in utf8(batch, "text")]
            lens, prefixes = zip(*map(_key, texts), strict=True)
            survives = _inside(known.value, _place(np.array(lens, np.int64), np.array(prefixes, np.int64)))
            digests = [hashlib.sha256(t).digest() if s or all_digests else None for t, s in zip(texts, survives.tolist(), strict=True)]
            return {"doc_id": batch.column("doc_id"), "points": batch.column("points"), "len": lens, "survives": pa.array(survives), "sha256": digests}
        return step

    source = docs.select("doc_id", "text", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("points"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, points long, len long, survives boolean, sha256 binary"
    return map_rows(source, schema, make)


def _merit(row: Column) -> Column:
    """Least for the row that stays."""
    return F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"), row.alias("row"))


def dedup(docs: DataFrame, all_digests: bool = False, hot: int = HOT) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, sha256) of every row of ``docs``."""
    found = hashed(docs, shared_keys(docs), all_digests).withColumn("row", F.monotonically_increasing_id())
    rows = cut(found, "hashed")
    alone = lambda df: df.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha256")
    several = rows.filter("survives")
    groups = cut(several.groupBy("len", "sha256").agg(F.count("*").alias("n"), F.min(_merit(F.col("row"))).alias("best")), "groups")
    least = rows.count() // hot
    large = cut(groups.filter(F.col("n") > least), "large")
    judged = lambda df: df.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("best.row") == F.col("row")).alias("kept"), "sha256")
    in_large = several.join(large, ["len", "sha256"])
    in_small = several.join(large, ["len", "sha256"], "left_anti").join(groups.filter(F.col("n") <= least), ["len", "sha256"])
    return alone(rows.filter("not survives")).union(judged(in_large)).union(judged(in_small))
