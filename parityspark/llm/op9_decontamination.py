"""Benchmark decontamination with one Aho-Corasick automaton over the normalised benchmark.

Text is lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters; a benchmark item gives windows
of ten consecutive words, or one window if it is shorter. All windows, written as `` word word ... ``, go into one
automaton, and each document is scanned once in the same form; hits are mapped back to words and to character offsets
of the original text.

Null or wordless texts have no words and no hits. Benchmark items without words give no window. A null item_id is
written as the empty string. Repeated rows are judged each for itself; extra columns are not read.

The windows are broadcast only up to BLOCK_CHARS characters. A larger benchmark is cut into blocks of that size by
window hash; every block scans all documents, and the hits of a document are put together by row.
"""

from __future__ import annotations

import math
import re

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .common import filter_rows, map_rows, utf8

WINDOW = 10
BLOCK_CHARS = 2_000_000
_KEEP = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
TABLE = bytes(b if b in _KEEP else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window string, items array<string>): each distinct window with the items that hold it."""

    def make():
        def step(rows):
            out, ids = [], []
            for item, text in zip(rows.column("item_id").to_pylist(), utf8(rows, "text")):
                w = words(text)
                found = {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else ()
                out += [x.decode() for x in sorted(found)]
                ids += [item or ""] * len(found)
            return {"window": out, "item": ids}

        return step

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return map_rows(items, "window string, item string", make).groupBy("window").agg(F.collect_set("item").alias("items"))


class Scanner:
    """The automaton of some windows. Texts are scanned as bytes, one character each, so offsets are cheap."""

    def __init__(self, rows: list[tuple[str, list[str]]]):
        self.lengths, self.items = [], []
        self.machine = ahocorasick.Automaton()
        for window, items in rows:
            self.machine.add_word(f" {window} ".encode().decode("latin-1"), len(self.items))
            self.lengths.append(window.count(" ") + 1)
            self.items.append(items)
        if rows:
            self.machine.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, list[int], list[str]]:
        """Number of words, the sorted positions of hit words, and the items found."""
        w = words(text)
        if not w or not self.items:
            return len(w), [], []
        flat = b" ".join([b"", *w, b""])
        found = list(self.machine.iter(flat.decode("latin-1")))
        if not found:
            return len(w), [], []
        # The k-th blank of the flat text stands behind k words.
        blanks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
        ends = np.searchsorted(blanks, [e for e, _ in found])
        change = np.zeros(len(w) + 1, np.int64)
        np.add.at(change, ends - [self.lengths[i] for _, i in found], 1)
        np.add.at(change, ends, -1)
        return len(w), np.flatnonzero(np.cumsum(change) > 0).tolist(), sorted({x for _, i in found for x in self.items[i]})


def spans(text: bytes, hit: list[int]) -> list[dict]:
    """Runs of hit words as (start, end) in characters of the original text."""
    at = [m.span() for m in _WORD.finditer(text)]
    runs: list[list[int]] = []
    for k in hit:
        if runs and runs[-1][1] == k:
            runs[-1][1] = k + 1
        else:
            runs.append([k, k + 1])
    out = []
    for first, last in runs:
        start = len(text[: at[first][0]].decode())
        out.append({"start": start, "end": start + len(text[at[first][0] : at[last - 1][1]].decode())})
    return out


def _blocks(benchmark: DataFrame, size: int, block_chars: int) -> list[list]:
    """Windows per block, one block at a time on the driver; their total size decides how many there are."""
    table = cut(windows(benchmark, size), "windows")
    weight = F.length("window") + F.size("items") * 8
    total = table.agg(F.sum(weight)).first()[0] or 0
    n = max(1, math.ceil(total / block_chars))
    for k in range(n):
        part = table.filter(F.pmod(F.xxhash64("window"), F.lit(n)) == k) if n > 1 else table
        yield n, [(r.window, list(r.items)) for r in part.collect()]


FOUND = "n_words long, hits array<int>, items array<string>, spans array<struct<start:int,end:int>>"


def _scan(docs: DataFrame, key: str, rows: list, hits_only: bool = False) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(rows)

    def make():
        scanner = Scanner(shared.value)

        def step(batch):
            texts, keys = utf8(batch, "text"), batch.column(key).to_pylist()
            found = [(k, t, *scanner.scan(t)) for k, t in zip(keys, texts)]
            if hits_only:
                found = [x for x in found if x[3]]
            return {
                key: [x[0] for x in found], "n_words": [x[2] for x in found], "hits": [x[3] for x in found], "items": [x[4] for x in found],
                "spans": [spans(x[1], x[3]) if x[3] else [] for x in found],
            }

        return step

    return map_rows(docs.select(key, "text"), f"{key} {docs.schema[key].dataType.simpleString()}, {FOUND}", make)


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_words, hits, items, spans) of every document: hit word positions, found items, original offsets."""
    parts, stable = [], None
    for n, rows in _blocks(benchmark, size, block_chars):
        if n == 1:
            return _scan(docs, "doc_id", rows)
        if stable is None:
            stable = cut(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "rows")
        parts.append(cut(_scan(stable, "row", rows, hits_only=True), "hits"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    merged = every.groupBy("row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    counted = _scan(stable, "row", []).select("row", "n_words").join(stable.select("row", "doc_id", "text"), "row")
    joined = counted.join(merged, "row", "left")

    def make():
        def step(batch):
            hits = [x or [] for x in batch.column("hits").to_pylist()]
            return {
                "doc_id": batch.column("doc_id"), "n_words": batch.column("n_words"), "hits": hits, "items": [x or [] for x in batch.column("items").to_pylist()],
                "spans": [spans(t, h) if h else [] for t, h in zip(utf8(batch, "text"), hits)],
            }

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(joined.select("doc_id", "n_words", "text", "hits", "items"), f"doc_id {kind}, {FOUND}", make)


def digests(found: DataFrame) -> DataFrame:
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents without any hit, all columns untouched; each block of windows takes out what it hits."""
    for _, rows in _blocks(benchmark, size, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def make(shared=shared):
            scanner = Scanner(shared.value)
            return lambda batch: np.array([not scanner.scan(t)[1] for t in utf8(batch, "text")], bool)

        docs = filter_rows(docs, make)
    return docs
