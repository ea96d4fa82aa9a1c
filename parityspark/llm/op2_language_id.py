"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased and everything between them becomes one blank; runs of one, two and three characters are hashed
into BUCKETS, at any number of languages. Each task counts buckets per language, the counts are summed by (language, bucket), and
the matrix of log probabilities is broadcast, at most BLOCK languages at a time: with more, the texts pass one block after the
other and carry their best language and the sum of the rest along. The n-grams of many texts form one sparse batch (bucket numbers
and where each text begins), whose rows of the matrix are gathered and added up per text; sums plus the prior give the posterior.

A posterior compares learned languages only, so ``keep`` also asks whether the text looks like its best language at all: its mean
log probability an n-gram must reach that language's floor, drawn by ``with_floors`` from all documents of that language.

A text that is null or has no letter is ``und`` with score 0; so is every text when nothing was learned. Texts of any length are read
whole, PIECE characters at a time. Rows without a doc_id or language are not learned from. Of equally likely languages the first by
name is taken. Repeated rows are judged each for itself, and weigh in learning as often as they occur; extra columns are not read.
Empty tables give empty results, and a model without languages when learned from.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .common import map_rows, remainder, utf8

BUCKETS = 1 << 16
BLOCK = 256  # languages a task holds at once: 64 MB
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
UNKNOWN = "und"
PIECE = 500_000  # characters hashed at once
PENDING = 2_000_000  # n-grams gathered before they are counted
GATHERED = 4_000_000  # cells of the matrix gathered at once
#: Floor of a language: this quantile of its own documents, and as far below it again as it lies below the median (at least LEAST_GAP).
LOWEST, LEAST_GAP, GRAIN = 0.001, 0.5, 100
SCATTER = 10.0  # allowed besides, over the root of the number of n-grams: about three deviations, neighbouring n-grams share characters


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: is it a letter, and its lower case."""
    letter, lower = np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            letter[c] = True
            low = chr(c).lower()
            lower[c] = ord(low[0])
    return letter, lower


def characters(text: bytes | None) -> np.ndarray:
    """Lower-case letters with one blank for whatever stands between, before and behind them; empty without letters."""
    letter, lower = _tables()
    codes = np.frombuffer((text or b"").decode().encode("utf-32-le"), np.uint32)
    is_letter = letter[codes]
    if not is_letter.any():
        return codes[:0]
    codes = np.concatenate([[32], np.where(is_letter, lower[codes], 32), [32]]).astype(np.uint32)
    return codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]


def ngrams(chars: np.ndarray, buckets: int):
    """Bucket numbers of all n-grams, piece by piece."""
    shift = np.uint32(32 - buckets.bit_length() + 1)
    for start in range(0, len(chars), PIECE):
        for n in ORDERS:
            part = chars[start : start + PIECE + n - 1]
            if len(part) < n:
                continue
            h = np.full(len(part) - n + 1, n, np.uint32)
            for k in range(n):
                h = (h ^ part[k : len(part) - n + 1 + k]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            yield ((h * np.uint32(0x85EBCA77)) >> shift).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    logp: np.ndarray  # languages x buckets
    floor: np.ndarray  # lowest mean log probability of a text of the language, without the allowance for its length

    def part(self, start: int) -> tuple[np.ndarray, np.ndarray]:
        """Prior and matrix (buckets x languages) of BLOCK languages."""
        return self.prior[start : start + BLOCK], np.ascontiguousarray(self.logp[start : start + BLOCK].T)


def batch_sums(texts: list[bytes | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sum of its n-grams' rows of the matrix, and their number."""
    total, n = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
    most = max(1, GATHERED // table.shape[1])
    held, owner, size = [], [], 0

    def settle():
        starts = np.cumsum([0] + [len(x) for x in held[:-1]])
        np.add.at(total, owner, np.add.reduceat(table[np.concatenate(held)], starts, axis=0, dtype=np.float64))
        held.clear()
        owner.clear()

    for i, text in enumerate(texts):
        for ids in ngrams(characters(text), len(table)):
            n[i] += len(ids)
            for start in range(0, len(ids), most):
                held.append(ids[start : start + most])
                owner.append(i)
                size += len(held[-1])
                if size >= most:
                    settle()
                    size = 0
    if held:
        settle()
    return total, n


def learned(doc_id: Column, held_out: int = 2, folds: int = 4) -> Column:
    return F.coalesce(remainder(doc_id, folds) != held_out, F.lit(False))


def train(docs: DataFrame) -> Model:
    """The model of rows (text, lang); only counts per (language, bucket) reach the driver."""
    docs = docs.filter(F.col("lang").isNotNull()).select("lang", "text")
    sizes = {r.lang: r["count"] for r in docs.groupBy("lang").count().collect()}
    languages = sorted(sizes)

    def count(batches):
        import pyarrow as pa

        counts, pending, held = {}, {}, 0

        def settle():
            for lang, parts in pending.items():
                if lang not in counts:
                    counts[lang] = np.zeros(BUCKETS, np.int64)
                counts[lang] += np.bincount(np.concatenate(parts), minlength=BUCKETS)
            pending.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch, "text")):
                for ids in ngrams(characters(text), BUCKETS):
                    pending.setdefault(lang, []).append(ids)
                    held += len(ids)
                if held > PENDING:
                    settle()
                    held = 0
        settle()
        for lang, row in counts.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": pa.array(at, pa.int32()), "n": row[at]})

    from ..shipping import ship

    ship(docs.sparkSession)
    summed = docs.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    if len(languages) > BLOCK:
        summed = cut(summed, "ngrams")
    logp = np.zeros((len(languages), BUCKETS), np.float32)
    for start in range(0, len(languages), BLOCK):
        block = languages[start : start + BLOCK]
        cells = (summed.filter(F.col("lang").isin(block)) if len(languages) > BLOCK else summed).toArrow()
        place, counts = {x: i for i, x in enumerate(block)}, np.zeros((len(block), BUCKETS))
        rows = np.array([place[x] for x in cells.column("lang").to_pylist()], np.int64)
        counts[rows, cells.column("bucket").to_numpy()] = cells.column("n").to_numpy()
        logp[start : start + BLOCK] = np.log(counts + SMOOTHING) - np.log(counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
    n = np.array([sizes[x] for x in languages], float)
    return Model(languages, np.log(n / n.sum()) if len(n) else n, logp, np.full(len(n), -np.inf))


def judged(docs: DataFrame, model: Model) -> DataFrame:
    """(row, lang_pred, score, likeness): each document, its language, and by how much it reaches the language's floor.

    ``likeness`` is null for ``und``, and plain mean log probability plus allowance where the model has no floors.
    """
    languages, prior = model.languages, model.prior
    floor = np.where(np.isfinite(model.floor), model.floor, 0.0)
    kind = docs.schema.simpleString()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    if not languages:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("likeness"))

    def named(n, best, top, rest):
        known = n > 0
        likeness = (top - prior[best] + SCATTER * np.sqrt(n)) / np.maximum(n, 1) - floor[best]
        return {
            "lang_pred": [languages[b] if k else UNKNOWN for b, k in zip(best, known)],
            "score": np.where(known, 1 / rest, 0.0), "likeness": [float(x) if k else None for x, k in zip(likeness, known)],
        }

    for start in range(0, len(languages), BLOCK):
        shared = docs.sparkSession.sparkContext.broadcast(model.part(start))
        last = start + BLOCK >= len(languages)

        def make(start=start, shared=shared, last=last):
            mine, table = shared.value

            def step(batch):
                row = batch.column("row")
                total, n = batch_sums(pc.struct_field(row, "text").cast("binary").to_pylist(), table)
                total += mine
                best = np.argmax(total, 1)
                top = total[np.arange(len(total)), best]
                rest = np.exp(total - top[:, None]).sum(1)
                best += start
                if start:
                    held = {c: batch.column(c).to_numpy() for c in ("best", "top", "rest")}
                    best = np.where(held["top"] >= top, held["best"], best)
                    high = np.maximum(held["top"], top)
                    rest = held["rest"] * np.exp(held["top"] - high) + rest * np.exp(top - high)
                    top = high
                return {"row": row} | (named(n, best, top, rest) if last else {"best": best, "top": top, "rest": rest})

            return step

        state = "lang_pred string, score double, likeness double" if last else "best long, top double, rest double"
        rows = map_rows(rows, f"row {kind}, {state}", make)
    return rows


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every text."""
    return judged(docs.select("doc_id", "text"), model).select("row.doc_id", "lang_pred", "score")


def with_floors(docs: DataFrame, model: Model) -> Model:
    """The model with a floor for each language, from all documents that name it and that it takes for that language.

    Only numbers of documents per (language, hundredth of log probability) reach the driver. A language without such documents has no floor.
    """
    found = judged(docs.filter(F.col("lang").isNotNull()).select("lang", "text"), replace(model, floor=np.full(len(model.languages), -np.inf)))
    bins = found.filter("row.lang = lang_pred").groupBy("lang_pred", F.floor(F.col("likeness") * GRAIN).alias("bin")).count().collect()
    tally: dict[str, list[tuple[int, int]]] = {}
    for lang, b, c in bins:
        tally.setdefault(lang, []).append((b, c))
    floor = np.full(len(model.languages), -np.inf)
    for i, lang in enumerate(model.languages):
        if lang in tally:
            at, c = map(np.array, zip(*sorted(tally[lang])))
            low, middle = (at[np.searchsorted(np.cumsum(c), q * c.sum())] / GRAIN for q in (LOWEST, 0.5))
            floor[i] = low - max(middle - low, LEAST_GAP)
    return replace(model, floor=floor)


def keep(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Documents in one of the learned languages, with at least that posterior and above the language's floor if it has one; all columns untouched."""
    bare = [x for x, f in zip(model.languages, model.floor) if not np.isfinite(f)]
    above = F.col("likeness") >= 0
    if bare:
        above = above | F.col("lang_pred").isin(bare)
    return judged(docs, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least) & above).select("row.*")
