"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

Words are judged in their context: ``classify_in_context`` counts word trigrams of trusted text, across word and line borders, with two start
marks before each text, and interpolates trigram, bigram and unigram with the spelling of the word as the lowest order. Words are 64-bit hashes of
what stands between blanks. Texts are kept as word places in chunks; the trigrams of all chunks are dealt by their middle word to buckets, in rounds,
as arrays of places in a dictionary of their own. One task counts the trusted ones of a bucket and looks all others up, none is gathered or left out;
it holds the trusted trigrams around a frequent middle word together. A trusted text knows its own trigrams, so one trusted document in HELD_OUT, by doc_id, is not
counted and the fence is drawn from these alone; without any there is no fence and every document with words is kept.

The spelling is a model over characters inside words, four at a time, with three start marks before and one end mark after each word; ``classify``
is this model alone, which is blind to the order of words. Counts of trusted text are tables keyed by n-gram; contexts,
continuation counts and discounts are group-bys, and the probability of every n-gram that the corpus holds comes from joins of those
tables on the n-gram, its context and its suffixes, all dealt by hash. Characters beyond the basic plane share its private-use codes in
the spelling, not in the hashes of words.

A document is kept up to a fence drawn from the quartiles of trusted documents of its language: third quartile plus FENCE times the distance
of the quartiles, in logarithms, to the next GRAIN, and wider for short texts, whose mean log probability scatters.

The character table is broadcast while it has at most BROADCAST_ROWS rows, which is counted. Beyond that each document's
distinct words are joined with the words' probabilities, which come from a join with the n-gram table.

Texts without words (null and empty ones too) have no perplexity and are not kept. A null language, and languages without
trusted text, are judged by the quartiles of all trusted documents. Repeated rows are judged each for itself, and weigh in
training as often as they occur. Several labels of one doc_id count as trusted if most are. Extra columns are not read.
Without trusted text there is no fence and every document with words is kept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..lineage import cut, drop, settled
from ..shipping import ship
from .common import map_rows, mix, remainder, utf8

START, END, OTHER = "\x02", "\x03", "\x01"
FENCE, GRAIN = 3.0, 1000  # bins per unit of log perplexity
DEVIATIONS, SPREAD = 3.0, 1.8  # allowance for short texts: standard errors, and the deviation of one character's log probability
WORD_SPREAD = 3.0  # the deviation of one word's log probability that is allowed for, a choice
BROADCAST_ROWS = 4_000_000
KEPT_WORDS = 300_000
LONGEST_KEPT = 64
PIECE = 50_000
HELD_OUT = 10
SLICES = 24  # most rounds in which the trigrams of all documents are looked up, by their middle word
COUNT_SLICES = 4  # most rounds in which those of trusted text are counted
SLICE_WORDS = 4_000_000  # words that are worth a round
BUCKET_WORDS = 1_000_000  # words of a round that are worth a bucket, in buckets of middle words
CHUNK, CHUNK_BYTES = 65_536, 22_000_000  # most documents (16 bits have their places), and bytes of text, whose words share a dictionary
MASK = {3: (1 << 48) - 1, 2: (1 << 32) - 1, 1: (1 << 16) - 1}


def words(text: bytes | None) -> list[str]:
    return text.decode().replace(START, OTHER).replace(END, OTHER).split() if text else []


def grams(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All four-character n-grams of words as 64-bit keys, and how many each word has."""
    codes = np.frombuffer(f"{START * 3}{f'{END}{START * 3}'.join(some)}{END}".encode("utf-32-le"), np.uint32).astype(np.uint64)
    if codes.max() > 0xFFFF:
        # Beyond the basic plane, characters share the private-use codes.
        codes = np.where(codes > 0xFFFF, 0xE000 + codes % 0x1900, codes).astype(np.uint64)
    keys = codes[:-3] << np.uint64(48) | codes[1:-2] << np.uint64(32) | codes[2:-1] << np.uint64(16) | codes[3:]
    return keys[codes[3:] != ord(START)].view(np.int64), np.array([len(w) + 1 for w in some], np.int64)


def pieces(some: list[str]) -> Iterator[list[str]]:
    """Words whose n-grams are looked at together."""
    for i in range(0, len(some), PIECE):
        yield some[i : i + PIECE]


def _gathered(docs: DataFrame, distinct: bool) -> DataFrame:
    """(gram, n): counts of the n-grams of all texts, summed per task before they are dealt."""
    ship(docs.sparkSession)

    def count(batches):
        tally: Counter[str] = Counter()

        def settle():
            if not tally:
                return
            keys, sizes = grams(list(tally))
            at, where = np.unique(keys, return_inverse=True)
            n = np.bincount(where, np.repeat(np.fromiter(tally.values(), np.int64), sizes)).astype(np.int64)
            tally.clear()
            yield pa.RecordBatch.from_pydict({"gram": at, "n": n})

        held = 0
        for batch in batches:
            for text in utf8(batch, "text"):
                tally.update(words(text))
                held += len(text or b"")
                if held > 64_000_000 or len(tally) > KEPT_WORDS:
                    yield from settle()
                    held = 0
        yield from settle()

    rows = docs.select("text").mapInArrow(count, "gram long, n long")
    return rows.select("gram").distinct() if distinct else rows.groupBy("gram").agg(F.sum("n").alias("n"))


# --- the model --------------------------------------------------------------------------------------------------


def _rare(counts: DataFrame) -> np.ndarray:
    """How many n-grams occur once to four times."""
    return np.array([x or 0 for x in counts.agg(*[F.sum((F.col("n") == k).cast("long")) for k in (1, 2, 3, 4)]).first()])


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    return _discounts_of(_rare(counts))


def _discounts_of(rare: np.ndarray) -> tuple[float, float, float]:
    """The three discounts of one order."""
    n1, n2, n3, n4 = rare.tolist()
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return tuple(min(max(d, 0.05), k) for d, k in zip(raw, (0.95, 1.95, 2.95)))


def _discount(n: Column, d: tuple[float, float, float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def counts_by_order(quads: DataFrame) -> dict[int, DataFrame]:
    """Raw counts of the highest order; below it, how many different characters stand before each n-gram."""
    out = {4: quads}
    for k in (3, 2, 1):
        out[k] = cut(out[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit(MASK[k])).alias("gram")).agg(F.count("*").alias("n")), f"order{k}")
    return out


def probabilities(universe: DataFrame, quads: DataFrame) -> DataFrame:
    """(gram, logp) for each n-gram of the universe, by joins with the count tables from the lowest order up."""
    orders = counts_by_order(quads)
    v = universe.select(F.col("gram").bitwiseAND(F.lit(MASK[1]))).union(orders[1].select("gram")).distinct().count() + 1
    rows, p = universe, F.lit(1.0 / v)
    for k in (1, 2, 3, 4):
        counts, d = orders[k], _discounts(orders[k])
        n = F.col("n")
        context = F.shiftrightunsigned("gram", 16)
        sums = counts.groupBy(context.alias("context")).agg(
            F.sum("n").alias("total"), (F.sum(_discount(n, d)) / F.sum("n")).alias("rest")
        )
        key = F.col("gram").bitwiseAND(F.lit(MASK[k])) if k < 4 else F.col("gram")
        rows = rows.withColumn("lower", p).withColumn("part", key).withColumn("context", F.shiftrightunsigned("part", 16))
        rows = rows.join(counts.select(F.col("gram").alias("part"), "n"), "part", "left").join(sums, "context", "left")
        # A context that was never seen leaves the lower order as it is.
        mine = F.when(F.col("total").isNull(), F.col("lower")).otherwise(
            F.coalesce((n - _discount(n, d)) / F.col("total"), F.lit(0.0)) + F.col("rest") * F.col("lower")
        )
        rows = rows.select("gram", mine.alias("p"))
        p = F.col("p")
    return rows.select("gram", F.log("p").cast("float").alias("logp"))


# --- scoring ----------------------------------------------------------------------------------------------------


class Known:
    """Log probabilities of words under a broadcast table; looks up the new words of some rows together."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray):
        self.keys, self.logp, self.kept = keys, logp.astype(np.float64), {}

    def _sums(self, some: list[str]) -> np.ndarray:
        out = []
        for piece in pieces(some):
            keys, sizes = grams(piece)
            coded = pa.array(keys).dictionary_encode()
            logp = self.logp[np.searchsorted(self.keys, coded.dictionary.to_numpy())]
            out.append(np.add.reduceat(logp[coded.indices.to_numpy()], np.cumsum(sizes) - sizes))
        return np.concatenate(out)

    def score(self, texts: list[bytes | None]) -> list[tuple[float, int]]:
        every = [words(t) for t in texts]
        if len(self.kept) > KEPT_WORDS:
            self.kept.clear()
        new = {w for ws in every for w in ws if w not in self.kept}
        long = {w for w in new if len(w) > LONGEST_KEPT}
        extra = {w: float(self._sums([w])[0]) for w in long}
        if short := list(new - long):
            self.kept.update(zip(short, self._sums(short).tolist()))
        kept = self.kept if not extra else self.kept | extra
        return [(sum(map(kept.__getitem__, ws)), sum(map(len, ws)) + len(ws)) for ws in every]


def _score_by_broadcast(docs: DataFrame, table: DataFrame) -> DataFrame:
    rows = table.sort("gram").toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((rows.column("gram").to_numpy(), rows.column("logp").to_numpy()))

    def make():
        known = Known(*shared.value)

        def step(batch):
            found = known.score(utf8(batch, "text"))
            return {"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "s": [x[0] for x in found], "n": [x[1] for x in found]}

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs, f"doc_id {kind}, lang string, s double, n long", make)


def _score_by_join(docs: DataFrame, table: DataFrame) -> DataFrame:
    def tally():
        def step(batch):
            out = {"row": [], "word": [], "k": []}
            for row, text in zip(batch.column("row").to_pylist(), utf8(batch, "text")):
                held: dict[str, int] = {}
                for w in words(text):
                    held[w] = held.get(w, 0) + 1
                out["row"] += [row] * len(held)
                out["word"] += held
                out["k"] += held.values()
            return out

        return step

    def cut_up():
        def step(batch):
            some = batch.column("word").to_pylist()
            keys, sizes = grams(some) if some else (np.empty(0, np.int64), np.empty(0, np.int64))
            return {"word": np.repeat(np.array(some, object), sizes).tolist(), "gram": keys}

        return step

    held = cut(map_rows(docs.select("row", "text"), "row long, word string, k long", tally), "held")
    per_word = map_rows(held.select("word").distinct(), "word string, gram long", cut_up).join(table, "gram").groupBy("word").agg(F.sum(F.col("logp").cast("double")).alias("s"), F.count("*").alias("n"))
    sums = held.join(per_word, "word").groupBy("row").agg(F.sum(F.col("s") * F.col("k")).alias("s"), F.sum(F.col("n") * F.col("k")).alias("n"))
    return docs.select("row").join(sums, "row", "left").select("row", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def fences(scored: DataFrame) -> DataFrame:
    """(lang, fence) from trusted rows (lang, bin); lang null stands for all languages together."""
    bins = scored.groupBy("lang", "bin").count()
    bins = bins.filter("lang IS NOT NULL").unionByName(bins.groupBy("bin").agg(F.sum("count").alias("count")).withColumn("lang", F.lit(None).cast("string")))
    # Bins are a few thousand a language, whatever the corpus.
    rows = sorted((r.lang or "", r.lang is None, r.bin, r["count"]) for r in bins.select("lang", "bin", "count").collect())
    out = []
    for key in dict.fromkeys((r[0], r[1]) for r in rows):
        mine = [(b, c) for lang, null, b, c in rows if (lang, null) == key]
        total, seen, quartile = sum(c for _, c in mine), 0, []
        for b, c in mine:
            seen += c
            quartile += [b] * sum(seen * 4 >= total * q > (seen - c) * 4 for q in (1, 3))
        out.append((None if key[1] else key[0], (quartile[1] + FENCE * max(quartile[1] - quartile[0], 1)) / GRAIN))
    return scored.sparkSession.createDataFrame(out, "lang string, fence double")


def _trusted(labels: DataFrame) -> DataFrame:
    return labels.filter("quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("q")).filter("q > 0.5").select("doc_id")


def _characters(docs: DataFrame, counted: DataFrame) -> DataFrame:
    """(gram, logp) of the characters of all documents under a model of the counted ones."""
    quads = cut(_gathered(counted, distinct=False), "order4")
    return cut(probabilities(cut(_gathered(docs, distinct=True), "universe"), quads), "logp")


def _judged(scored: DataFrame, trusted: DataFrame, scatter: float) -> DataFrame:
    """``scored`` (doc_id, lang, n, log_perplexity) against fences of its trusted rows; ``scatter`` over the root of n is allowed besides."""
    place = F.floor(F.col("log_perplexity") * GRAIN).cast("int").alias("bin")
    edge = fences(scored.join(trusted, "doc_id", "left_semi").filter("n > 0").select("lang", place))
    default = [r.fence for r in edge.filter("lang IS NULL").collect()]
    joined = scored.join(edge.filter("lang IS NOT NULL"), "lang", "left") if default else scored.withColumn("fence", F.lit(None).cast("double"))
    fence = F.coalesce("fence", F.lit(default[0] if default else None).cast("double")) + scatter / F.sqrt(F.greatest("n", F.lit(1)))
    return joined.select(
        "doc_id", "lang", F.col("n").alias("n_grams"), F.exp("log_perplexity").alias("perplexity"), F.exp(fence).alias("fence"),
        F.coalesce(F.col("log_perplexity") <= fence, F.col("n") > 0).alias("kept"),
    )


def classify(docs: DataFrame, labels: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, lang, n_grams, perplexity, fence, kept) of every document."""
    docs = docs.select("doc_id", "lang", "text")
    trusted = _trusted(labels)
    table = _characters(docs, docs.join(trusted.hint("merge"), "doc_id", "left_semi"))
    if table.count() <= broadcast_rows:
        scored = _score_by_broadcast(docs, table)
    else:
        keyed = cut(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
        scored = keyed.select("row", "doc_id", "lang").join(_score_by_join(keyed, table), "row").drop("row")
    scored = cut(scored.withColumn("log_perplexity", F.when(F.col("n") > 0, -F.col("s") / F.col("n"))), "scored")
    return _judged(scored, trusted, DEVIATIONS * SPREAD)


# --- words in context -------------------------------------------------------------------------------------------


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """How many words each text has, the place of each word among the different ones, and these."""
    texts = texts.cast(pa.string()).fill_null("")
    for mark in (START, END):
        texts = pc.replace_substring(texts, mark, OTHER)
    parts = pc.utf8_split_whitespace(texts)
    ends = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False), dtype=np.int64)
    coded = pc.list_flatten(parts).dictionary_encode()
    where, some = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    if "" in some:  # stands before and after blanks at the ends of a text
        none = some.index("")
        del some[none]
        real = where != none
        ends = np.append(0, np.cumsum(real))[ends]
        where = where[real]
        where = where - (where > none)
    return np.diff(ends, prepend=0), where, some


def _signed(some: list[int]) -> np.ndarray:
    return np.array(some, np.uint64).view(np.int64)


def _hashes(some: list[str]) -> np.ndarray:
    return _signed([xxhash.xxh3_64_intdigest(w) for w in some])


def _line(sizes: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The line of all texts, two start marks (0) before each and words from 1 on, and where the texts begin in it."""
    sizes = np.asarray(sizes, np.int64)
    starts = np.cumsum(sizes + 2) - sizes - 2
    real = np.ones(len(where) + 2 * len(sizes), bool)
    real[starts] = real[starts + 1] = False
    line = np.zeros(len(real) + 1, np.int32)
    line[:-1][real] = where + 1
    return line, starts


def _trigrams(texts: list[np.ndarray], part: tuple[int, int] = (0, 1)) -> tuple[np.ndarray, ...]:
    """(place, u, v, w, k): the different word trigrams of each text and how often it has them; only those whose
    middle word is in one part of so many."""
    sizes = np.array([len(x) for x in texts], np.int64)
    line, starts = _line(sizes, np.arange(sizes.sum()))
    at = np.flatnonzero(line[2:]) + 1  # a middle word stands before a word
    place = np.searchsorted(starts, at, "right") - 1
    line = np.concatenate([np.zeros(1, np.int64), *texts])[line]
    rows = np.stack([place, line[at - 1], line[at], line[at + 1]])
    rows, k = np.unique(rows[:, rows[2] % part[1] == part[0]], axis=1, return_counts=True)
    return *rows, k


def _coded(word: np.ndarray, where: np.ndarray) -> tuple[dict[str, bytes], np.ndarray]:
    """The words that occur, the most frequent first, with the planes of low to high bytes of every word's place among them; and their order."""
    n = np.bincount(where, minlength=len(word))
    order = np.argsort(-n, kind="stable")[: np.count_nonzero(n)]
    rank = np.empty(len(word), "<u4")
    rank[order] = np.arange(len(order), dtype=np.uint32)
    places = rank[where]
    planes = np.stack([(places >> np.uint32(8 * k)).astype(np.uint8) for k in range(4)])
    return {"word": word[order].tobytes(), "place": pa.compress(planes.tobytes(), "zstd", asbytes=True)}, order


def _packed(texts: list[np.ndarray]) -> dict[str, bytes]:
    """Texts as a dictionary of their words and every word's place in it."""
    return _coded(*np.unique(np.concatenate([np.empty(0, np.int64), *texts]), return_inverse=True))[0]


def _places(n: int, place: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(place, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, -1)
    out = planes[0].astype(np.uint32)
    for k in (1, 2, 3):
        if planes[k].any():
            out |= planes[k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _unpacked(sizes: list[int], word: bytes, place: bytes) -> list[np.ndarray]:
    line = np.frombuffer(word, np.int64)[_places(sum(sizes), place)]
    return np.split(line, np.cumsum(sizes)[:-1]) if sizes else []


def _spellings(text: str) -> list[str]:
    return text.split("\n") if text else []


def _starts(ends: np.ndarray) -> list[int]:
    """Where chunks begin among texts that end at these bytes: about equal ones, none of more than CHUNK documents."""
    total = int(ends[-1]) if len(ends) else 0
    even = ends * -(-total // CHUNK_BYTES) // (total + 1)
    return np.union1d(np.arange(0, len(ends), CHUNK), np.unique(even, return_index=True)[1]).tolist()


def _as_ids(docs: DataFrame, first: Callable | None = None, only_counted: bool = False) -> DataFrame:
    """(chunk, doc_id, lang, counted, size, word, place, spelling, p, grams): the hashes of all words in their order, some documents a row.

    ``first(words, hashes)`` gives the words' probabilities p, and the spelling is left out then. ``only_counted`` leaves out the other
    documents, but grams has the different character n-grams of all.
    """
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = T._parse_datatype_string(f"chunk long, doc_id array<{kind}>, lang array<string>, counted array<boolean>, size array<int>, word binary, place binary, spelling string, p binary, grams binary")
    target = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            starts = _starts(sizes)
            for start, end in zip(starts, [*starts[1:], batch.num_rows]):
                some = batch.slice(start, end - start)
                size, where, words_ = _split(some.column("text"))
                every = None
                if only_counted:
                    every = _runs(np.concatenate([np.empty(0, np.int64), *(_runs(grams(x)[0])[0] for x in pieces(words_))]))[0].tobytes()
                    counted = some.column("counted").to_numpy(zero_copy_only=False).astype(bool)
                    some, where, size = some.filter(pa.array(counted)), where[np.repeat(counted, size)], size[counted]
                packed, order = _coded(_hashes(words_), where)
                words_ = [words_[i] for i in order.tolist()]
                out = {c: pa.array([some.column(c).to_pylist()], target.field(c).type) for c in ("doc_id", "lang", "counted")}
                out |= {"chunk": batch.column("row")[start : start + 1], "grams": [every], "size": pa.array([size.tolist()], target.field("size").type)}
                out |= {"spelling": [None if first else "\n".join(words_)], "p": [first(words_, np.frombuffer(packed["word"], np.int64)).tobytes() if first else None]}
                yield pa.RecordBatch.from_pydict(out | {c: pa.array([x], pa.binary()) for c, x in packed.items()}, schema=target)

    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "counted", "text", F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, schema)


def _of_chunks(held: DataFrame, schema: str, make: Callable, *names: str) -> DataFrame:
    """Columns that ``make(*columns)`` finds in each row."""
    ship(held.sparkSession)
    target = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pydict(make(*(batch.column(c)[i].as_py() for c in names)), schema=target)

    return held.select(*names).mapInArrow(run, schema)


# --- counting and looking up ------------------------------------------------------------------------------------


BLOB = "bucket int, counted boolean, chunk long, word binary, p binary, u binary, v binary, w binary, place binary"


def _dealt(held: DataFrame, part: int, parts: int, buckets: int, all_too: bool) -> DataFrame:
    """The trigrams of each chunk with a middle word of this part, a row for each bucket of middle words: places in a dictionary of its own.

    Those of the documents that are counted, and those of all documents as well if ``all_too``.
    """

    def make(chunk, counted, size, word, place, p):
        word = np.frombuffer(word, np.int64)
        line, starts = _line(size, _places(sum(size), place))
        word = np.append(0, word)
        spread = mix(word.view(np.uint64))
        bucket = np.where(spread % np.uint64(parts) == part, spread // np.uint64(parts) % np.uint64(buckets), buckets).astype(np.min_scalar_type(buckets))
        here = bucket[line[:-1]]
        order = np.flatnonzero(here < buckets)
        order = order[line[order + 1] > 0]  # a middle word stands before a word
        here = here[order]
        by = np.argsort(here, kind="stable")
        order, edges = order[by], np.searchsorted(here[by], np.arange(buckets + 1))
        text = np.searchsorted(starts, order, "right") - 1
        trusted = np.array(counted, bool)[text]
        out = {c: [] for c in target}

        def add(b, mine, text):
            three = np.concatenate([line[mine - 1], line[mine], line[mine + 1]])
            if len(three) * 8 > len(word):
                used = np.zeros(len(word), bool)
                used[three] = True
                used = np.flatnonzero(used)
                rank = np.empty(len(word), np.int32)
                rank[used] = np.arange(len(used), dtype=np.int32)
                three = rank[three]
            else:
                used, three = np.unique(three, return_inverse=True)
            three = three.astype(_width(len(used))).reshape(3, -1)
            row = {"bucket": b, "counted": text is None, "chunk": chunk, "word": word[used].tobytes()} | {c: x.tobytes() for c, x in zip("uvw", three)}
            if text is not None:
                row |= {"p": np.append(0.0, np.frombuffer(p))[used].tobytes(), "place": text.astype(np.uint16).tobytes()}
            for c in target:
                out[c].append(row.get(c))

        for b in np.flatnonzero(np.diff(edges)).tolist():
            here = slice(edges[b], edges[b + 1])
            if trusted[here].any():
                add(b, order[here][trusted[here]], None)
            if all_too:
                add(b, order[here], text[here])
        return out

    target = [x.split()[0] for x in BLOB.split(", ")]
    return _of_chunks(held, BLOB, make, "chunk", "counted", "size", "word", "place", "p")


def _width(n: int) -> type:
    return np.uint16 if n <= 1 << 16 else np.uint32


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order and how often each occurs."""
    keys = np.sort(keys)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], np.diff(np.append(at, len(keys)))


class Table:
    """Sorted keys with a last one that nothing has, and where some keys stand; those it does not know get the last place."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.iinfo(np.int64).max)

    def __len__(self):
        return len(self.keys) - 1

    def find(self, some: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, some)
        at[self.keys[at] != some] = len(self)
        return at


class Counts:
    """Counts of trusted trigrams around the middle words of one bucket, and of the bigrams behind them."""

    def __init__(self, blobs: list[tuple[np.ndarray, ...]]):
        none = np.empty(0, np.int64)
        words_ = _runs(np.concatenate([none, *(x[0] for x in blobs)]))[0]
        self.words = Table(words_)
        u, v, w = (np.concatenate([none, *x]) for x in zip(*([self.words.find(x[0])[y] for y in x[1:]] for x in blobs))) if blobs else (none,) * 3
        n = self.n = len(words_) + 1
        pairs = u * n + v
        contexts = _runs(pairs)[0]
        self.contexts = Table(contexts)
        three, self.n3 = _runs(np.searchsorted(contexts, pairs) * n + w)
        self.before, last = three // n, three % n
        two, self.n2 = _runs(contexts[self.before] % n * n + last)
        self.middle, self.last = two // n, two % n
        self.three, self.two = Table(three), Table(two)

    def firsts(self) -> tuple[np.ndarray, np.ndarray]:
        """Each last word and how many different words stand before it."""
        at, n = _runs(self.last)
        return self.words.keys[at], n

    def discounted(self, d2: np.ndarray, d3: np.ndarray) -> None:
        """What a count or context adds to a probability; zero, and no change to the lower order, for those at the last place."""

        def parts(group, groups, n, d):
            off = d[np.minimum(n, 3)]
            total = np.bincount(group, n, groups)
            rest = np.bincount(group, off, groups).astype(float)
            np.divide(rest, total, rest, where=total > 0)
            return np.append((n - off) / total[group], 0.0), np.where(total > 0, rest, 1.0)

        self.a3, self.r3 = parts(self.before, len(self.contexts) + 1, self.n3, d3)
        self.a2, self.r2 = parts(self.middle, self.n, self.n2, d2)

    def scores(self, word: np.ndarray, p: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Log probabilities of trigrams of places in ``word``, whose own probabilities are ``p``."""
        ids = self.words.find(word)
        lower = p[w]
        u, v, w = ids[u], ids[v], ids[w]
        context = self.contexts.find(u * self.n + v)
        lower = self.a2[self.two.find(v * self.n + w)] + self.r2[v] * lower
        return np.log(self.a3[self.three.find(context * self.n + w)] + self.r3[context] * lower)


def _read(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    word = np.frombuffer(batch.column("word")[i].as_py(), np.int64)
    return word, *(np.frombuffer(batch.column(c)[i].as_py(), _width(len(word))) for c in "uvw")


def _in_buckets(blobs: DataFrame, buckets: int, schema: str, make: Callable) -> DataFrame:
    """Columns that ``make()(counts, rows)`` finds for each bucket: what is counted comes first, then once a batch of other rows and None at the end."""
    ship(blobs.sparkSession)
    target = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        step, counted, counts = make(), [], None
        for batch in batches:
            first = np.count_nonzero(batch.column("counted").to_numpy(zero_copy_only=False))
            counted += [_read(batch, i) for i in range(first)]
            if first < batch.num_rows:
                if counts is None:
                    counts, counted = Counts(counted), []
                yield pa.RecordBatch.from_pydict(step(counts, batch.slice(first)), schema=target)
        if counted:
            yield pa.RecordBatch.from_pydict(step(Counts(counted), None), schema=target)

    return blobs.repartitionById(buckets, "bucket").sortWithinPartitions(F.desc("counted")).mapInArrow(run, schema)


def _orders(picked: DataFrame, part: int, parts: int, buckets: int) -> DataFrame:
    """(k, w, n): for k 1 how many words stand before w; for k 2 and 3 how many counts of that order are w, up to 4."""

    def make():
        def step(counts, _):
            w, n = counts.firsts()
            rare = [np.bincount(np.minimum(x, 5), minlength=6)[1:5] for x in (counts.n2, counts.n3)]
            four = np.arange(1, 5)
            return {"k": np.repeat([1, 2, 3], [len(w), 4, 4]), "w": np.concatenate([w, four, four]), "n": np.concatenate([n, *rare])}

        return step

    return _in_buckets(_dealt(picked, part, parts, buckets, False), buckets, "k int, w long, n long", make).groupBy("k", "w").agg(F.sum("n").alias("n"))


def _summed(rows: DataFrame) -> DataFrame:
    """(chunk, s): sums of s over the places in a chunk, as an array by place."""
    ship(rows.sparkSession)
    schema = "chunk long, s binary, place binary"
    target = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, s, place in zip(*(batch.column(c).to_pylist() for c in ("chunk", "s", "place"))):
                s = np.frombuffer(s)
                place = np.arange(len(s)) if place is None else np.frombuffer(place, np.uint16)
                old, n = sums.get(chunk, np.empty(0)), int(place[-1]) + 1 if len(place) else 0
                if n > len(old):
                    old = np.append(old, np.zeros(n - len(old)))
                old[place] += s
                sums[chunk] = old
        if sums:
            yield pa.RecordBatch.from_pydict({"chunk": list(sums), "s": [x.tobytes() for x in sums.values()], "place": pa.nulls(len(sums), pa.binary())}, schema=target)

    return rows.repartition("chunk").mapInArrow(run, schema)


def _scored(held: DataFrame, part: int, parts: int, buckets: int, d2: np.ndarray, d3: np.ndarray, others: list[DataFrame]) -> DataFrame:
    """(chunk, s, place): each document's sum of the log probabilities of its trigrams with a middle word of this part, and of what other parts have."""

    def make():
        ready = []

        def step(counts, rows):
            out = {"chunk": [], "s": [], "place": []}
            if rows is None:
                return out
            if not ready:
                counts.discounted(d2, d3)
                ready.append(True)
            for i in range(rows.num_rows):
                word, *three = _read(rows, i)
                logs = counts.scores(word, np.frombuffer(rows.column("p")[i].as_py()), *three)
                place = np.frombuffer(rows.column("place")[i].as_py(), np.uint16)
                at = np.flatnonzero(np.bincount(place))
                out["chunk"].append(rows.column("chunk")[i].as_py())
                out["s"].append(np.bincount(place, logs)[at].tobytes())
                out["place"].append(at.astype(np.uint16).tobytes())
            return out

        return step

    return _summed(reduce(DataFrame.unionByName, others, _in_buckets(_dealt(held, part, parts, buckets, True), buckets, "chunk long, s binary, place binary", make)))


# --- characters of words ----------------------------------------------------------------------------------------


def _grams_of(picked: DataFrame) -> DataFrame:
    """(gram, n): counts of the character n-grams of all words."""

    def make(size, place, spelling):
        some = _spellings(spelling)
        often, at, n = np.bincount(_places(sum(size), place), minlength=len(some)), [np.empty(0, np.int64)], [np.empty(0)]
        for i, piece in enumerate(pieces(some)):
            keys, sizes = grams(piece)
            coded = pa.array(keys).dictionary_encode()
            at.append(coded.dictionary.to_numpy())
            n.append(np.bincount(coded.indices.to_numpy(), np.repeat(often[i * PIECE : i * PIECE + PIECE], sizes)))
        at, where = np.unique(np.concatenate(at), return_inverse=True)
        return {"gram": at, "n": np.bincount(where, np.concatenate(n)).astype(np.int64)}

    return _of_chunks(picked, "gram long, n long", make, "size", "place", "spelling").groupBy("gram").agg(F.sum("n").alias("n"))


def _spelled(each: DataFrame, table: DataFrame, broadcast_rows: int) -> DataFrame:
    """(w, s): the log probability of the spelling of each word in (w, word)."""
    ship(each.sparkSession)
    if table.count() <= broadcast_rows:
        shared = _shared(table, "gram", "logp")

        def make():
            known = Known(*shared.value)
            return lambda batch: {"w": batch.column("w"), "s": known._sums(batch.column("word").to_pylist()) if batch.num_rows else []}

        return map_rows(each, "w long, s double", make)

    def cut_up():
        def step(batch):
            some = batch.column("word").to_pylist()
            keys, sizes = grams(some) if some else (np.empty(0, np.int64), np.empty(0, np.int64))
            return {"w": np.repeat(batch.column("w").to_numpy(), sizes), "gram": keys}

        return step

    return map_rows(each, "w long, gram long", cut_up).join(table, "gram").groupBy("w").agg(F.sum(F.col("logp").cast("double")).alias("s"))


def _shared(table: DataFrame, *names: str):
    rows = table.select(*names).sort(names[0]).toArrow()
    return table.sparkSession.sparkContext.broadcast(tuple(rows.column(c).to_numpy() for c in names))


def _with_firsts(docs: DataFrame, one: DataFrame, table: DataFrame, broadcast_rows: int) -> DataFrame:
    """The documents (doc_id, lang, counted, text) in chunks, with the probability p of each word alone: unigrams above the spelling."""
    total, *rare = one.agg(F.sum("n"), *[F.sum((F.col("n") == k).cast("long")) for k in (1, 2, 3, 4)]).first()
    d = np.append(0.0, _discounts_of(np.array([x or 0 for x in rare])))
    rest = one.agg(F.sum(_discount(F.col("n"), tuple(d[1:].tolist()))) / F.sum("n")).first()[0]

    def p(n, s):
        return (n - d[np.minimum(n, 3)]) / total + rest * np.exp(s) if total else np.exp(s)

    if max(one.count(), table.count()) <= broadcast_rows:
        spelling, seen = _shared(table, "gram", "logp"), _shared(one, "w", "n")
        ready = []

        def first(some, word):
            if not ready:
                ready.extend((Known(*spelling.value), Table(seen.value[0]), np.append(seen.value[1], 0)))
            known, words_, n = ready
            return p(n[words_.find(word)], known._sums(some)) if some else np.empty(0)

        held = cut(_as_ids(docs, first), "held", compression="zstd")
        spelling.destroy()
        seen.destroy()
        return held
    held = cut(_as_ids(docs), "spelled", compression="zstd")

    def rows(chunk, word, spelling):
        some = _spellings(spelling)
        return {"chunk": [chunk] * len(some), "at": range(len(some)), "w": np.frombuffer(word, np.int64), "word": some}

    asked = _of_chunks(held, "chunk long, at int, w long, word string", rows, "chunk", "word", "spelling")
    each = cut(asked.select("w", "word").distinct(), "words", compression="zstd")
    known = _spelled(each, table, broadcast_rows).join(one, "w", "left").select("w", "s", F.coalesce("n", F.lit(0)).alias("n"))
    answers = asked.select("chunk", "at", "w").join(known, "w").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("at", "n", "s"))).alias("x"))

    def make(chunk, n, s):
        return {"chunk": [chunk], "p": [p(np.array(n, np.int64), np.array(s, float)).tobytes()]}

    answers = _of_chunks(answers.select("chunk", F.col("x.n").alias("n"), F.col("x.s").alias("s")), "chunk long, p binary", make, "chunk", "n", "s")
    out = cut(held.drop("p", "spelling", "grams").join(answers, "chunk", "left"), "held", compression="zstd")
    drop(held, each)
    return out


def classify_in_context(docs: DataFrame, labels: DataFrame, broadcast_rows: int = BROADCAST_ROWS, slices: int | None = None) -> DataFrame:
    """(doc_id, lang, n_grams, perplexity, fence, kept) of every document, per word and by words in their order; n_grams counts words.

    A trigram, its context and its suffix share the middle word, so trigrams are counted and looked up in rounds by that word, in buckets
    whose counts are arrays in one task, and only the sums of a document's log probabilities stay from each. Unigrams of trusted text and
    the table of characters are broadcast while each has at most ``broadcast_rows`` rows, beyond that words are joined with them.
    """
    spark = docs.sparkSession
    with settled(spark):
        trusted = cut(_trusted(labels), "trusted")
        out = F.coalesce(remainder(F.col("doc_id"), HELD_OUT) == 0, F.lit(False))
        # Few trusted ids go to the texts, many meet them by doc_id.
        marks = trusted.filter(~out).withColumn("counted", F.lit(True)).hint("broadcast" if trusted.count() <= broadcast_rows else "merge")
        marked = docs.select("doc_id", "lang", "text").join(marks, "doc_id", "left").withColumn("counted", F.coalesce("counted", F.lit(False)))
        picked = cut(_as_ids(marked, only_counted=True), "picked", compression="zstd")
        universe = cut(_of_chunks(picked, "gram long", lambda x: {"gram": np.frombuffer(x, np.int64)}, "grams").distinct(), "universe")
        quads = cut(_grams_of(picked), "order4")
        table = cut(probabilities(universe, quads), "logp")
        drop(universe, quads)

        def dealt(rows, most):
            """Rounds and buckets."""
            n = rows.agg(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda x, y: x + y))).first()[0] or 0
            rounds = slices or max(1, min(most, n // SLICE_WORDS))
            return rounds, max(spark.sparkContext.defaultParallelism, n // (rounds * BUCKET_WORDS))

        rounds, buckets = dealt(picked, COUNT_SLICES)
        parts = [cut(_orders(picked, part, rounds, buckets), "unigrams") for part in range(rounds)]
        orders = reduce(DataFrame.unionByName, parts)
        rare = {(r.k, r.w): r.n for r in orders.filter("k > 1").groupBy("k", "w").agg(F.sum("n").alias("n")).collect()}
        d2, d3 = (np.append(0.0, _discounts_of(np.array([rare.get((k, n), 0) for n in range(1, 5)]))) for k in (2, 3))
        one = cut(orders.filter("k = 1").groupBy("w").agg(F.sum("n").alias("n")), "first")
        drop(picked, *parts)
        held = _with_firsts(marked, one, table, broadcast_rows)
        drop(one, table)
        rounds, buckets = dealt(held, SLICES)
        found: list[DataFrame] = []
        for part in range(rounds):
            sums = cut(_scored(held, part, rounds, buckets, d2, d3, found), "sums")
            drop(*found)
            found = [sums]

        def each(doc_id, lang, size, s):
            s = np.append(np.frombuffer(s or b""), np.zeros(len(size)))[: len(size)]
            n = np.array(size, np.int64)
            return {"doc_id": doc_id, "lang": lang, "n": n, "log_perplexity": pa.array(-s / np.maximum(n, 1), mask=n == 0)}

        kind = docs.schema["doc_id"].dataType.simpleString()
        rows = held.select("chunk", "doc_id", "lang", "size").join(sums.select("chunk", "s"), "chunk", "left")
        scored = cut(_of_chunks(rows, f"doc_id {kind}, lang string, n long, log_perplexity double", each, "doc_id", "lang", "size", "s"), "scored")
        drop(held, *found)
    return _judged(scored, trusted.filter(out), DEVIATIONS * WORD_SPREAD)
