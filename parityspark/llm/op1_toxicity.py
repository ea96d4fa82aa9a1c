"""Toxicity by maximum-scoring segments.

Learning: distinct labelled texts give, for every hashed token and every hashed stem of one, the number of toxic and clean texts
that hold it. The log odds
of the two, under a Dirichlet prior that mixes half a count with the background frequency, are kept where they stand
Z standard errors above zero, less that margin; every other token gets one small negative score, the log odds of
meeting an ordinary token; a token takes the best of its own score and its stems'. Only the kept ones, at most BUCKETS, reach the driver and the tasks.

Scoring: one pass over a text finds all its maximal scoring segments in linear time. A segment of score S in a text of n
tokens is expected E = n exp(-lambda S) times by chance, where lambda solves sum p(s) exp(lambda s) = 1 over clean
text; the significant segments are put together by the sum statistic of extreme-value theory, and a text without one is judged by the
extreme-value probability of its best segment, so that weak signs count for something. A logistic curve over that
evidence, fitted on all labelled distinct texts by histogram, turns it into the probability of the toxic label.

Null and empty texts have no tokens and get the score of a text without evidence. Rows without doc_id or label are not
learned from; several labels of one text are averaged, a tie counting as toxic. Repeated rows are scored each for itself;
extra columns are not read. Without any label the score is 0.5.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..shipping import ship
from .common import Memo, map_rows, remainder, utf8
from .op9_decontamination import spans, words

BUCKETS = 1 << 22
Z = 3.0
BACKGROUND = 10.0  # prior texts shared out by background frequency
SIGNIFICANT = 0.05  # chance occurrences of a passage that still counts
PER_UNIT, MOST_EVIDENCE = 10, 60  # histogram of evidence: bins per unit, and where it ends


STEMS = (4, 5, 6)  # characters of the stems that stand for inflected forms


def bucket(feature: bytes) -> int:
    return xxhash.xxh3_64_intdigest(feature) & (BUCKETS - 1)


def features(word: bytes) -> tuple[int, ...]:
    """Buckets of a word and of its stems, which stand for forms of a word that learning has not met."""
    text = word.decode()
    return (bucket(word), *(bucket(f"{text[:k]}-".encode()) for k in STEMS if len(text) > k))


@dataclass
class Scores:
    kept: dict[int, float] = field(default_factory=dict)  # bucket: score
    ordinary: float = -0.01
    rate: float = 1.0  # lambda
    curve: tuple[float, float] = (0.0, 0.0)  # intercept and slope of the logistic

    def memo(self) -> Memo:
        kept, ordinary = self.kept, self.ordinary
        return Memo(lambda w: max((kept[b] for b in features(w) if b in kept), default=ordinary))


def segments(at: np.ndarray, gain: np.ndarray, ordinary: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score), in linear time.

    ``at`` are the positions of tokens with a positive score and ``gain`` their scores; all others score ``ordinary`` < 0.
    Candidates form a list; each keeps the running total before it and after it and the nearest earlier candidate that
    started lower. A new one joins back to its nearest lower start, as long as that raises the end total.
    """
    done: list[tuple[int, int, float, float, int]] = []
    total, before = 0.0, -1
    for p, g in zip(at.tolist(), gain.tolist()):
        left = total + ordinary * (p - before - 1)
        total, before, first = left + g, p, p
        while True:
            k = len(done) - 1
            while k >= 0 and done[k][2] >= left:
                k = done[k][4]
            if k < 0 or done[k][3] >= total:
                break
            first, left = done[k][0], done[k][2]
            del done[k:]
        done.append((first, p, left, total, k))
    return [(a, b, right - left) for a, b, left, right, _ in done]


def evidence(found: list[tuple[int, int, float]], n: int, rate: float) -> tuple[float, list[tuple[int, int, float]]]:
    """Evidence of a text, at least 0, and its significant segments, the strongest first.

    The r best segments together weigh sum(lambda S - ln n) + ln r!: the sum statistic of r segments, whose order is free.
    """
    base = math.log(max(n, 2))
    strong = sorted((x for x in found if rate * x[2] - base > -math.log(SIGNIFICANT)), key=lambda x: (-x[2], x[0]))
    if not found:
        return 0.0, strong
    if not strong:
        # The best passage still has its extreme-value probability, 1 - exp(-E) for E expected ones of its score.
        expected = math.exp(min(base - rate * max(x[2] for x in found), 700.0))
        return -math.log(-math.expm1(-expected)), strong
    return max(0.0, sum(rate * s - base for *_, s in strong) + math.lgamma(len(strong) + 1)), strong


def score_text(text: bytes | None, memo: Memo, scores: Scores) -> tuple[int, float, list[tuple[int, int, float]]]:
    w = words(text)
    each = np.fromiter(map(memo.__getitem__, w), np.float64, len(w))
    at = np.flatnonzero(each > 0)
    if not len(at):
        return len(w), 0.0, []
    return len(w), *evidence(segments(at, each[at], scores.ordinary), len(w), scores.rate)


# --- learning ---------------------------------------------------------------------------------------------------


def learned(doc_id: Column) -> Column:
    return F.coalesce(remainder(doc_id, 3) != 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic): one row for each distinct labelled text, under its smallest doc_id."""
    marks = labels.filter(F.col("toxic").isNotNull() & learned(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))
    keyed = docs.filter(learned(F.col("doc_id"))).select("doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit("second"), "text").alias("h2"))
    by_text = keyed.join(marks, "doc_id").groupBy("h", "h2").agg(F.min("doc_id").alias("doc_id"), F.avg("toxic").alias("toxic"))
    return cut(by_text.select("doc_id", (F.col("toxic") >= 0.5).cast("int").alias("toxic")), "labelled")


def token_counts(texts: DataFrame) -> DataFrame:
    """(bucket, toxic, clean): how many texts of rows (text, toxic) hold a token of that bucket."""
    ship(texts.sparkSession)

    def count(batches):
        memo = Memo(features)
        for batch in batches:
            seen: dict[int, list[int]] = {}
            for text, toxic in zip(utf8(batch, "text"), batch.column("toxic").to_pylist()):
                for b in {b for w in set(words(text)) for b in memo[w]}:
                    seen.setdefault(b, [0, 0])[1 - toxic] += 1
            yield pa.RecordBatch.from_pydict(
                {"bucket": pa.array(seen.keys(), pa.int32()), "toxic": pa.array((x[0] for x in seen.values()), pa.int64()), "clean": pa.array((x[1] for x in seen.values()), pa.int64())}
            )

    counted = texts.select("text", "toxic").mapInArrow(count, "bucket int, toxic long, clean long")
    return counted.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn(docs: DataFrame, marks: DataFrame) -> Scores:
    """Token scores from rows (doc_id, toxic) of ``labelled``; the curve is still flat."""
    # Texts are dealt by doc_id whatever the number of labels, so that the plan is the same at every size.
    texts = docs.filter(learned(F.col("doc_id"))).select("doc_id", "text").join(marks.hint("merge"), "doc_id")
    counts = cut(token_counts(texts), "counts")
    t, c = (x or 0 for x in counts.agg(F.sum("toxic"), F.sum("clean")).first())
    if not t or not c:
        return Scores()
    extra = BACKGROUND * (F.col("toxic") + F.col("clean")) / (t + c) + 0.5
    yt, yc = F.col("toxic") + extra, F.col("clean") + extra
    odds = F.log(yt / (t + BACKGROUND - yt + 1)) - F.log(yc / (c + BACKGROUND - yc + 1))
    error = F.sqrt(1 / yt + 1 / yc)
    scored = counts.select("bucket", "toxic", "clean", (odds - Z * error).alias("s")).filter("s > 0").toArrow()
    kept = dict(zip(scored.column("bucket").to_pylist(), scored.column("s").to_pylist()))
    if not kept:
        return Scores()
    toxic, clean = scored.column("toxic").to_numpy(), scored.column("clean").to_numpy() + 0.5
    ordinary = math.log1p(-min(0.5, toxic.sum() / t)) - math.log1p(-min(0.5, clean.sum() / c))
    ordinary = min(ordinary, -1e-3)
    p, s = clean / (c + 1), scored.column("s").to_numpy()
    # lambda: the positive root of sum p exp(lambda s) = 1, if ordinary tokens outweigh the others.
    excess = lambda x: float((p * np.exp(np.minimum(x * s, 700))).sum() + (1 - p.sum()) * math.exp(x * ordinary) - 1)
    low, high = 1e-9, 1.0
    while excess(high) < 0 and high < 1e3:
        low, high = high, high * 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return Scores(kept, ordinary, high)


def fit_curve(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Logistic curve over rows (evidence, toxic texts, clean texts), slope at least 0; weak ridge towards 0."""
    x = np.array([b[0] for b in bins])
    y, n = np.array([b[1] for b in bins], float), np.array([b[1] + b[2] for b in bins], float)
    a, b = math.log((y.sum() + 0.5) / (n.sum() - y.sum() + 0.5)), 0.0
    beta, ridge = np.array([a, b]), np.diag([1e-6, 1e-3])
    design = np.stack([np.ones_like(x), x])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(beta @ design, -500, 500)))
        gradient = design @ (y - n * p) - ridge @ beta
        hessian = (design * (n * p * (1 - p) + 1e-9)) @ design.T + ridge
        step = np.linalg.solve(hessian, gradient)
        beta = beta + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-10:
            break
    return (float(beta[0]), float(beta[1])) if beta[1] > 0 else (a, 0.0)


# --- scoring ----------------------------------------------------------------------------------------------------

PASSAGES = "array<struct<start:int,end:int,score:double>>"


def scan(docs: DataFrame, scores: Scores) -> DataFrame:
    """(doc_id, n_words, evidence, passages) of every text; passages are character ranges of the original."""
    shared = docs.sparkSession.sparkContext.broadcast(scores)

    def make():
        known = shared.value
        memo = known.memo()

        def passage(text, a, b, s):
            return spans(text, list(range(a, b + 1)))[0] | {"score": s}

        def step(rows):
            texts = utf8(rows, "text")
            found = [score_text(t, memo, known) for t in texts]
            return {
                "doc_id": rows.column("doc_id"), "n_words": [x[0] for x in found], "evidence": [x[1] for x in found],
                "passages": [[passage(t, *p) for p in x[2]] for t, x in zip(texts, found)],
            }

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), f"doc_id {kind}, n_words long, evidence double, passages {PASSAGES}", make)


def calibrate(scanned: DataFrame, marks: DataFrame) -> tuple[float, float]:
    """The curve from all labelled distinct texts, by histogram of their evidence."""
    place = F.least(F.round(F.col("evidence") * PER_UNIT), F.lit(MOST_EVIDENCE * PER_UNIT)).cast("int")
    rows = scanned.select("doc_id", place.alias("bin")).join(marks, "doc_id").groupBy("bin").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).orderBy("bin").collect()
    return fit_curve([(r.bin / PER_UNIT, r.t, r.c) for r in rows]) if rows else (0.0, 0.0)


def score(scanned: DataFrame, curve: tuple[float, float]) -> DataFrame:
    """The scanned rows with ``score``, the probability of the toxic label."""
    return scanned.withColumn("score", 1 / (1 + F.exp(-(curve[0] + curve[1] * F.col("evidence")))))


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, evidence, passages, score) of every text."""
    marks = labelled(docs, labels)
    scanned = cut(scan(docs, learn(docs, marks)), "scanned")
    return score(scanned, calibrate(scanned, marks))
