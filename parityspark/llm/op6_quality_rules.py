"""Quality rules under weak supervision.

Each rule looks at a few counts of a text and votes good (1), bad (-1) or abstains (0). Documents are summed up by their
vote pattern (at most 3 ** number of rules rows, whatever the input), expectation-maximisation over the patterns
estimates every rule's vote probabilities given a good or a bad document, and the posterior probability of "good" decides,
instead of asking that all rules pass.

Null text counts as no words, and texts of any length are counted whole. Repeated rows are judged each for itself, and weigh in the
estimates as often as they occur; extra columns are not read. A posterior of exactly one half keeps the document. A corpus without documents
gives the starting accuracies.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_rows, map_rows, utf8

#: Counts of a text, in the order of ``measure``.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_lines", "n_plain")
_NO_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"
_NOT_LEAD = bytes(range(0x80, 0xC0))  # continuation bytes of UTF-8
KEEP_FROM = 0.5


def repeated_words(w: list[bytes]) -> int:
    """Words covered by three-word windows that occur twice or more, the first occurrence included."""
    n = len(w) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(x, len(number)) for x in w], np.int64)
    k = len(number)
    pairs = ids[:-1] * k + ids[1:]
    if k < 2_000_000:
        codes = pairs[:-1] * k + ids[2:]
    else:
        codes = np.unique(pairs, return_inverse=True)[1][:-1].astype(np.int64) * k + ids[2:]
    ordered = np.sort(codes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = np.flatnonzero(np.isin(codes, twice))
    hit = np.zeros(len(w), bool)
    for d in range(3):
        hit[again + d] = True
    return int(hit.sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    w = text.split()
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
        seen.add(line)
    solid = text.translate(None, _BLANKS)
    chars = len(solid.translate(None, _NOT_LEAD))
    symbols = len(solid) - len(solid.translate(None, _NO_SYMBOLS))
    upper = len(solid) - len(solid.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    letters = len(solid) - len(solid.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
    plain = sum(x[-1:] not in b"#*$%&|<>!" for x in w)
    return len(w), chars, symbols, dup, repeated_words(w), upper, letters, lines, plain


@dataclass(frozen=True)
class Rule:
    """Votes good if ``top / bottom`` lies in [good], bad if it lies outside [fair], else abstains. An empty bottom abstains."""

    name: str
    top: str
    bottom: str | None
    good: tuple[float, float]
    fair: tuple[float, float]


RULES = (
    Rule("length", "n_words", None, (60, 60_000), (50, 100_000)),
    Rule("word_length", "word_chars", "n_words", (3, 9), (2.5, 12)),
    Rule("symbols", "n_symbols", "word_chars", (0, 0.01), (0, 0.05)),
    Rule("plain_ends", "n_plain", "n_words", (0.9, 1), (0.7, 1)),
    Rule("dup_lines", "n_dup_lines", "n_lines", (0, 0.05), (0, 0.3)),
    Rule("repeats", "n_repeat_words", "n_words", (0, 0.1), (0, 0.3)),
    Rule("capitals", "n_upper", "n_letters", (0, 0.1), (0, 0.4)),
)


def vote(rule: Rule) -> Column:
    bottom = F.lit(1) if rule.bottom is None else F.col(rule.bottom)
    # Bounds are compared by multiplication, so that no division decides a border case.
    inside = lambda lo, hi: (F.col(rule.top) >= F.lit(float(lo)) * bottom) & (F.col(rule.top) <= F.lit(float(hi)) * bottom)
    return F.when(bottom == 0, 0).when(inside(*rule.good), 1).when(inside(*rule.fair), 0).otherwise(-1).cast("int")


def vote_of(rule: Rule, counts: dict[str, int]) -> int:
    top, bottom = counts[rule.top], 1 if rule.bottom is None else counts[rule.bottom]
    if bottom == 0:
        return 0
    return 1 if rule.good[0] * bottom <= top <= rule.good[1] * bottom else 0 if rule.fair[0] * bottom <= top <= rule.fair[1] * bottom else -1


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every text."""

    def make():
        def step(rows):
            found = [measure(t) for t in utf8(rows, "text")]
            return {"doc_id": rows.column("doc_id")} | {c: [x[i] for x in found] for i, c in enumerate(COUNTS)}

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS), make)


@dataclass(frozen=True)
class Model:
    """prior: log odds of good; weight[rule][vote + 1]: log ratio of the vote's probability given good and given bad."""

    prior: float
    weight: tuple[tuple[float, float, float], ...]

    def log_odds(self, votes) -> float:
        return self.prior + sum(w[v + 1] for w, v in zip(self.weight, votes))


#: Expected vote probabilities (bad, abstain, good) of a rule given a good and given a bad document: good documents break few
#: rules, bad ones break some and pass most.
EXPECTED = ((0.02, 0.08, 0.9), (0.3, 0.15, 0.55))
PSEUDO = 10.0  # documents of each class that this expectation stands for, and documents behind the prior; a corpus outvotes them


def _ratio(p: np.ndarray) -> np.ndarray:
    """Log ratio of each rule's votes given good and given bad, no vote speaking against its own side."""
    ratio = np.log(p[:, 0]) - np.log(p[:, 1])
    ratio[:, 0], ratio[:, 2] = np.minimum(ratio[:, 0], 0), np.maximum(ratio[:, 2], 0)
    return ratio


def fit(patterns: dict[tuple[int, ...], int], n_rules: int, rounds: int = 100) -> Model:
    """Expectation-maximisation over vote patterns and their counts.

    Each rule starts from EXPECTED and keeps it as a Dirichlet prior worth PSEUDO documents of either class, whatever the corpus. As usual in
    weak supervision, rules are held to be no worse than chance, in every round: a bad vote never speaks for a document, nor a good vote
    against it, so two classes cannot settle on one odd cluster and call the rest good. Votes are independent given the class.
    """
    keys = sorted(patterns)
    x = np.array(keys, int).reshape(len(keys), n_rules) + 1
    n = np.array([patterns[k] for k in keys], float)
    expected = np.array(EXPECTED)
    p, prior = np.array([expected] * n_rules), 0.9
    for _ in range(rounds if n.sum() else 0):
        ratio = _ratio(p)
        odds = np.log(prior) - np.log1p(-prior) + sum(ratio[r, x[:, r]] for r in range(n_rules))
        q = n / (1 + np.exp(np.clip(-odds, -700, 700)))
        prior = (q.sum() + 0.9 * PSEUDO) / (n.sum() + PSEUDO)
        for k, c in enumerate((q, n - q)):
            for r in range(n_rules):
                p[r, k] = [(c[x[:, r] == v].sum() + PSEUDO * expected[k, v]) / (c.sum() + PSEUDO) for v in range(3)]
    ratio = _ratio(p)
    return Model(float(np.log(prior) - np.log1p(-prior)), tuple(tuple(map(float, w)) for w in ratio))


def learn(counted: DataFrame, rules=RULES) -> Model:
    """The model of a corpus from its metrics; only vote patterns and their counts reach the driver."""
    rows = counted.select(*[vote(r).alias(f"v{i}") for i, r in enumerate(rules)]).groupBy(*[f"v{i}" for i in range(len(rules))]).count().collect()
    return fit({tuple(r[:-1]): r[-1] for r in rows}, len(rules))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(counted: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """The metrics with ``quality`` (posterior probability of good), ``base_failed`` and ``kept``."""
    odds = F.lit(model.prior)
    for rule, w in zip(rules, model.weight):
        v = vote(rule)
        odds = odds + F.when(v == 1, w[2]).when(v == 0, w[1]).otherwise(w[0])
    quality = 1 / (1 + F.exp(-odds))
    return counted.withColumns({"quality": quality, "base_failed": base_failed()}).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))


def keep(docs: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """The documents that ``judge`` keeps, all columns untouched."""
    edge = float(np.log(KEEP_FROM / (1 - KEEP_FROM)))

    def good(text: bytes | None) -> bool:
        counts = dict(zip(COUNTS, measure(text)))
        if counts["n_words"] < 50 or 100 * counts["n_repeat_words"] > 50 * counts["n_words"]:
            return False
        return model.log_odds([vote_of(r, counts) for r in rules]) >= edge

    return filter_rows(docs, lambda: lambda rows: np.array([good(t) for t in utf8(rows, "text")], bool))
