"""Bit vectors of any length: arrays of 64-bit words, lowest first. Bit i is bit i % 64 of word i // 64.

Masks of up to 63 bits stay one BIGINT; ``Masks`` hides which of the two a column holds. Words of one model all have the length its
observables need; operations align vectors of different lengths, missing words being zero.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = 64
NARROW = 63
TYPE = "array<bigint>"


def words_for(n_bits: int) -> int:
    """Words that hold ``n_bits`` bits; 0 stands for one BIGINT, which holds up to 63."""
    return 0 if n_bits <= NARROW else -(-n_bits // WORD)


def place(idx: Column) -> Column:
    """The word value with bit ``idx`` % 64 set."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (idx % WORD).cast("int"))


def single(idx: Column, n_words: int) -> Column:
    """Vector with one bit set; NULL for a NULL index."""
    outside = F.raise_error(F.concat(F.lit(f"vectors hold bits 0 to {n_words * WORD - 1}, not "), idx.cast("string"))).cast(TYPE)
    made = F.array(*[F.when(F.floor(idx / WORD) == i, place(idx)).otherwise(F.lit(0).cast("bigint")) for i in range(n_words)])
    return F.when(idx.between(0, n_words * WORD - 1), made).when(idx.isNotNull(), outside)


def or_of(idx: Column, n_words: int) -> Column:
    """Aggregate: vector of all bits ``idx``, one OR a word; NULL indices count for nothing."""
    bit = single(idx, n_words)
    return F.array(*[F.coalesce(F.bit_or(F.get(bit, F.lit(i))), F.lit(0).cast("bigint")) for i in range(n_words)])


def indices(words: Column) -> Column:
    """Set bits, lowest first."""
    every = F.sequence(F.lit(0), F.lit(WORD - 1))
    return F.flatten(F.transform(words, lambda w, i: F.transform(F.filter(every, lambda b: F.getbit(w, b) == 1), lambda b: b + i * WORD)))


def literal(value: int, n_words: int) -> Column:
    """A Python number of any size as a vector."""
    cut = [(value >> (WORD * i)) & ((1 << WORD) - 1) for i in range(n_words)]
    return F.array(*[F.lit(w - (1 << WORD) if w >> NARROW else w).cast("bigint") for w in cut]).cast(TYPE)


def _aligned(a: Column, b: Column, op) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.zip_with(a, b, lambda x, y: op(F.coalesce(x, zero), F.coalesce(y, zero)))


def xor_by(df: DataFrame, keys: Sequence[str], column: str, how=F.bit_xor) -> DataFrame:
    """(keys, column): aligned XOR (or OR, with ``how=F.bit_or``) of the vectors of each key.

    Words are aggregated by their number, in parts before the shuffle; a key gathers one value a word, however many rows it has.
    """
    each = df.select(*keys, F.posexplode(column).alias("_i", "_x")).groupBy(*keys, "_i").agg(how("_x").alias("_x"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"])
    return (each.groupBy(*keys) if keys else each).agg(listed.alias(column))


def alike(a: DataFrame, name_a: str, b: DataFrame, name_b: str) -> tuple[DataFrame, DataFrame]:
    """Both frames with masks of one kind: a BIGINT is a vector of one word."""
    kinds = Masks.of(a, name_a).words, Masks.of(b, name_b).words
    if kinds == (True, False):
        return a, b.withColumn(name_b, F.array(F.col(name_b).cast("bigint")))
    if kinds == (False, True):
        return a.withColumn(name_a, F.array(F.col(name_a).cast("bigint"))), b
    return a, b


@dataclass(frozen=True)
class Masks:
    """Row algebra of a mask column, BIGINT or words."""

    words: bool

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Masks:
        return cls(isinstance(df.schema[column].dataType, T.ArrayType))

    @property
    def type(self) -> str:
        return TYPE if self.words else "bigint"

    def zero(self) -> Column:
        return F.array().cast(TYPE) if self.words else F.lit(0).cast("bigint")

    def value(self, x: int | Sequence[int]) -> Column:
        """Constant, given as a number or, for words, as their list."""
        if not self.words:
            return F.lit(x).cast("bigint")
        if isinstance(x, int):
            return literal(x, max(1, -(-x.bit_length() // WORD)))
        return F.array(*[F.lit(w).cast("bigint") for w in x]).cast(TYPE)

    def xor(self, a: Column, b: Column) -> Column:
        return _aligned(a, b, lambda x, y: x.bitwiseXOR(y)) if self.words else a.bitwiseXOR(b)

    def both(self, a: Column, b: Column) -> Column:
        return _aligned(a, b, lambda x, y: x.bitwiseAND(y)) if self.words else a.bitwiseAND(b)

    def any(self, a: Column) -> Column:
        return F.exists(a, lambda x: x != 0) if self.words else a != 0

    def indices(self, a: Column, n_bits: int = NARROW) -> Column:
        every = F.sequence(F.lit(0), F.lit(n_bits - 1))
        return indices(a) if self.words else F.filter(every, lambda i: F.getbit(a, i) == 1)

    def xor_over(self, df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
        if self.words:
            return xor_by(df, keys, column)
        return (df.groupBy(*keys) if keys else df).agg(F.bit_xor(column).alias(column))
