"""Parity (XOR) algebra over long tables of bits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_INF = float("inf")


def xor_reduce(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keep the key combinations that occur an odd number of times (AGG1).

    Counts are combined map-side, so a key combination repeated a billion times costs one row per task.
    """
    return hits.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") % 2 == 1).drop("_n")


#: Items in a word of ``packed``; half a BIGINT, so that no word is negative.
WORD = 5
_INTEGERS = ("tinyint", "smallint", "int", "bigint")


def packs(hits: DataFrame, item: str) -> bool:
    """Can the items be bits of words?"""
    return hits.schema[item].dataType.simpleString() in _INTEGERS


def words(hits: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Rows (keys, _word, _bits): every integer item as one bit of the word of its 32 neighbours; NULL has a word of its own."""
    at = F.pmod(F.col(item), F.lit(1 << WORD)).cast("int")
    bit = F.when(F.col(item).isNull(), F.lit(1)).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), at))
    return hits.select(*keys, F.shiftright(item, WORD).alias("_word"), bit.cast("bigint").alias("_bits"))


def xor_words(packed: DataFrame, keys: Sequence[str], dealt: bool = False) -> DataFrame:
    """Words that are not 0 after the XOR of all words of the same place.

    ``dealt`` is for rows of which few share a place, by the nature of the table: they go to their places first, as adding
    up before the shuffle would fill every task with a table of all its rows and save none of them.
    """
    packed = packed.repartition(*keys, "_word") if dealt else packed
    return packed.groupBy(*keys, "_word").agg(F.bit_xor("_bits").alias("_bits")).filter("_bits <> 0")


def unpacked(packed: DataFrame, keys: Sequence[str], item: str, kind: str) -> DataFrame:
    """The items of words as rows (keys, item)."""
    m = F.col("_bits")
    # From the lowest to the highest set bit.
    at = F.sequence(F.bit_count(m.bitwiseXOR(m - 1)) - 1, F.length(F.bin(m)) - 1)
    rows = packed.select(*keys, "_word", "_bits", F.explode(at).alias("_at")).filter(F.getbit("_bits", "_at") == 1)
    return rows.select(*keys, (F.col("_word") * (1 << WORD) + F.col("_at")).cast(kind).alias(item))


def toggles(hits: DataFrame, effects: DataFrame, on: str, keys: Sequence[str], item: str) -> DataFrame:
    """Words (shot_id, keys, _word, _bits) toggled by a shot's hits: ``effects(on, keys, item)`` lists what each of them toggles.

    An effect's own repeats cancel once, before the join, and its items stay words through it.
    """
    net = xor_words(words(effects, [on, *keys], item), [on, *keys])
    return hits.join(net, on).select("shot_id", *keys, "_word", "_bits")


def xor_items(hits: DataFrame, keys: Sequence[str], item: str, dealt: bool = False) -> DataFrame:
    """``xor_reduce`` over (keys, item) that holds one row per 32 neighbouring items of a key instead of one per item.

    A task's hash table then grows with the keys and not with their hits. Items that are not integers are counted.
    """
    if not packs(hits, item):
        return xor_reduce(hits, [*keys, item])
    return unpacked(xor_words(words(hits, keys, item), keys, dealt), keys, item, hits.schema[item].dataType.simpleString())


def xor_sets(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Symmetric difference of two bit tables (SET2); the last key is the item."""
    return xor_items(a.select(*keys).unionByName(b.select(*keys)), keys[:-1], keys[-1])


def xor_probability(p: Column) -> Column:
    """Aggregate: probability that an odd number of independent events happen (AGG2)."""
    return F.lit(0.5) * (F.lit(1.0) - F.product(F.lit(1.0) - F.lit(2.0) * p))


def _log_tanh_half(x: Column) -> Column:
    # -ln(tanh(x/2)), its own inverse on x > 0.
    return F.when(x <= 0, F.lit(_INF)).when(x > 700, F.lit(2.0) * F.exp(-x)).otherwise(
        F.log1p(F.lit(2.0) / F.expm1(F.when((x > 0) & (x <= 700), x).otherwise(F.lit(1.0))))
    )


def merge_weights(w: Column) -> Column:
    """Aggregate: log-odds weight of the XOR of independent edges with log-odds weights ``w`` (AGG4).

    With weight w, 1 - 2p = tanh(w/2); products of tanh become sums of -ln tanh, which keep full
    precision when the weights are large and the probabilities vanish.
    """
    magnitude = _log_tanh_half(F.sum(_log_tanh_half(F.abs(w))))
    return F.when(F.sum(F.when(w < 0, 1).otherwise(0)) % 2 == 1, -magnitude).otherwise(magnitude)


def merge_weights_pair(a: Column, b: Column) -> Column:
    """The same merge for two columns of one row."""
    head = F.signum(a) * F.signum(b) * F.least(F.abs(a), F.abs(b))
    return head + F.log1p(F.exp(-F.abs(a + b))) - F.log1p(F.exp(-F.abs(a - b)))


def canonical_targets(targets: DataFrame, key: str) -> DataFrame:
    """Sorted target list of each mechanism with repeated targets cancelled (SRT3).

    After cancellation a list holds at most every detector and observable of the model once.
    """
    return (
        xor_reduce(targets, [key, "kind", "idx"])
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("kind", "idx"))).alias("targets"))
    )


def targets_text(targets: Column) -> Column:
    return F.array_join(F.transform(targets, lambda t: F.concat(t["kind"], t["idx"].cast("string"))), " ")


def is_subset(a: DataFrame, b: DataFrame, key: str, item: str) -> DataFrame:
    """For every key of ``a``: are all its items among the items of ``b`` under that key (SET3)?"""
    if packs(a, item) and packs(b, item):
        both = words(a, [key], item).select(key, "_word", F.col("_bits").alias("_a"), F.lit(0).cast("bigint").alias("_b")).unionByName(
            words(b, [key], item).select(key, "_word", F.lit(0).cast("bigint").alias("_a"), F.col("_bits").alias("_b"))
        )
        # Each side is a set: at most 64 rows share a place.
        per_word = both.repartition(key, "_word").groupBy(key, "_word").agg(F.bit_or("_a").alias("_a"), F.bit_or("_b").alias("_b")).filter("_a <> 0")
        return per_word.groupBy(key).agg(F.bool_and(F.col("_a").bitwiseAND(F.col("_b")) == F.col("_a")).alias("is_subset"))
    marked = a.select(key, item, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(key, item, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    per_item = marked.groupBy(key, item).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return (
        per_item.filter("_a = 1").groupBy(key).agg(F.bool_and(F.col("_b") == 1).alias("is_subset"))
    )


def bit_columns_xor(dense: DataFrame, masks: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Column-wise XOR of packed masks and the popcount of the result (AGG21)."""
    aggs = [F.bit_xor(m).alias(f"{m}_xor") for m in masks]
    out = dense.groupBy(*keys).agg(*aggs) if keys else dense.agg(*aggs)
    return out.withColumns({f"{m}_ones": F.bit_count(f"{m}_xor") for m in masks})
