"""Order-dependent sums and ranks that stay distributed when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

# Largest group one window task is asked to sort; above it the range-partitioned form takes over.
MAX_WINDOW_GROUP = 5_000_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest group (partial counts are combined before the shuffle)."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _range_staged(df: DataFrame, by: Sequence[str]) -> DataFrame:
    # Range partitioning on (keys, order) splits a hot key over many tasks; _row then orders all rows.
    staged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id())
    return cut(staged, "ordered").withColumn("_part", F.shiftrightunsigned("_row", 33))


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    max_group: int = MAX_WINDOW_GROUP,
    fits: bool | None = None,
) -> DataFrame:
    """Add, per row, the sum of each expression over the earlier rows of its key (0 for the first row).

    Groups known to fit one task use an ordinary window. Otherwise rows are range partitioned by
    (keys, order), each partition's totals are summed up per key, and every row adds the total of the
    partitions before it to a running sum inside its own partition. ``fits`` passes on the answer of an
    earlier size check of the same groups.
    """
    keys, order = list(keys), list(order)
    if fits is None:
        fits = largest_group(df, keys) <= max_group
    if fits:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()})

    staged = _range_staged(df.withColumns({f"_v_{n}": c for n, c in sums.items()}), keys + order)
    totals = staged.groupBy(*keys, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_part", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = Window.partitionBy(*keys, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    local = staged.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in sums})
    return local.join(offsets, [*keys, "_part"]).select(
        *df.columns, *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in sums]
    )


def global_index(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Zero-based position of every row in the order of ``order``, without a one-task sort."""
    staged = _range_staged(df, list(order))
    counts = staged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    # One row per partition of the staged table.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return staged.join(offsets, "_part").select(
        *df.columns, (F.col("_row") - F.col("_first") + F.col("_off")).alias(name)
    )
