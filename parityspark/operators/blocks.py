"""Counters through nested repeat blocks, in closed form.

A counter (detector shift, coordinate shift, measurement count) at an instruction inside nested blocks is

    sum over levels of (counter before the block, within its parent) + iteration * (total of one body)

so rows get their value in the first iteration plus one increment per enclosing level. Nothing is unrolled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..ordered import MAX_WINDOW_GROUP, largest_group, running_sums


@dataclass(frozen=True)
class Unrolled:
    """``rows`` with ``mult`` (executions of each row), ``reps{L}``, ``open{L}`` (seq of the block's opening
    row), ``{c}_base`` (counter before the row in the first iteration) and ``{c}_step{L}`` per level L."""

    rows: DataFrame
    depth: int
    counters: tuple[str, ...]

    def value(self, counter: str, iteration) -> Column:
        """Counter at given iterations; ``iteration(L)`` is a column."""
        out = F.col(f"{counter}_base")
        for level in range(1, self.depth + 1):
            out = out + iteration(level) * F.col(f"{counter}_step{level}")
        return out

    def last(self, level: int) -> Column:
        return F.col(f"reps{level}") - 1

    def expanded(self) -> DataFrame:
        """One row per execution, with iteration columns ``i{L}`` and the execution ``path``."""
        rows = self.rows
        for level in range(1, self.depth + 1):
            rows = rows.withColumn(f"i{level}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"reps{level}") - 1)))
        path = []
        for level in range(1, self.depth + 1):
            path += [F.coalesce(F.col(f"open{level}"), F.col("seq")), F.col(f"i{level}")]
        return rows.withColumn("path", F.array(*path, F.col("seq")) if path else F.array("seq"))


def unroll(rows: DataFrame, key: str, counters: dict[str, Column]) -> Unrolled:
    """Follow ``counters`` through rows(key, seq, name, reps, ...) whose blocks open with ``reps`` and close with ``}``."""
    opens, closes = F.col("reps").isNotNull(), F.col("name") == "}"
    fits = largest_group(rows, [key]) <= MAX_WINDOW_GROUP
    if fits:
        return _unroll_in_windows(rows, key, counters)
    work = rows.withColumns({f"_c_{c}": v for c, v in counters.items()})
    work = running_sums(work, [key], ["seq"], {"_before": opens.cast("int") - closes.cast("int")}, fits=fits)
    work = work.withColumn("_lvl", F.least(F.col("_before"), F.col("_before") + opens.cast("int") - closes.cast("int")))
    depth = int(work.agg(F.max("_lvl")).first()[0] or 0)
    levels = range(1, depth + 1)
    original = [c for c in rows.columns]

    if depth:
        starts = {level: (opens & (F.col("_lvl") == level - 1)).cast("int") for level in levels}
        work = running_sums(work, [key], ["seq"], {f"_o{level}": s for level, s in starts.items()}, fits=fits)
        # Every level joins the rows with a few of themselves; materialise them once instead of per branch.
        work = cut(work.withColumns({f"_o{level}": F.col(f"_o{level}") + s for level, s in starts.items()}), "blocks")
        for level in levels:
            block = work.filter(starts[level] == 1).select(key, f"_o{level}", F.col("reps").alias(f"_reps{level}"))
            work = work.join(block, [key, f"_o{level}"], "left").withColumn(
                f"_reps{level}", F.when(F.col("_lvl") >= level, F.col(f"_reps{level}")).otherwise(F.lit(1).cast("bigint"))
            )

    def reps_below(level: int) -> Column:
        out = F.lit(1).cast("bigint")
        for deeper in range(level + 1, depth + 1):
            out = out * F.col(f"_reps{deeper}")
        return out

    sums = {f"_r_{c}_{level}": F.col(f"_c_{c}") * reps_below(level) for c in counters for level in range(depth + 1)}
    work = running_sums(work, [key], ["seq"], sums, fits=fits)
    if depth:
        work = cut(work, "block-sums")
    for level in levels:
        edge = F.col("_lvl") == level - 1
        aggs = [F.max(F.when(opens, F.col("seq"))).alias(f"open{level}")]
        for c in counters:
            aggs += [
                F.max(F.when(opens, F.col(f"_r_{c}_{level - 1}"))).alias(f"_p_{c}_{level}"),
                F.max(F.when(opens, F.col(f"_r_{c}_{level}"))).alias(f"_q_{c}_{level}"),
                F.max(F.when(closes, F.col(f"_r_{c}_{level}"))).alias(f"_end_{c}_{level}"),
            ]
        bounds = work.filter(edge & (opens | closes)).groupBy(key, f"_o{level}").agg(*aggs)
        work = work.join(bounds, [key, f"_o{level}"], "left").withColumn(
            f"open{level}", F.when(F.col("_lvl") >= level, F.col(f"open{level}"))
        )

    return _placed(work, original, depth, counters, reps_below)


def _unroll_in_windows(rows: DataFrame, key: str, counters: dict[str, Column]) -> Unrolled:
    """``unroll`` where each key's rows fit a task: one shuffle, and what a block knows of its ends reaches its rows through windows, without joins."""
    opens, closes = F.col("reps").isNotNull(), F.col("name") == "}"
    turn = opens.cast("int") - closes.cast("int")
    ahead = Window.partitionBy(key).orderBy("seq")
    earlier, so_far = ahead.rowsBetween(Window.unboundedPreceding, -1), ahead.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    to_come = Window.partitionBy(key).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = lambda df, values: df.withColumns({n: F.coalesce(F.sum(v).over(earlier), F.lit(0)) for n, v in values.items()})
    levelled = lambda df: sums(df, {"_before": turn}).withColumn("_lvl", F.least(F.col("_before"), F.col("_before") + turn))
    # Only the ends of blocks change the level, which is highest behind an opening.
    ends = sums(rows.filter(opens | closes).select(key, "seq", "reps", "name"), {"_before": turn})
    depth = max(int(ends.agg(F.max(F.col("_before") + turn)).first()[0] or 0), 0)
    levels = range(1, depth + 1)
    starts = {level: opens & (F.col("_lvl") == level - 1) for level in levels}
    inside = {level: F.col("_lvl") >= level for level in levels}
    # The block that a row is in is the last one opened at that level.
    opened = lambda level, value: F.last(F.when(starts[level], value), ignorenulls=True).over(so_far)
    work = levelled(rows.withColumns({f"_c_{c}": v for c, v in counters.items()}))
    one = F.lit(1).cast("bigint")
    work = work.withColumns({f"_reps{level}": opened(level, F.col("reps")) for level in levels})
    work = work.withColumns({f"_reps{level}": F.when(inside[level], F.col(f"_reps{level}")).otherwise(one) for level in levels})

    def reps_below(level: int) -> Column:
        out = one
        for deeper in range(level + 1, depth + 1):
            out = out * F.col(f"_reps{deeper}")
        return out

    work = sums(work, {f"_r_{c}_{level}": F.col(f"_c_{c}") * reps_below(level) for c in counters for level in range(depth + 1)})
    begun, ended = {f"open{level}": opened(level, F.col("seq")) for level in levels}, {}
    for level in levels:
        end = closes & (F.col("_lvl") == level - 1)
        for c in counters:
            begun[f"_p_{c}_{level}"] = opened(level, F.col(f"_r_{c}_{level - 1}"))
            begun[f"_q_{c}_{level}"] = opened(level, F.col(f"_r_{c}_{level}"))
            ended[f"_end_{c}_{level}"] = F.last(F.when(end, F.col(f"_r_{c}_{level}")), ignorenulls=True).over(to_come)
    work = work.withColumns(begun).withColumns(ended)
    return _placed(work, rows.columns, depth, counters, reps_below)


def _placed(work: DataFrame, columns: list[str], depth: int, counters: dict[str, Column], reps_below) -> Unrolled:
    """Base and steps of every counter from the sums before a row, at its blocks' openings (_p, _q) and at their ends."""
    levels = range(1, depth + 1)
    opened = [F.when(F.col("_lvl") >= level, F.col(f"open{level}")).alias(f"open{level}") for level in levels]
    out: dict[str, Column] = {"mult": reps_below(0)}
    for level in levels:
        out[f"reps{level}"] = F.col(f"_reps{level}")
    for c in counters:
        own = F.coalesce(*[
            F.when(F.col("_lvl") == level, F.col(f"_r_{c}_{level}") - (F.col(f"_q_{c}_{level}") if level else F.lit(0)))
            for level in range(depth + 1)
        ])
        base = own
        for level in levels:
            entry = F.col(f"_p_{c}_{level}") - (F.col(f"_q_{c}_{level - 1}") if level > 1 else F.lit(0))
            inside = F.col("_lvl") >= level
            base = base + F.when(inside, entry).otherwise(F.lit(0))
            out[f"{c}_step{level}"] = F.when(inside, F.col(f"_end_{c}_{level}") - F.col(f"_q_{c}_{level}")).otherwise(F.lit(0))
        out[f"{c}_base"] = base
    return Unrolled(work.select(*columns, *opened, *[v.alias(k) for k, v in out.items()]), depth, tuple(counters))
