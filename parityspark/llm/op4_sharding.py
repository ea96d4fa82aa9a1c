"""Sharding by minimax contiguous partition.

Equal texts form atomic groups, ordered by the MD5 of their text. The contiguous cut into shards whose largest shard is
smallest is found by binary search over the capacity: a capacity is feasible if filling shards greedily needs no more than
their number. The driver never holds all groups: it works on units, runs of neighbouring groups given by their count, size and
largest group. Taking units as unbreakable gives a capacity that surely works, taking those of several groups as
divisible gives one below which nothing works; the units in which a cut may fall between the two are then broken up by
the next digits of the hash, until both agree. Only their sums are fetched, so memory follows the units near cuts.

Null text forms a group of its own, of size 1 a row, ordered first. Repeated rows are rows of their own. Rows are numbered inside
a shard in the order of group, doc_id. Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, drop
from ..ordered import global_index

SHARDS = 16
DIGITS = 3  # hex digits of the group key that each refinement looks at
KEY_DIGITS = 33  # one leading digit (0 for null, 1 else) and the MD5


def group_key(text: Column) -> Column:
    return F.when(text.isNull(), F.lit("0" * KEY_DIGITS)).otherwise(F.concat(F.lit("1"), F.md5(text.cast("binary"))))


def row_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


@dataclass(frozen=True)
class Unit:
    """Neighbouring groups whose keys begin with ``prefix``."""

    prefix: str
    size: int
    groups: int
    largest: int

    @property
    def atomic(self) -> bool:
        return self.groups == 1


def fill(units: list[Unit], capacity: int, shards: int, divisible: bool) -> list[tuple[int, int]] | None:
    """Greedy cuts as (unit number, size of the shard's first part inside that unit), or None if ``capacity`` is too small.

    Every cut stands before the unit, or, where units of several groups are divisible, inside it.
    """
    cuts, room = [], capacity
    for i, u in enumerate(units):
        if u.size <= room:
            room -= u.size
            continue
        if u.largest > capacity:
            return None
        rest = u.size
        if divisible and not u.atomic:
            while rest > room:
                rest -= room
                cuts.append((i, u.size - rest))
                room = capacity
                if len(cuts) >= shards:
                    return None
        else:
            if rest > capacity:
                return None
            cuts.append((i, 0))
            room = capacity
            if len(cuts) >= shards:
                return None
        room -= rest
    return cuts


def smallest(units: list[Unit], shards: int, divisible: bool) -> int:
    """The smallest feasible capacity, by binary search."""
    low, high = 0, sum(u.size for u in units)
    while low < high:
        mid = (low + high) // 2
        if fill(units, mid, shards, divisible) is None:
            low = mid + 1
        else:
            high = mid
    return low


def near_cuts(units: list[Unit], low: int, high: int, shards: int) -> set[int]:
    """Units of several groups in which a greedy cut may fall for a capacity from ``low`` to ``high``."""
    starts = [0]
    for u in units:
        starts.append(starts[-1] + u.size)
    total, out = starts[-1], set()
    first = last = 0  # where the k-th cut stands, at least and at most
    for _ in range(shards):
        last = min(total, last + high)
        # A unit that straddles the earliest cut may push it back by as much as its largest group.
        reach = first + low
        i = _at(starts, reach)
        first = min(reach, total) if i >= len(units) else max(first, min(reach, starts[i]) if units[i].atomic else reach - units[i].largest)
        for k in range(_at(starts, first), min(len(units), _at(starts, last) + 1)):
            if not units[k].atomic:
                out.add(k)
    return out


def _at(starts: list[int], place: int) -> int:
    from bisect import bisect_right

    return bisect_right(starts, place) - 1


def units_of(groups: DataFrame, prefixes: list[str] | None, digits: int) -> list[Unit]:
    """Sums of the groups by the first ``digits`` digits of their key, within some prefixes of one length."""
    if prefixes is not None:
        groups = groups.filter(F.substring("key", 1, len(prefixes[0])).isin(prefixes))
    rows = groups.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("size").alias("largest")).collect()
    return sorted((Unit(r.prefix, r.size, r.n, r.largest) for r in rows), key=lambda u: u.prefix)


def minimax_cuts(groups: DataFrame, shards: int = SHARDS, digits: int = DIGITS) -> tuple[int, list[str]]:
    """Smallest capacity and the key prefixes before which the shards after the first begin, for rows (key, size)."""
    units = units_of(groups, None, digits + 1)
    while True:
        low, high = smallest(units, shards, True), smallest(units, shards, False)
        near = near_cuts(units, low, high, shards) if low < high else set()
        if low == high or not near:
            break
        finer: dict[int, list[Unit]] = {}
        for length in {len(units[k].prefix) for k in near}:
            some = [k for k in near if len(units[k].prefix) == length]
            parts = units_of(groups, [units[k].prefix for k in some], min(length + digits, KEY_DIGITS))
            for k in some:
                finer[k] = [p for p in parts if p.prefix.startswith(units[k].prefix)]
        units = [x for k, u in enumerate(units) for x in finer.get(k, [u])]
    return high, [units[i].prefix for i, _ in fill(units, high, shards, False)]


def shard_of(key: Column, starts: list[str]) -> Column:
    out = F.lit(0)
    for s in starts:
        out = out + (key >= s).cast("int")
    return out


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row: equal texts together, the largest shard as small as it can be."""
    text = F.col("text")
    rows = cut(docs.select("doc_id", row_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), group_key(text).alias("key")), "rows")
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    _, starts = minimax_cuts(groups, shards)
    drop(groups)
    numbered = global_index(rows.withColumn("shard", shard_of(F.col("key"), starts)), ["key", "doc_id", "text_crc32"], "place")
    first = {r.shard: r["count"] for r in numbered.groupBy("shard").count().collect()}
    before, offset = 0, F.lit(0).cast("long")
    for s in range(shards):
        offset = F.when(F.col("shard") == s, F.lit(before).cast("long")).otherwise(offset)
        before += first.get(s, 0)
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - offset).alias("slot"))
