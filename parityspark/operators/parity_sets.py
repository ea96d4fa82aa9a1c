"""Bit sets per shot kept as a base that all shots share plus each shot's difference from it.

A shot's set is the XOR of the base and its difference. Counting, masking and further XORs work on the differences and correct by the base
algebraically: toggling a bit that the base has removes it, any other adds it. The rows of the sets themselves, shots times base,
appear only in ``rows``, for results that are event lists.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parity import packs, unpacked, words, xor_items, xor_words


@dataclass(frozen=True)
class ParitySets:
    """``shots(shot_id)``, ``diff(shot_id, det)`` without repeats, ``base(det)`` without repeats."""

    shots: DataFrame
    diff: DataFrame
    base: DataFrame

    def xor(self, hits: DataFrame) -> ParitySets:
        """Sets with the bits ``hits(shot_id, det)`` toggled; repeats cancel."""
        toggled = xor_items(self.diff.select("shot_id", "det").unionByName(hits.select("shot_id", "det")), ["shot_id"], "det")
        return ParitySets(self.shots, toggled, self.base)

    def within(self, mask: DataFrame) -> ParitySets:
        """Only the bits in ``mask(det)``."""
        inside = mask.select("det").distinct()
        return ParitySets(self.shots, self.diff.join(inside, "det", "left_semi"), self.base.join(inside, "det", "left_semi"))

    def of(self, shots: DataFrame) -> ParitySets:
        """Only some of the shots."""
        return ParitySets(shots, self.diff.join(shots.select("shot_id"), "shot_id", "left_semi"), self.base)

    def _signed(self) -> DataFrame:
        """Differences with what each adds to its shot's count."""
        known = self.base.select("det", F.lit(-1).alias("_s"))
        return self.diff.join(known, "det", "left").select("shot_id", F.coalesce("_s", F.lit(1)).alias("_s"))

    def _base_size(self):
        return self.base.agg(F.count("*")).scalar()

    def sizes(self) -> DataFrame:
        """(shot_id, n): set bits of every shot, 0 included."""
        marked = self._signed().unionByName(self.shots.select("shot_id", F.lit(None).cast("int").alias("_s")))
        # A shot without its own row in ``shots`` is not counted.
        counted = marked.groupBy("shot_id").agg(F.coalesce(F.sum("_s"), F.lit(0)).alias("_d"), F.count_if(F.col("_s").isNull()).alias("_here"))
        return counted.filter("_here > 0").select("shot_id", (F.col("_d") + self._base_size()).alias("n"))

    def total(self) -> DataFrame:
        """One row (n): set bits of all shots together."""
        changed = self._signed().agg(F.coalesce(F.sum("_s"), F.lit(0))).scalar()
        return self.shots.agg(F.count("*").alias("_shots")).select((F.col("_shots") * self._base_size() + changed).alias("n"))

    def any(self) -> DataFrame:
        """Shots with at least one set bit."""
        return self.sizes().filter("n > 0").select("shot_id")

    def rows(self) -> DataFrame:
        """The sets as rows (shot_id, det): every shot meets the words of the base, dealt by hashed slots."""
        if packs(self.base, "det") and packs(self.diff, "det"):
            base = xor_words(words(self.base, [], "det"), [])
            asked = self._met(base, "_word").select("shot_id", "_word", "_bits")
            both = words(self.diff, ["shot_id"], "det").unionByName(asked)
            return unpacked(xor_words(both, ["shot_id"], dealt=True), ["shot_id"], "det", self.diff.schema["det"].dataType.simpleString())
        return xor_items(self.diff.select("shot_id", "det").unionByName(self._met(self.base, "det").select("shot_id", "det")), ["shot_id"], "det")

    def _met(self, base: DataFrame, key: str) -> DataFrame:
        """Every shot with every row of ``base``."""
        n = base.agg(F.count("*")).scalar()
        slot = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1))
        asked = self.shots.select("shot_id", F.explode(slot).alias("_slot"))
        return asked.join(base.withColumn("_slot", F.pmod(F.xxhash64(key), n)), "_slot")
