"""Order-dependent selections and round windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ordered import running_sums
from .parity import xor_items


def truncate_at_k_errors(log: DataFrame, k: int) -> DataFrame:
    """Trials up to and including the k-th error of each task, in shot order (WIN4)."""
    counted = running_sums(log, ["task_id"], ["shot_id"], {"_before": F.col("is_error").cast("int")})
    return counted.filter(F.col("_before") < k).drop("_before")


def limit_collection(batches: DataFrame, max_shots: int | None, max_errors: int | None, errors: str = "errors") -> DataFrame:
    """Batches a task accepts before either limit is met; ``errors`` names the counted column (WIN5)."""
    counted = running_sums(batches, ["strong_id"], ["seq"], {"_s": F.col("shots"), "_e": F.col(errors)})
    if max_shots is not None:
        counted = counted.filter(F.col("_s") < max_shots)
    if max_errors is not None:
        counted = counted.filter(F.col("_e") < max_errors)
    return counted.drop("_s", "_e")


def round_differences(bits: DataFrame, n_rounds: int) -> DataFrame:
    """Detection events of repeated checks: each bit XOR the same check one round earlier (WIN6).

    A set bit flips its own round and the next one; parity of these flips needs no ordering.
    """
    flips = bits.select("shot_id", "check", F.explode(F.array(F.col("round_id"), F.col("round_id") + 1)).alias("round_id"))
    return xor_items(flips.filter(F.col("round_id") < n_rounds), ["shot_id", "check"], "round_id", dealt=True)


def assign_windows(hits: DataFrame, commit: int, window: int) -> DataFrame:
    """Every window covering a hit's round, and whether the hit is in the window's commit region (WIN7)."""
    return covering_windows(hits, commit, window)


def covering_windows(rows: DataFrame, commit: int, window: int, outer: bool = False) -> DataFrame:
    """Rows with a ``round_id``, once for every window that covers it; ``outer`` keeps rows in no window, with a NULL one."""
    r = F.col("round_id")
    first = F.greatest(F.lit(0), F.ceil((r - window + 1) / commit).cast("int"))
    last = F.floor(r / commit).cast("int")
    explode = F.explode_outer if outer else F.explode
    covered = rows.withColumn("win", explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    return covered.withColumn("in_commit", r < F.col("win") * commit + commit)


def grid_to_detector(bits: DataFrame, n_checks: int) -> DataFrame:
    """Fired cells of a check-by-step table as linear detector numbers; checks must fit the grid (WIN11)."""
    size = F.when(F.col("check") >= n_checks, F.raise_error(F.lit("check number outside the grid")).cast("int")).otherwise(F.col("check"))
    return bits.filter(F.col("bit") == 1).select("shot_id", (F.col("step") * n_checks + size).cast("int").alias("det"))
