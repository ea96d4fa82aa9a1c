"""Sampler plug-ins: user code that returns statistics for a number of shots of a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import combine_stats

_SAMPLERS: dict[str, Callable[[dict, int, int], tuple[int, int, int, float]]] = {}


def register_sampler(name: str, fn: Callable[[dict, int, int], tuple[int, int, int, float]]) -> None:
    """Make a sampler available (UDF2): ``fn(task, first_shot, n_shots)`` gives (shots, errors, discards, seconds)."""
    _SAMPLERS[name] = fn


def sample_tasks(tasks: DataFrame, name: str, chunk: int = 1_000_000) -> DataFrame:
    """Run a sampler for every task's ``max_shots`` and fold the results.

    A task is cut into chunks of shots that run as separate rows, so one very long task spreads over the
    cluster.
    """
    fn = _SAMPLERS[name]
    pieces = tasks.filter("max_shots > 0").withColumn("_first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("max_shots") - 1, F.lit(chunk).cast("bigint"))))
    pieces = pieces.withColumn("_n", F.least(F.lit(chunk), F.col("max_shots") - F.col("_first")))
    spread = pieces.repartition(4 * tasks.sparkSession.sparkContext.defaultParallelism, "strong_id", "_first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for task in pdf.to_dict("records"):
                out.append((task["strong_id"], task["decoder"], *fn(task, int(task.pop("_first")), int(task.pop("_n")))))
            yield pd.DataFrame(out, columns=["strong_id", "decoder", "shots", "errors", "discards", "seconds"])

    stats = spread.mapInPandas(run, "strong_id string, decoder string, shots bigint, errors bigint, discards bigint, seconds double")
    return combine_stats(stats)
