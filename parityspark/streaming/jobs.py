"""Structured Streaming jobs.

Jobs without cross-row order run the batch operators on each micro-batch and replace the folder of that
batch id, so a repeated batch leaves one result. Running totals use Spark's own stateful aggregation, whose current
values are read from the state store and not from what the batches wrote. The stop rule keeps the budgets of a group of tasks
in keyed state, the round buffer the open windows of a block of shots.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import events as ev
from ..operators import stats as st
from ..operators import windows as wn
from ..shipping import ship

#: Keyed state with several variables needs this store.
KEYED_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_available(
    stream: DataFrame, outputs: Callable[[DataFrame, int], dict[str, DataFrame]], sink: str, checkpoint: str, mode: str = "append",
    reread: bool = False, conf: dict[str, str] | None = None,
) -> None:
    """Process what has arrived, one result folder per output and batch id, and stop; the checkpoint resumes.

    ``reread`` keeps a batch that its outputs scan several times, so the stream's plan runs once. ``conf`` holds while the query runs;
    the checkpoint remembers its state store.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        if reread:
            batch.persist(StorageLevel.DISK_ONLY)
        for name, df in outputs(batch, batch_id).items():
            df.write.mode("overwrite").parquet(f"{sink}/{name}/batch={batch_id}")
        if reread:
            batch.unpersist()

    before = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    try:
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def results(spark: SparkSession, sink: str, name: str) -> DataFrame:
    """All rows an output has received, with their batch id."""
    return spark.read.parquet(f"{sink}/{name}")


def latest(spark: SparkSession, sink: str, name: str, key: list[str]) -> DataFrame:
    """Last row written per key. Reads all batches; for running totals see ``current_sums``."""
    rows = results(spark, sink, name)
    rest = [c for c in rows.columns if c not in (*key, "batch")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*key, "_r.*")


def current_sums(spark: SparkSession, checkpoint: str, names: list[str]) -> DataFrame:
    """Keys and sums of a stream's aggregation as its state store holds them after the last batch.

    The store has one row a key, so the cost does not grow with the number of batches. ``names`` are the sums in their order.
    """
    state = spark.read.format("statestore").load(checkpoint)
    # Buffers of several sums share their names, so they are numbered first; some sums keep a second one that says whether they are empty.
    keys, value = state.schema["key"].dataType.fieldNames(), state.schema["value"].dataType
    numbered = T.StructType([T.StructField(f"_{i}", f.dataType) for i, f in enumerate(value.fields)])
    sums = [f"_{i}" for i, f in enumerate(value.fields) if not f.name.lower().startswith("isempty")]
    state = state.select("key", F.col("value").cast(numbered).alias("value"))
    return state.select(*[F.col(f"key.{k}").alias(k) for k in keys], *[F.col(f"value.{c}").alias(n) for c, n in zip(sums, names, strict=True)])


def stream_m2d(meas: DataFrame, det_def: DataFrame, expected: DataFrame | None, sink: str, checkpoint: str) -> None:
    """Detection events of a stream with one row per shot (shot_id, meas array); nothing crosses batches (STR1)."""

    def events(batch: DataFrame, _: int) -> dict[str, DataFrame]:
        return {"events": ev.measurements_to_events(batch, batch.select("shot_id", F.explode("meas").alias("meas")), det_def, expected)}

    run_available(meas, events, sink, checkpoint, reread=True)


def stream_postselect(shots: DataFrame, mask: DataFrame, sink: str, checkpoint: str) -> None:
    """Split a stream of shots (shot_id, dets array) into a kept and a dropped sink (STR2)."""

    def split(batch: DataFrame, _: int) -> dict[str, DataFrame]:
        parts = ev.postselect_shots(batch, batch.select("shot_id", F.explode("dets").alias("det")), mask)
        return {"kept": parts["kept_shots"], "dropped": parts["dropped_shots"]}

    run_available(shots, split, sink, checkpoint, reread=True)


def _running_totals(stats: DataFrame) -> DataFrame:
    """Totals per (id, count name); the row without a name holds the statistic's own sums."""
    total = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("bigint").alias("n"))
    counts = F.transform(F.map_entries("custom_counts"), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("n")))
    long = stats.withColumn("_c", F.explode(F.concat(F.array(total), counts)))
    own = F.col("_c.name").isNull()
    return long.groupBy("strong_id", F.coalesce("_c.name", F.lit("")).alias("name")).agg(
        *[F.sum(F.when(own, F.col(c))).alias(c) for c in ("shots", "errors", "discards", "seconds")], F.sum("_c.n").alias("n")
    )


def stream_combine(stats: DataFrame, sink: str, checkpoint: str) -> None:
    """Running totals per strong id; each batch writes the ids it changed, and the checkpoint is the resume (STR3)."""
    run_available(_running_totals(stats), lambda batch, _: {"totals": batch}, sink, checkpoint, mode="update")


def combined(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Current totals of ``stream_combine`` as task statistics, read from its state."""
    sums = ["shots", "errors", "discards", "seconds"]
    rows = current_sums(spark, checkpoint, [*sums, "n"]).toDF("strong_id", "name", *sums, "n")
    kept = F.when((F.col("name") != "") & (F.col("n") > 0), F.struct("name", "n"))
    return rows.groupBy("strong_id").agg(
        *[F.sum(c).alias(c) for c in sums], F.map_from_entries(F.array_sort(F.collect_list(kept))).alias("custom_counts"),
    )


#: Groups of tasks, by hash, that share a state of the stop rule. Fixed, as a checkpoint keeps them.
TASK_GROUPS = 4096


class StopRule(StatefulProcessor):
    """Used budgets of a group of tasks as one value state; accepts each task's rows in order of ``seq`` while both limits are unmet.

    One call serves all tasks of the group that a batch touches, on arrays sorted by task and ``seq``.
    """

    def __init__(self, max_shots: int | None, max_errors: int | None):
        self.most = tuple(np.iinfo(np.int64).max if m is None else m for m in (max_shots, max_errors))

    def init(self, handle) -> None:
        self.used = handle.getValueState("used", "tasks array<string>, shots array<bigint>, errors array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.used.get()
        tasks, *used = ([], [], []) if old is None else (list(x) for x in old)
        new = pd.concat(list(rows), ignore_index=True)
        named, touched = pd.factorize(new["strong_id"], use_na_sentinel=False)
        touched = [None if pd.isna(t) else t for t in touched]
        place = {t: i for i, t in enumerate(tasks)}
        tasks += [t for t in touched if t not in place]
        place = {t: i for i, t in enumerate(tasks)}
        used = [np.concatenate([np.asarray(u, np.int64), np.zeros(len(tasks) - len(u), np.int64)]) for u in used]
        at = np.asarray([place[t] for t in touched])[named]
        seq, *counts = (new[c].to_numpy(np.int64) for c in ("seq", "shots", "errors"))
        order = np.lexsort((seq, at))
        at, seq, counts = at[order], seq[order], [c[order] for c in counts]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        lengths = np.diff(np.append(first, len(at)))
        # What came before a row: its task's earlier rows, and what the task had used.
        earlier = lambda c: (t := np.cumsum(c) - c) - np.repeat(t[first], lengths)
        met = np.logical_or.reduce([u[at] + earlier(c) >= m for u, c, m in zip(used, counts, self.most, strict=True)])
        taken = (earlier(met.astype(np.int64)) == 0) & ~met
        for u, c in zip(used, counts, strict=True):
            np.add.at(u, at[taken], c[taken])
        self.used.update((tasks, *[u.tolist() for u in used]))
        names = np.asarray(tasks, object)
        yield pd.DataFrame({"strong_id": names[at[taken]], "seq": seq[taken], "shots": counts[0][taken], "errors": counts[1][taken], "budget": False})
        yield pd.DataFrame({"strong_id": names[at[first]], "seq": -1, "shots": used[0][at[first]], "errors": used[1][at[first]], "budget": True})

    def close(self) -> None:
        pass


def stream_stop_rule(batches: DataFrame, max_shots: int | None, max_errors: int | None, sink: str, checkpoint: str) -> None:
    """Accept each task's batches (strong_id, seq, shots, errors) until a limit is met and ignore the rest (STR4).

    Writes ``accepted`` rows and, for every task that a batch touched, its remaining ``budgets``. The rows that one trigger brings for a group of
    tasks meet in one place, as arrays of numbers; the source's maxFilesPerTrigger or maxBytesPerTrigger bounds them.
    """
    ship(batches.sparkSession)
    rows = batches.select(*[F.col(c).cast(t).alias(c) for c, t in (("strong_id", "string"), ("seq", "bigint"), ("shots", "bigint"), ("errors", "bigint"))])
    grouped = rows.withColumn("tasks", F.pmod(F.xxhash64("strong_id"), F.lit(TASK_GROUPS)).cast("int")).groupBy("tasks")
    ruled = grouped.transformWithStateInPandas(StopRule(max_shots, max_errors), "strong_id string, seq bigint, shots bigint, errors bigint, budget boolean", "update", "none")

    def split(batch: DataFrame, _: int) -> dict[str, DataFrame]:
        used = batch.filter("budget").select("strong_id", F.col("shots").alias("shots_used"), F.col("errors").alias("errors_used"))
        return {"accepted": batch.filter("NOT budget").drop("budget"), "budgets": budget_left(used, max_shots, max_errors)}

    run_available(ruled, split, sink, checkpoint, mode="update", reread=True, conf=KEYED_STORE)


def budget_left(used: DataFrame, max_shots: int | None, max_errors: int | None) -> DataFrame:
    """(strong_id, shots_left, errors_left): never below 0, NULL without a limit."""
    left = [F.greatest(F.lit(m).cast("bigint") - F.col(u), F.lit(0).cast("bigint")) if m is not None else F.lit(None).cast("bigint") for m, u in ((max_shots, "shots_used"), (max_errors, "errors_used"))]
    return used.select("strong_id", left[0].alias("shots_left"), left[1].alias("errors_left"))


def budgets(spark: SparkSession, checkpoint: str, max_shots: int | None, max_errors: int | None) -> DataFrame:
    """Remaining budget of every task that ``stream_stop_rule`` has seen, read from its state."""
    state = spark.read.format("statestore").option("stateVarName", "used").load(checkpoint)
    each = state.select(F.explode(F.arrays_zip("value.tasks", "value.shots", "value.errors")).alias("u"))
    return budget_left(each.select(F.col("u.tasks").alias("strong_id"), F.col("u.shots").alias("shots_used"), F.col("u.errors").alias("errors_used")), max_shots, max_errors)


#: Neighbouring shots that share a state of the round buffer, and so a call and its array operations.
SHOT_BLOCK = 1024


def _placed(values: np.ndarray, known: np.ndarray, ids: np.ndarray, empty: int) -> np.ndarray:
    """Values of the ids already known, among all ids; ``empty`` for the rest."""
    out = np.full(len(ids), empty, np.int64)
    out[np.searchsorted(ids, known)] = values
    return out


def stream_windowed_rounds(rounds: DataFrame, commit: int, window: int, delay: str, patience_ms: int, sink: str, checkpoint: str) -> None:
    """Emit each shot's windows as its rounds complete; a round older than the committed ones goes to ``late`` (STR5).

    ``rounds(shot_id, round_id, dets array, ts)``. A shot is closed ``patience_ms`` after its last round in
    event time. Windows are numbered in columns before the state (WIN7). A state holds SHOT_BLOCK neighbouring shots, each with its own
    progress and end, and the hits of their open windows as arrays: one call serves a block, so calls do not grow with the shots.
    """

    def buffer(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Open shots of the block in order of their ids, then the hits of open windows.
        held = state.get if state.exists else [[]] * 8
        ids, done, top, due, *hits = (np.asarray(x, kind) for x, kind in zip(held, (*[np.int64] * 7, bool), strict=True))
        now = state.getCurrentWatermarkMs()
        late = np.zeros((2, 0), np.int64)
        if state.hasTimedOut:
            met = np.zeros(len(ids), bool)
        else:
            new = pd.concat(list(batches), ignore_index=True)
            shot, round_id = new["shot_id"].to_numpy(np.int64), new["round_id"].to_numpy(np.int64)
            known, ids = ids, np.union1d(ids, shot)
            done, top, due = (_placed(x, known, ids, empty) for x, empty in ((done, 0), (top, -1), (due, 0)))
            at = np.searchsorted(ids, shot)
            met = np.zeros(len(ids), bool)
            met[at] = True
            hit = new["det"].notna().to_numpy()
            det, win = new["det"].fillna(-1).to_numpy(np.int64), new["win"].fillna(-1).to_numpy(np.int64)
            behind = round_id < done[at] * commit
            gone = hit & behind & new["last"].to_numpy(bool)
            late = np.stack([shot[gone], det[gone]])
            fresh = hit & ~behind & (win >= done[at])
            hits = [np.concatenate([h, x[fresh]]) for h, x in zip(hits, (shot, win, det, new["in_commit"].fillna(False).to_numpy(bool)), strict=True)]
            np.maximum.at(top, at, round_id)
            done = np.where(met, np.maximum(done, (top - window + 1) // commit + 1), done)
            seen = np.full(len(ids), now + 1)
            np.maximum.at(seen, at, new["ms"].to_numpy(np.int64))
            due = np.where(met, seen + patience_ms, due)
        # Shots without a row in this batch end when the watermark has passed their time.
        over = ~met & (due < now)
        place = np.searchsorted(ids, hits[0])
        closed = over[place] | (hits[1] < done[place])
        ids, done, top, due = (x[~over] for x in (ids, done, top, due))
        if len(ids):
            state.update(tuple(x.tolist() for x in (ids, done, top, due, *[h[~closed] for h in hits])))
            state.setTimeoutTimestamp(int(due.min()))
        elif state.exists:
            state.remove()
        shot, win, det, flag = (h[closed] for h in hits)
        n = late.shape[1]
        if n + len(shot):
            yield pd.DataFrame({
                "shot_id": np.concatenate([late[0], shot]), "det": np.concatenate([late[1], det]), "win": np.concatenate([np.full(n, -1), win]),
                "in_commit": np.concatenate([np.zeros(n, bool), flag]), "late": np.arange(n + len(shot)) < n,
            })

    # Every row of a round is copied to the windows that cover it; ``last`` marks one of the copies. A round without hits still moves its shot on.
    numbered = wn.covering_windows(rounds, commit, window, outer=True).withColumn("last", F.coalesce(F.col("win") == F.floor(F.col("round_id") / commit), F.lit(True)))
    flat = numbered.withWatermark("ts", delay).select(
        F.floor(F.col("shot_id") / SHOT_BLOCK).alias("block"), "shot_id", "round_id", F.explode_outer("dets").alias("det"), "win", "in_commit", "last", "ts", F.unix_millis("ts").alias("ms"),
    )
    out = flat.groupBy("block").applyInPandasWithState(
        buffer, "shot_id bigint, det int, win int, in_commit boolean, late boolean",
        "ids array<bigint>, done array<bigint>, top array<bigint>, due array<bigint>, shots array<bigint>, wins array<bigint>, dets array<bigint>, flags array<boolean>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )
    split = lambda batch, _: {"windows": batch.filter("NOT late").drop("late"), "late": batch.filter("late").select("shot_id", "det")}
    run_available(out, split, sink, checkpoint, reread=True)


def stream_progress(stats: DataFrame, tasks: DataFrame, workers: int, sink: str, checkpoint: str) -> None:
    """Status row of every task a batch touched: what is left and for how long (STR6)."""
    sums = stats.groupBy("strong_id").agg(*[F.sum(c).alias(c) for c in ("shots", "errors", "seconds")])

    def status(batch: DataFrame, _: int) -> dict[str, DataFrame]:
        touched = tasks.join(batch.select("strong_id"), "strong_id", "left_semi")
        return {"status": st.progress_eta(touched, batch, workers)}

    run_available(sums, status, sink, checkpoint, mode="update")


def progress(spark: SparkSession, checkpoint: str, tasks: DataFrame, workers: int) -> DataFrame:
    """Current status of every task that ``stream_progress`` has seen, from the sums in its state."""
    sums = current_sums(spark, checkpoint, ["shots", "errors", "seconds"]).toDF("strong_id", "shots", "errors", "seconds")
    return st.progress_eta(tasks.join(sums.select("strong_id"), "strong_id", "left_semi"), sums, workers)


def stream_round_hits(hits: DataFrame, minutes: int, delay: str, sink: str, checkpoint: str) -> None:
    """Detection events per detector and tumbling window of event time (STR7)."""
    counts = hits.withWatermark("ts", delay).groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "det").agg(F.count("*").alias("n"))
    flat = counts.select(F.col("w.start").alias("window_start"), "det", "n")
    run_available(flat, lambda batch, _: {"counts": batch}, sink, checkpoint, mode="update")
