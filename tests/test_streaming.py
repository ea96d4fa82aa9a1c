"""Streams against their batch form, across resumed runs."""

import random
import shutil

from pyspark.sql import functions as F

from parityspark.operators import stats as st
from parityspark.streaming import jobs as sj

STATS = "strong_id string, decoder string, json_metadata string, shots bigint, errors bigint, discards bigint, seconds double, custom_counts map<string,bigint>"


def test_running_totals_resume_without_counting_twice(spark, tmp_path):
    src, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    data = [("a" if i % 3 else "b", "d", "{}", 10 + i, i % 4, 0, 1.0, {"k": i % 2}) for i in range(40)]
    for part in (data[:25], data[25:], []):
        if part:
            spark.createDataFrame(part, STATS).write.mode("append").parquet(src)
        sj.stream_combine(spark.readStream.schema(STATS).parquet(src), sink, check)
    want = st.fold_stats(spark.createDataFrame(data, STATS))
    show = lambda df: sorted((r.strong_id, r.shots, r.errors, r.seconds, r.custom_counts) for r in df.collect())
    assert show(sj.combined(spark, check)) == show(want)


def test_late_rounds_go_to_their_own_output(spark, tmp_path):
    src, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "shot_id bigint, round_id int, dets array<int>, ts timestamp"
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
    first = spark.createDataFrame([(1, 0, [3]), (1, 1, [7]), (1, 2, [9])], "shot_id bigint, round_id int, dets array<int>").withColumn("ts", at(0))
    second = spark.createDataFrame([(1, 0, [2]), (1, 3, [13])], "shot_id bigint, round_id int, dets array<int>").withColumn("ts", at(1))
    closing = spark.createDataFrame([(-1, 0, [])], "shot_id bigint, round_id int, dets array<int>").withColumn("ts", at(86400))
    for part in (first, second, closing):
        part.write.mode("append").parquet(src)
        sj.stream_windowed_rounds(spark.readStream.schema(schema).parquet(src), 2, 3, "1 minute", 60_000, sink, check)
    late = [(r.shot_id, r.det) for r in sj.results(spark, sink, "late").collect()]
    windows = sorted((r.win, r.det, r.in_commit) for r in sj.results(spark, sink, "windows").collect())
    assert late == [(1, 2)]
    assert windows == [(0, 3, True), (0, 7, True), (0, 9, False), (1, 9, True), (1, 13, True)]


def run_stop_rule(spark, tmp_path, parts, most):
    src, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "strong_id string, seq bigint, shots bigint, errors bigint"
    for part in parts:
        spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(src)
        sj.stream_stop_rule(spark.readStream.schema(schema).parquet(src), *most, sink, check)
    return sink, check


def test_stop_rule_takes_rows_in_order_and_tells_what_is_left(spark, tmp_path):
    rng = random.Random(11)
    rows = [(k, i, rng.randrange(0, 30), rng.randrange(0, 3)) for i in range(600) for k in ("hot", "hot", "b", f"t{i % 7}") if rng.random() < 0.5]
    rows = [(k, n, s, e) for n, (k, _, s, e) in enumerate(rows)]
    parts = [rows[:250], rows[250:260], rows[260:]]
    for most in ((900, 60), (None, 25), (10**9, None)):
        home = tmp_path / f"limits-{most[0]}-{most[1]}"
        sink, check = run_stop_rule(spark, home, parts, most)
        want, used = [], {}
        for part in parts:
            for k, n, s, e in part:
                a, b = used.get(k, (0, 0))
                if (most[0] is None or a < most[0]) and (most[1] is None or b < most[1]):
                    want.append((k, n, s, e))
                    a, b = a + s, b + e
                used[k] = (a, b)
        assert sorted((r.strong_id, r.seq, r.shots, r.errors) for r in sj.results(spark, sink, "accepted").collect()) == sorted(want)
        left = {k: tuple(None if m is None else max(0, m - u) for m, u in zip(most, v)) for k, v in used.items()}
        for table in (sj.budgets(spark, check, *most), sj.latest(spark, sink, "budgets", ["strong_id"])):
            assert {r.strong_id: (r.shots_left, r.errors_left) for r in table.collect()} == left


def test_current_totals_do_not_read_the_batches(spark, tmp_path):
    src, sink, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    data = [("a" if i % 3 else "b", "d", "{}", 10 + i, i % 4, 0, 1.0, {"k": i % 2}) for i in range(50)]
    for i, row in enumerate(data):
        spark.createDataFrame([row], STATS).coalesce(1).write.mode("append").parquet(f"{src}")
    stream = spark.readStream.schema(STATS).option("maxFilesPerTrigger", 1).parquet(src)
    sj.stream_combine(stream, sink, check)
    shutil.rmtree(sink)  # 50 batches were written, none is needed
    want = st.fold_stats(spark.createDataFrame(data, STATS))
    show = lambda df: sorted((r.strong_id, r.shots, r.errors, r.seconds, r.custom_counts) for r in df.collect())
    got = sj.combined(spark, check)
    assert show(got) == show(want)
    assert sj.current_sums(spark, check, ["shots", "errors", "discards", "seconds", "n"]).count() == 4


def test_blocks_of_shots_buffer_rounds_as_single_shots_do(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    schema = "shot_id bigint, round_id int, dets array<int>, at bigint"
    # Shots go on at their own pace, some stay away long enough to be closed and come back, some repeat old rounds.
    parts = [[(s, max(0, 2 * b + rng.randrange(-3, 3)), rng.choice([None, [], [s % 7], [s % 7, 9]]), 100 * b + rng.randrange(60)) for s in range(-3, 40) if rng.random() < 0.6] for b in range(5)]
    parts.append([(10**6, 0, [], 10**6)])
    got = {}
    for block in (1, 16):
        monkeypatch.setattr(sj, "SHOT_BLOCK", block)
        src, sink, check = (str(tmp_path / f"{x}-{block}") for x in ("in", "out", "check"))
        stored = []
        for part in parts:
            df = spark.createDataFrame(part, schema).select("shot_id", "round_id", "dets", F.timestamp_seconds("at").alias("ts"))
            df.coalesce(2).write.mode("append").parquet(src)
            sj.stream_windowed_rounds(spark.readStream.schema(df.schema).parquet(src), 2, 3, "20 seconds", 90_000, sink, check)
            stored.append(spark.read.format("statestore").load(check).count())
        show = lambda name: sorted(map(tuple, sj.results(spark, sink, name).drop("batch").collect()))
        got[block] = show("windows"), show("late"), stored
    assert got[1][:2] == got[16][:2] and all(got[16][:2])
    # One state a block of shots that are open: what the job does is not a call a shot.
    assert max(got[16][2]) <= 4 < max(got[1][2])


def test_stop_rule_calls_do_not_grow_with_the_tasks(spark, tmp_path):
    parts = [[(f"t{i}" if i % 900 else None, i, 10, i % 3) for i in range(n, 20000, 4)] for n in range(2)]
    sink, check = run_stop_rule(spark, tmp_path, parts, (10, None))
    assert sj.results(spark, sink, "accepted").count() == len({k for part in parts for k, *_ in part})
    assert sj.budgets(spark, check, 10, None).agg(F.count("*"), F.sum("shots_left")).first() == (len({k for part in parts for k, *_ in part}), 0)
    # Groups of tasks are the states, whatever the number of tasks.
    assert spark.read.format("statestore").option("stateVarName", "used").load(check).count() <= sj.TASK_GROUPS < len(parts[0])
