"""Registered queries over streams: the fixture arrives in several parts, each picked up by a resumed run."""

from pyspark.sql import functions as F

from ..lineage import new_path
from ..operators import samplers as sp
from ..operators import stats as st
from ..streaming import jobs as sj
from .q_events import mask
from .q_stats import ETA_SQL, FOLD_SQL, TASKS_SQL, flat, rich, tasks
from .registry import query


def feed(fx, df, order, start, parts=3):
    """Write ``df`` in ``parts`` ranges of ``order`` and run the job after each, from the same checkpoint."""
    src, sink, check = (new_path(fx.spark, f"stream-{x}") for x in ("in", "out", "checkpoint"))
    cuts = df.agg(F.percentile_approx(F.col(order).cast("double"), [i / parts for i in range(1, parts)], 1000)).first()[0] or []
    key = F.col(order).cast("double")
    edges = [None, *cuts, None]
    for lo, hi in zip(edges, edges[1:]):
        part = df if lo is None else df.filter(key > lo)
        (part if hi is None else part.filter(key <= hi)).write.mode("append").parquet(src)
        start(fx.spark.readStream.schema(df.schema).parquet(src), sink, check)
    return sink, check


@query("str1_stream_m2d", """
  SELECT shot_id, det FROM (SELECT m.shot_id, d.det FROM fx_meas m JOIN fx_det_def d ON m.meas = d.meas
    UNION ALL SELECT s.shot_id, t.det FROM (SELECT DISTINCT shot_id FROM fx_meas) s CROSS JOIN fx_det t WHERE t.post_flag = 1) GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1""")
def _(fx):
    shots = fx.fx_meas.groupBy("shot_id").agg(F.collect_list("meas").alias("meas"))
    expected = fx.fx_det.select("det", F.col("post_flag").alias("expect"))
    sink, _ = feed(fx, shots, "shot_id", lambda s, out, check: sj.stream_m2d(s, fx.fx_det_def, expected, out, check))
    return sj.results(fx.spark, sink, "events").select("shot_id", "det")


@query("str2_stream_postselect", """
  SELECT shot_id, COUNT(*) AS n_hits, bool_or(det IN (SELECT det FROM fx_det WHERE post_flag = 1)) AS dropped FROM fx_hits GROUP BY 1""")
def _(fx):
    shots = fx.fx_hits.groupBy("shot_id").agg(F.collect_list("det").alias("dets"))
    sink, _ = feed(fx, shots, "shot_id", lambda s, out, check: sj.stream_postselect(s, mask(fx), out, check))
    part = lambda name: sj.results(fx.spark, sink, name).select("shot_id", F.size("dets").cast("bigint").alias("n_hits"), F.lit(name == "dropped").alias("dropped"))
    return part("kept").unionByName(part("dropped"))


@query("str3_stream_combine", FOLD_SQL.replace("MIN(decoder) AS decoder, MIN(json_metadata) AS json_metadata, ", ""))
def _(fx):
    _, check = feed(fx, rich(fx), "seq", sj.stream_combine)
    total = sj.combined(fx.spark, check)
    return flat(total.withColumns({"decoder": F.lit(""), "json_metadata": F.lit("")})).drop("decoder", "json_metadata")


TAKEN_SQL = """SELECT * FROM (SELECT strong_id, seq, shots, errors, COALESCE(SUM(shots) OVER w, 0) AS s, COALESCE(SUM(errors) OVER w, 0) AS e FROM fx_stats
    WINDOW w AS (PARTITION BY strong_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE s < 3000 AND e < 150"""


@query("str4_stream_stop_rule", f"""
  WITH t AS ({TAKEN_SQL})
  SELECT 'accepted' AS output, strong_id, seq, shots, errors FROM t
  UNION ALL SELECT 'budget', strong_id, NULL, CAST(GREATEST(3000 - SUM(shots), 0) AS BIGINT), CAST(GREATEST(150 - SUM(errors), 0) AS BIGINT) FROM t GROUP BY strong_id""")
def _(fx):
    rows = fx.fx_stats.select("strong_id", "seq", "shots", "errors")
    sink, check = feed(fx, rows, "seq", lambda s, out, check: sj.stream_stop_rule(s, 3000, 150, out, check))
    taken = sj.results(fx.spark, sink, "accepted").select(F.lit("accepted").alias("output"), "strong_id", "seq", "shots", "errors")
    left = sj.budgets(fx.spark, check, 3000, 150)
    return taken.unionByName(left.select(F.lit("budget").alias("output"), "strong_id", F.lit(None).cast("bigint").alias("seq"), F.col("shots_left").alias("shots"), F.col("errors_left").alias("errors")))


@query("str5_stream_windowed_rounds", """
  SELECT shot_id, det, CAST(w AS INT) AS win, FLOOR(det / 4) < w * 2 + 2 AS in_commit FROM fx_hits, (SELECT unnest(range(3)) AS w) WHERE FLOOR(det / 4) >= w * 2 AND FLOOR(det / 4) < w * 2 + 3""")
def _(fx):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    by_round = fx.fx_hits.join(fx.fx_det, "det").groupBy("shot_id", "round_id").agg(F.collect_list("det").alias("dets"))
    rounds = by_round.withColumn("ts", F.timestamp_add("SECOND", F.col("round_id"), start))
    # A row far in the future moves the watermark past every shot, which closes them.
    end = fx.spark.createDataFrame([(-1, 9, [])], "shot_id bigint, round_id int, dets array<int>").withColumn("ts", F.timestamp_add("DAY", F.lit(1), start))
    sink, _ = feed(
        fx, rounds.select("shot_id", "round_id", "dets", "ts").unionByName(end), "round_id",
        lambda s, out, check: sj.stream_windowed_rounds(s, 2, 3, "1 minute", 60_000, out, check),
    )
    return sj.results(fx.spark, sink, "windows").select("shot_id", "det", "win", "in_commit")


@query("str6_stream_progress", ETA_SQL)
def _(fx):
    rows = fx.fx_stats.select("strong_id", "seq", "shots", "errors", "seconds")
    _, check = feed(fx, rows, "seq", lambda s, out, check: sj.stream_progress(s, tasks(fx), 4, out, check))
    return sj.progress(fx.spark, check, tasks(fx), 4).withColumn("minutes_left", F.round("minutes_left", 6))


@query("str6_progress_rows", f"SELECT strong_id, shots_left, errors_left, minutes_left FROM ({ETA_SQL})")
def _(fx):
    # The rows that the batches wrote, the last one of each task.
    rows = fx.fx_stats.select("strong_id", "seq", "shots", "errors", "seconds")
    sink, _ = feed(fx, rows, "seq", lambda s, out, check: sj.stream_progress(s, tasks(fx), 4, out, check))
    return sj.latest(fx.spark, sink, "status", ["strong_id"]).withColumn("minutes_left", F.round("minutes_left", 6))


@query("str7_stream_round_hits", "SELECT date_trunc('hour', ts) AS window_start, CAST(user_id % 24 AS INT) AS det, COUNT(*) AS n FROM events GROUP BY 1, 2".replace("date_trunc('hour', ts)", "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S')"))
def _(fx):
    hits = fx.events.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 24).cast("int").alias("det"))
    sink, _ = feed(fx, hits, "ts", lambda s, out, check: sj.stream_round_hits(s, 60, "2 hours", out, check))
    counts = sj.latest(fx.spark, sink, "counts", ["window_start", "det"])
    return counts.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def fixed_rate(task, first, n):
    """Sampler example: every shot whose number is a multiple of 100 fails."""
    fails = (first + n + 99) // 100 - (first + 99) // 100
    return n, fails, 0, n * 0.5


@query("udf2_sample_tasks", f"""
  SELECT strong_id, max_shots AS shots, CAST(CEIL(max_shots / 100.0) AS BIGINT) AS errors, CAST(0 AS BIGINT) AS discards, max_shots * 0.5::DOUBLE AS seconds FROM ({TASKS_SQL})""")
def _(fx):
    sp.register_sampler("fixed-rate", fixed_rate)
    return sp.sample_tasks(tasks(fx).withColumn("decoder", F.lit("fixed-rate")), "fixed-rate", chunk=300).select("strong_id", "shots", "errors", "discards", "seconds")


@query("udf3_expression_plugins", "SELECT seq, CASE WHEN d > 3 THEN 'large' ELSE 'small' END AS curve, d * d AS x FROM fx_stats WHERE errors * 50 < shots")
def _(fx):
    kept = st.filter_stats(fx.fx_rich, "errors * 50 < shots")
    return st.derive_columns(kept, curve="if(variant_get(m, '$.d', 'bigint') > 3, 'large', 'small')", x="variant_get(m, '$.d', 'bigint') * variant_get(m, '$.d', 'bigint')").select("seq", "curve", "x")
