"""Registered queries over shots, events, postselection and scores."""

from pyspark.sql import functions as F

from ..functions import bits
from ..operators import events as ev
from ..operators import parity as pa
from .registry import query

# Recorded decode log: one row per shot with its Hamming weight and a deterministic duration.
LOG_SQL = """
  SELECT s.shot_id, CAST(COALESCE(h.hw, 0) AS BIGINT) AS hw, (s.shot_id * 37 + 11) % 500 AS us, s.pred_mask, s.obs_mask
  FROM fx_shots s LEFT JOIN (SELECT shot_id, COUNT(*) AS hw FROM fx_hits GROUP BY 1) h ON h.shot_id = s.shot_id"""

EVENTS_SQL = """
  SELECT shot_id, det FROM (
    SELECT m.shot_id, d.det FROM fx_meas m JOIN fx_det_def d ON m.meas = d.meas
    UNION ALL SELECT s.shot_id, t.det FROM fx_shots s CROSS JOIN fx_det t WHERE t.post_flag = 1)
  GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1"""

def scored_sql(postmask: int) -> str:
    return f"""
  SELECT shot_id, (bad OR (mistake_mask & {postmask}) <> 0) AS discarded,
         (NOT bad AND (mistake_mask & {postmask}) = 0 AND mistake_mask <> 0) AS is_error, mistake_mask
  FROM (SELECT s.shot_id, x.shot_id IS NOT NULL AS bad, CAST(xor(s.obs_mask, CAST((s.pred_mask + s.shot_id) % 4 AS INT)) AS INT) AS mistake_mask
        FROM fx_shots s LEFT JOIN (SELECT DISTINCT h.shot_id FROM fx_hits h JOIN fx_det d USING (det) WHERE d.post_flag = 1) x
          ON x.shot_id = s.shot_id)"""


def decode_log(fx):
    per_shot = ev.hits_per_shot(fx.fx_hits, fx.fx_shots)
    return fx.fx_shots.join(per_shot, "shot_id").select(
        "shot_id", "hw", ((F.col("shot_id") * 37 + 11) % 500).alias("us"), "pred_mask", "obs_mask"
    )


def mask(fx):
    return fx.fx_det.filter("post_flag = 1").select("det")


def expected(fx):
    return fx.fx_det.select("det", F.col("post_flag").alias("expect"))


def events(fx):
    return ev.measurements_to_events(fx.fx_shots, fx.fx_meas, fx.fx_det_def, expected(fx))


def event_sets(fx):
    return ev.measured_events(fx.fx_shots, fx.fx_meas, fx.fx_det_def, expected(fx))


def scored(fx, postmask=2):
    bad = ev.predict_discards(fx.fx_shots, fx.fx_hits, mask(fx)).filter("discarded")
    pred = fx.fx_shots.select("shot_id", ((F.col("pred_mask") + F.col("shot_id")) % 4).cast("int").alias("pred_mask"))
    return ev.score_predictions(pred, fx.fx_shots.select("shot_id", "obs_mask"), postmask, bad)


def failed_shots(fx):
    """How many shots failed, and how many were postselected away, starting from raw measurements."""
    bad = ev.predict_discards(fx.fx_shots, event_sets(fx), mask(fx)).filter("discarded")
    return ev.count_mistakes(
        ev.score_predictions(fx.fx_shots.select("shot_id", "pred_mask"), fx.fx_shots.select("shot_id", "obs_mask"), 0, bad)
    )


query("entry_failed_shots", f"""
  WITH e AS ({EVENTS_SQL}), bad AS (SELECT DISTINCT e.shot_id FROM e JOIN fx_det USING (det) WHERE post_flag = 1)
  SELECT COUNT(*) AS shots, CAST(SUM(CASE WHEN b.shot_id IS NULL AND obs_mask <> pred_mask THEN 1 ELSE 0 END) AS BIGINT) AS errors,
         COUNT(b.shot_id) AS discards
  FROM fx_shots s LEFT JOIN bad b ON s.shot_id = b.shot_id""")(failed_shots)


@query("agg1_xor_reduce", "SELECT shot_id, det FROM fx_hit_raw GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1")
def _(fx):
    return pa.xor_reduce(fx.fx_hit_raw, ["shot_id", "det"])


query("jn1_measurements_to_events", EVENTS_SQL)(events)


@query("jn2_apply_sweep", """
  SELECT shot_id, det FROM (
    SELECT shot_id, det FROM fx_hits
    UNION ALL SELECT m.shot_id, d.det FROM fx_meas m JOIN fx_det_def d ON m.meas = (d.meas + 1) % 32)
  GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1""")
def _(fx):
    sweep = fx.fx_meas.withColumnRenamed("meas", "sweep")
    effect = fx.fx_det_def.select("det", ((F.col("meas") + 1) % 32).cast("int").alias("sweep"))
    return ev.apply_sweep(fx.fx_hits, sweep, effect)


@query("jn3_align_records", """
  SELECT COALESCE(s.shot_id, h.shot_id) AS shot_id, s.obs_mask, h.hw,
         CASE WHEN s.shot_id IS NULL THEN 'left' WHEN h.shot_id IS NULL THEN 'right' END AS side
  FROM fx_shots s FULL OUTER JOIN (SELECT shot_id, COUNT(*) AS hw FROM fx_hits GROUP BY 1) h ON s.shot_id = h.shot_id""")
def _(fx):
    per_shot = fx.fx_hits.groupBy("shot_id").agg(F.count("*").alias("hw"))
    return ev.align_records(fx.fx_shots.select("shot_id", "obs_mask"), per_shot)



@query("jn4_replay_errors", """
  SELECT shot_id, kind, idx FROM (
    SELECT l.l_orderkey AS shot_id, t.kind, t.idx FROM lineitem l JOIN fx_tgt t ON t.err_id = l.l_partkey)
  GROUP BY 1, 2, 3 HAVING COUNT(*) % 2 = 1""")
def _(fx):
    firings = fx.lineitem.select(F.col("l_orderkey").alias("shot_id"), F.col("l_partkey").alias("err_id"))
    return ev.replay_errors(firings, fx.fx_tgt)


@query("jn5_syndrome_of", """
  SELECT shot_id, "row" FROM (
    SELECT l.l_orderkey AS shot_id, t.idx AS "row" FROM lineitem l JOIN fx_tgt t ON t.err_id = l.l_partkey
    WHERE t.kind = 'D' AND t.idx NOT IN (SELECT det FROM fx_det WHERE post_flag = 1))
  GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1""")
def _(fx):
    firings = fx.lineitem.select(F.col("l_orderkey").alias("shot_id"), F.col("l_partkey").alias("col"))
    checks = fx.fx_tgt.filter("kind = 'D'").select(F.col("idx").alias("row"), F.col("err_id").alias("col"))
    return ev.syndrome_of(firings, checks, mask(fx).select(F.col("det").alias("node")))


query("jn6_score_predictions", scored_sql(2))(scored)


@query("agg6_count_mistakes", f"""
  SELECT COUNT(*) AS shots, CAST(SUM(CASE WHEN is_error THEN 1 ELSE 0 END) AS BIGINT) AS errors,
         CAST(SUM(CASE WHEN discarded THEN 1 ELSE 0 END) AS BIGINT) AS discards FROM ({scored_sql(2)})""")
def _(fx):
    return ev.count_mistakes(scored(fx))


@query("agg7_count_detection_events", """
  SELECT n AS detection_events, c AS detectors_checked, n / c AS detection_fraction
  FROM (SELECT (SELECT COUNT(*) FROM fx_hits) AS n, (SELECT COUNT(*) * 24 FROM fx_shots) AS c)""")
def _(fx):
    return ev.count_detection_events(fx.fx_hits, fx.fx_shots, 24)


@query("agg7_complement", f"""
  SELECT n AS detection_events, c AS detectors_checked, n / c AS detection_fraction FROM (SELECT (SELECT COUNT(*) FROM ({EVENTS_SQL})) AS n, (SELECT COUNT(*) * 24 FROM fx_shots) AS c)""")
def _(fx):
    return ev.count_detection_events(event_sets(fx), fx.fx_shots, 24)


@query("agg7_complement_weights", f"SELECT s.shot_id, COUNT(e.det) AS hw FROM fx_shots s LEFT JOIN ({EVENTS_SQL}) e ON e.shot_id = s.shot_id GROUP BY 1")
def _(fx):
    return ev.hits_per_shot(event_sets(fx), fx.fx_shots)


@query("agg8_count_mistake_combos", f"""
  SELECT CONCAT('obs_mistake_mask=', CASE WHEN (mistake_mask & 1) <> 0 THEN 'E' ELSE '_' END,
                CASE WHEN (mistake_mask & 2) <> 0 THEN 'E' ELSE '_' END) AS combo, COUNT(*) AS n
  FROM ({scored_sql(0)}) WHERE is_error GROUP BY 1""")
def _(fx):
    return ev.count_mistake_combos(scored(fx, 0), 2)


@query("agg9_hamming_weight_histogram", f"SELECT hw, COUNT(*) AS trials, ROUND(AVG(us), 6) AS mean_us FROM ({LOG_SQL}) GROUP BY 1")
def _(fx):
    return ev.hamming_weight_histogram(decode_log(fx)).withColumn("mean_us", F.round("mean_us", 6))


@query("agg10_decoder_summary", f"""
  SELECT CAST(SUM(CASE WHEN hw > 0 AND pred_mask <> obs_mask THEN 1 ELSE 0 END) AS BIGINT) AS errors, COUNT(*) AS trials,
         CAST(SUM(CASE WHEN hw = 0 THEN 1 ELSE 0 END) AS BIGINT) AS trivial, ROUND(AVG(us), 6) AS mean_us,
         ROUND(AVG(CASE WHEN hw > 0 THEN us END), 6) AS mean_us_nontrivial,
         ROUND(SUM(CASE WHEN hw > 0 AND pred_mask <> obs_mask THEN 1 ELSE 0 END) / COUNT(*), 9) AS rate
  FROM ({LOG_SQL})""")
def _(fx):
    out = ev.decoder_summary(decode_log(fx))
    return out.withColumns(
        {"mean_us": F.round("mean_us", 6), "mean_us_nontrivial": F.round("mean_us_nontrivial", 6), "rate": F.round("rate", 9)}
    )


@query("agg21_bit_columns_xor", """
  SELECT o_orderstatus, bit_xor(obs_mask) AS obs_mask_xor, bit_xor(pred_mask) AS pred_mask_xor,
         CAST(bit_count(bit_xor(obs_mask)) AS INT) AS obs_mask_ones, CAST(bit_count(bit_xor(pred_mask)) AS INT) AS pred_mask_ones
  FROM fx_shots JOIN orders ON o_orderkey = shot_id GROUP BY 1""")
def _(fx):
    dense = fx.fx_shots.join(fx.orders, F.col("o_orderkey") == F.col("shot_id"))
    return pa.bit_columns_xor(dense, ["obs_mask", "pred_mask"], ["o_orderstatus"])


def _detectors(fx):
    c = [F.col(n).cast("double") for n in ("base_det", "det", "round_id")]
    coords = F.when(F.col("det") % 3 == 0, F.array(*c)).otherwise(F.array(*c, F.col("post_flag").cast("double")))
    return fx.fx_det.withColumn("coords", coords)


@query("flt1_postselect_mask_from_coord", "SELECT det FROM fx_det WHERE det % 3 <> 0 AND post_flag = 1")
def _(fx):
    return ev.postselect_mask_from_coord(_detectors(fx))


@query("flt2_postselect_mask_from_predicate", """
  SELECT DISTINCT t.strong_id AS task_id, d.det FROM fx_stats t JOIN fx_det d ON d.round_id >= t.d OR d.base_det = 0""")
def _(fx):
    tasks = fx.fx_stats.select(
        F.col("strong_id").alias("task_id"), F.to_json(F.struct("d")).alias("json_metadata"), F.lit(0).alias("model_id")
    ).distinct()
    return ev.postselect_mask_from_predicate(
        _detectors(fx).withColumn("model_id", F.lit(0)), tasks,
        "coords[2] >= get_json_object(json_metadata, '$.d') OR coords[0] = 0",
    )


@query("flt3_postselect_obs_mask", """
  SELECT strong_id AS task_id, CAST(SUM(CASE WHEN o.obs >= d THEN 1 << o.obs ELSE 0 END) AS BIGINT) AS obs_mask
  FROM (SELECT DISTINCT strong_id, d FROM fx_stats) t, (SELECT CAST(range AS INT) AS obs FROM range(8)) o GROUP BY 1""")
def _(fx):
    tasks = fx.fx_stats.select(F.col("strong_id").alias("task_id"), F.to_json(F.struct("d")).alias("json_metadata")).distinct()
    return ev.postselect_obs_mask(tasks, 8, "obs >= int(get_json_object(json_metadata, '$.d'))")


@query("flt3_wide_observables", """
  SELECT strong_id AS task_id, array_to_string(list(o.obs ORDER BY o.obs) FILTER (o.obs % 13 >= d), ' ') AS observables
  FROM (SELECT DISTINCT strong_id, d FROM fx_stats) t, (SELECT CAST(range AS INT) AS obs FROM range(131)) o GROUP BY 1""")
def _(fx):
    tasks = fx.fx_stats.select(F.col("strong_id").alias("task_id"), F.to_json(F.struct("d")).alias("json_metadata")).distinct()
    found = ev.postselect_obs_mask(tasks, 131, "obs % 13 >= int(get_json_object(json_metadata, '$.d'))")
    return found.select("task_id", F.array_join(bits.indices(F.col("obs_mask")).cast("array<string>"), " ").alias("observables"))


def far_mask(mask):
    """The two observables of a fixture mask, moved to 70 and 130."""
    low = F.when(F.getbit(mask, F.lit(0)) == 1, bits.single(F.lit(70), 3)).otherwise(bits.literal(0, 3))
    return bits.Masks(True).xor(low, F.when(F.getbit(mask, F.lit(1)) == 1, bits.single(F.lit(130), 3)).otherwise(bits.literal(0, 3)))


@query("jn6_wide_observables", """
  SELECT shot_id, xor(obs_mask, pred_mask) >= 2 AS discarded, xor(obs_mask, pred_mask) = 1 AS is_error, CASE xor(obs_mask, pred_mask) WHEN 0 THEN '' WHEN 1 THEN '70' WHEN 2 THEN '130' ELSE '70 130' END AS wrong FROM fx_shots""")
def _(fx):
    far = fx.fx_shots.select("shot_id", far_mask(F.col("obs_mask")).alias("obs_mask"), far_mask(F.col("pred_mask")).alias("pred_mask"))
    scored = ev.score_predictions(far.select("shot_id", "pred_mask"), far.select("shot_id", "obs_mask"), obs_postmask=1 << 130)
    return scored.select("shot_id", "discarded", "is_error", F.array_join(bits.indices(F.col("mistake_mask")).cast("array<string>"), " ").alias("wrong"))


@query("agg8_wide_observables", """
  SELECT CONCAT('obs_mistake_mask=', repeat('_', 70), CASE WHEN m % 2 = 1 THEN 'E' ELSE '_' END, repeat('_', 59), CASE WHEN m >= 2 THEN 'E' ELSE '_' END) AS combo, COUNT(*) AS n
  FROM (SELECT xor(obs_mask, pred_mask) AS m FROM fx_shots) WHERE m <> 0 GROUP BY 1""")
def _(fx):
    far = fx.fx_shots.select("shot_id", far_mask(F.col("obs_mask")).alias("obs_mask"), far_mask(F.col("pred_mask")).alias("pred_mask"))
    return ev.count_mistake_combos(ev.score_predictions(far.select("shot_id", "pred_mask"), far.select("shot_id", "obs_mask")), 131)


@query("flt4_predict_discards", """
  SELECT s.shot_id, EXISTS (SELECT 1 FROM fx_hits h JOIN fx_det d USING (det) WHERE d.post_flag = 1 AND h.shot_id = s.shot_id) AS discarded
  FROM fx_shots s""")
def _(fx):
    return ev.predict_discards(fx.fx_shots, fx.fx_hits, mask(fx))


@query("flt4_complement", f"""
  WITH e AS ({EVENTS_SQL}) SELECT s.shot_id, EXISTS (SELECT 1 FROM e JOIN fx_det d USING (det) WHERE d.round_id = 2 AND e.shot_id = s.shot_id) AS discarded FROM fx_shots s""")
def _(fx):
    return ev.predict_discards(fx.fx_shots, event_sets(fx), fx.fx_det.filter("round_id = 2").select("det"))


@query("flt5_complement", f"""
  WITH e AS ({EVENTS_SQL}), x AS (SELECT shot_id, det FROM (SELECT * FROM e UNION ALL SELECT shot_id, det FROM fx_hits) GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1),
  bad AS (SELECT DISTINCT x.shot_id FROM x JOIN fx_det d USING (det) WHERE d.round_id = 2)
  SELECT shot_id, det, shot_id NOT IN (SELECT shot_id FROM bad) AS kept FROM x WHERE shot_id IN (SELECT shot_id FROM fx_shots)""")
def _(fx):
    # Events with a second set of hits toggled in, split and only then unrolled.
    sets = event_sets(fx).xor(fx.fx_hits)
    parts = ev.postselect_shots(fx.fx_shots.select("shot_id"), sets, fx.fx_det.filter("round_id = 2").select("det"))
    out = lambda name, kept: parts[name].rows().select("shot_id", "det", F.lit(kept).alias("kept"))
    return out("kept_hits", True).unionByName(out("dropped_hits", False))


@query("flt5_postselect_shots", """
  WITH bad AS (SELECT DISTINCT h.shot_id FROM fx_hits h JOIN fx_det d USING (det) WHERE d.post_flag = 1)
  SELECT 'hit' AS row_type, h.shot_id, h.det AS val, h.shot_id NOT IN (SELECT shot_id FROM bad) AS kept FROM fx_hits h
  UNION ALL SELECT 'obs', s.shot_id, s.obs_mask, s.shot_id NOT IN (SELECT shot_id FROM bad) FROM fx_shots s""")
def _(fx):
    parts = ev.postselect_shots(fx.fx_shots, fx.fx_hits, mask(fx))
    pick = {"hits": ("hit", "det"), "shots": ("obs", "obs_mask")}
    out = None
    for name, df in parts.items():
        state, what = name.split("_")
        row_type, val = pick[what]
        one = df.select(F.lit(row_type).alias("row_type"), "shot_id", F.col(val).alias("val"), F.lit(state == "kept").alias("kept"))
        out = one if out is None else out.unionByName(one)
    return out


@query("flt14_split_kinds", """
  SELECT shot_id, CASE WHEN det < 8 THEN 'M' WHEN det < 20 THEN 'D' ELSE 'L' END AS kind,
         CAST(CASE WHEN det < 8 THEN det WHEN det < 20 THEN det - 8 ELSE det - 20 END AS INT) AS idx FROM fx_hits""")
def _(fx):
    return ev.split_kinds(fx.fx_hits.withColumnRenamed("det", "idx"), 8, 12)


@query("flt16_validate_shots", """
  SELECT shot_id, kind, idx, CASE kind WHEN 'D' THEN 20 ELSE 6 END AS n_bits FROM (
    SELECT shot_id, 'D' AS kind, det AS idx FROM fx_hits UNION ALL SELECT shot_id, 'M', meas FROM fx_meas)
  WHERE idx >= CASE kind WHEN 'D' THEN 20 ELSE 6 END""")
def _(fx):
    hits = fx.fx_hits.select("shot_id", F.lit("D").alias("kind"), F.col("det").alias("idx")).unionByName(
        fx.fx_meas.select("shot_id", F.lit("M").alias("kind"), F.col("meas").alias("idx"))
    )
    return ev.validate_shots(hits, {"M": 6, "D": 20})


@query("flt18_drop_boundary_hits", "SELECT shot_id, det FROM fx_hits WHERE det NOT IN (SELECT det FROM fx_det WHERE post_flag = 1)")
def _(fx):
    return ev.drop_boundary_hits(fx.fx_hits, mask(fx)).select("shot_id", "det")


@query("flt19_first_round", "SELECT det, base_det, round_id AS super_round, 0 AS sub_round FROM fx_det WHERE post_flag = 0")
def _(fx):
    c = [F.col(n).cast("double") for n in ("base_det", "round_id", "post_flag")]
    return ev.first_round(fx.fx_det.withColumn("coords", F.array(*c)))


@query("jn10_lookup_detector", "SELECT h.shot_id, h.det, d.base_det, d.round_id, d.post_flag FROM fx_hits h LEFT JOIN fx_det d ON h.det = d.det")
def _(fx):
    return ev.lookup_detector(fx.fx_hits, fx.fx_det)


def base_map(fx):
    """Bases 0 and 1 belong to the inner code; every base has an outer number."""
    return fx.fx_det.select("base_det").distinct().select(
        "base_det", F.when(F.col("base_det") < 2, F.col("base_det")).alias("inner_id"), F.col("base_det").alias("outer_id")
    )


@query("jn11_route_two_level", """
  SELECT h.shot_id, h.det, CASE WHEN d.base_det < 2 THEN 'inner' ELSE 'outer' END AS stream,
         CAST(CASE WHEN d.base_det < 2 THEN d.round_id * 2 + d.base_det ELSE FLOOR(d.round_id / 3) * 4 + d.base_det END AS INT) AS idx
  FROM fx_hits h JOIN fx_det d ON h.det = d.det""")
def _(fx):
    return ev.route_two_level(fx.fx_hits, fx.fx_det, base_map(fx), 2, 2, 4)


@query("jn12_unmatched_bases", """
  WITH i AS (SELECT d1 AS base_det FROM fx_err UNION ALL SELECT d2 FROM fx_err WHERE d2 IS NOT NULL),
       o AS (SELECT det AS base_det FROM fx_det WHERE post_flag = 1)
  SELECT DISTINCT base_det, 'unmatched' AS problem FROM i WHERE base_det NOT IN (SELECT base_det FROM o)
  UNION ALL SELECT base_det, 'duplicate' FROM i GROUP BY 1 HAVING COUNT(*) > 1""")
def _(fx):
    inner = fx.fx_err.select(F.explode(F.array("d1", "d2")).alias("base_det")).filter("base_det IS NOT NULL")
    return ev.unmatched_bases(mask(fx).withColumnRenamed("det", "base_det"), inner)


@query("jn13_neighbors", """
  SELECT u AS node, v AS neighbor, w, obs_mask FROM fx_edge UNION ALL SELECT v, u, w, obs_mask FROM fx_edge WHERE u <> v""")
def _(fx):
    return ev.neighbors(fx.fx_edge)


@query("jn13_edge_data", """
  SELECT q.a, q.b, e.u IS NOT NULL AS has_edge, e.w, e.obs_mask
  FROM (SELECT DISTINCT d1 AS a, CAST((err_id * 5) % 40 AS INT) AS b FROM fx_err) q
  LEFT JOIN fx_edge e ON e.u = LEAST(q.a, q.b) AND e.v = GREATEST(q.a, q.b)""")
def _(fx):
    pairs = fx.fx_err.select(F.col("d1").alias("a"), (F.col("err_id") * 5 % 40).cast("int").alias("b")).distinct()
    return ev.edge_data(pairs, fx.fx_edge)


@query("jn14_pair_hits_on_edges", """
  SELECT a.shot_id, e.u, e.v, e.w, e.obs_mask FROM fx_hits a JOIN fx_edge e ON e.u = a.det
  JOIN fx_hits b ON b.shot_id = a.shot_id AND b.det = e.v WHERE e.u < e.v""")
def _(fx):
    return ev.pair_hits_on_edges(fx.fx_hits, fx.fx_edge)


@query("dec12_compare_decoders", "SELECT shot_id, pred_mask AS pred_a, obs_mask AS pred_b FROM fx_shots WHERE pred_mask <> obs_mask")
def _(fx):
    other = fx.fx_shots.select("shot_id", F.col("obs_mask").alias("pred_mask"))
    return ev.compare_decoders(fx.fx_shots, other)


@query("agg2_xor_probability", """
  SELECT d1, ROUND(0.5 * (1 - product(1 - 2 * p)), 9) AS p FROM fx_err GROUP BY 1""")
def _(fx):
    return fx.fx_err.groupBy("d1").agg(F.round(pa.xor_probability(F.col("p")), 9).alias("p"))


@query("udaf1_xor_aggregates", "SELECT d1, ROUND(0.5 * (1 - product(1 - 2 * p)), 9) AS p, bit_xor(obs_mask) AS obs FROM fx_err GROUP BY 1")
def _(fx):
    return fx.fx_err.groupBy("d1").agg(F.round(pa.xor_probability(F.col("p")), 9).alias("p"), F.bit_xor("obs_mask").alias("obs"))


@query("agg4_merge_weights", """
  SELECT d1, obs_mask, ROUND(CASE WHEN SUM(CASE WHEN w < 0 THEN 1 ELSE 0 END) % 2 = 1 THEN -1 ELSE 1 END * ln((1 + t) / (1 - t)), 6) AS w
  FROM (SELECT d1, obs_mask, w, abs(product((exp(w) - 1) / (exp(w) + 1)) OVER (PARTITION BY d1, obs_mask)) AS t
        FROM (SELECT d1, obs_mask, 4 + ln((1 - p) / p) AS w FROM fx_err)) GROUP BY d1, obs_mask, t""")
def _(fx):
    w = F.lit(4) + F.log((1 - F.col("p")) / F.col("p"))
    return fx.fx_err.groupBy("d1", "obs_mask").agg(F.round(pa.merge_weights(w), 6).alias("w"))


@query("srt3_canonical_targets", """
  SELECT err_id, string_agg(CONCAT(kind, CAST(idx AS VARCHAR)), ' ' ORDER BY kind, idx) AS targets
  FROM (SELECT err_id, kind, idx FROM fx_tgt GROUP BY 1, 2, 3 HAVING COUNT(*) % 2 = 1) GROUP BY 1""")
def _(fx):
    return pa.canonical_targets(fx.fx_tgt, "err_id").withColumn("targets", pa.targets_text(F.col("targets")))


@query("set2_xor_sets", """
  SELECT shot_id, det FROM (SELECT shot_id, det FROM fx_hits UNION ALL
    SELECT m.shot_id, d.det FROM fx_meas m JOIN fx_det_def d ON m.meas = d.meas) GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1""")
def _(fx):
    other = ev.measurements_to_events(fx.fx_shots, fx.fx_meas, fx.fx_det_def)
    return pa.xor_sets(fx.fx_hits, other, ["shot_id", "det"])


@query("set3_is_subset", """
  SELECT m.shot_id, bool_and(h.det IS NOT NULL) AS is_subset
  FROM fx_meas m LEFT JOIN fx_hits h ON h.shot_id = m.shot_id AND h.det = m.meas GROUP BY 1""")
def _(fx):
    return pa.is_subset(fx.fx_meas.select("shot_id", F.col("meas").alias("det")), fx.fx_hits, "shot_id", "det")


@query("set6_leftover_events", """
  SELECT shot_id, det FROM (SELECT shot_id, det FROM fx_hits WHERE det >= 12 UNION ALL
    SELECT h.shot_id, h.det FROM fx_hits h WHERE h.det < 12 AND NOT EXISTS
      (SELECT 1 FROM fx_meas m WHERE m.shot_id = h.shot_id AND m.meas = h.det)) GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1""")
def _(fx):
    committed = fx.fx_meas.select("shot_id", F.col("meas").alias("det"))
    return ev.leftover_events(fx.fx_hits.filter("det < 12"), committed, fx.fx_hits.filter("det >= 12"))
