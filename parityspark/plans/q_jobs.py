"""Registered queries over the user-level jobs."""

from pyspark.sql import functions as F

from ..functions import bits
from ..lineage import new_path
from ..operators import decode as dc
from ..sources import shots as sh
from ..sources import stats_csv as sc
from . import jobs

from .q_events import decode_log, mask
from .q_decode import matching_sql
from .q_graph import BOUNDARY
from .q_shots import LAYOUT, hits
from .q_stats import WRITTEN_SQL, flat, rich
from .registry import query


def shot_file(fx, fmt):
    path = new_path(fx.spark, f"job-{fmt}")
    sh.write_shots(fx.fx_shots, hits(fx), path, fmt, LAYOUT)
    return path


#: Further observables of each edge: the second half of predicted_sql's mask is bit 1, observable 130; bit 0 is observable 70.
FAR_OBS = "CAST(obs_mask + CASE WHEN (u + v) % 5 = 0 THEN 2 ELSE 0 END AS BIGINT)"


def model_lines(fx, near="L0", far=""):
    """The edge fixture as error-model text: one error line per edge, some likelier than not, some that never happen, and detectors."""
    place = F.col("u") * 100 + F.col("v")
    p = F.when(place % 97 == 5, F.lit("0.75")).when(place % 53 == 0, F.lit("0")).otherwise(F.concat(F.lit("0."), F.lpad((F.col("w") % 90000 + 10).cast("string"), 6, "0")))
    ends = F.concat(F.lit(" D"), "u", F.when(F.col("v") < BOUNDARY, F.concat(F.lit(" D"), "v")).otherwise(""))
    errors = fx.fx_edge.select(place.cast("bigint").alias("seq"), F.concat(F.lit("error("), p, F.lit(")"), ends, F.when(F.col("obs_mask") == 1, f" {near}").otherwise(""), F.when((F.col("u") + F.col("v")) % 5 == 0, far).otherwise("")).alias("line"))
    dets = fx.fx_det.select((5000 + F.col("det")).cast("bigint").alias("seq"), F.concat(F.lit("detector("), "base_det", F.lit(", 0, "), "round_id", F.lit(", "), "post_flag", F.lit(") D"), "det").alias("line"))
    return errors.unionByName(dets).select(F.lit(0).alias("model_id"), "seq", "line")


def predicted_sql(kept: str, obs: str = "CAST(obs_mask AS BIGINT)") -> str:
    """Predictions of the shots ``kept`` under the model above, as CTEs ending in predicted(shot_id, pred_mask, w, reason)."""
    prefix = f"""pm AS (SELECT u, v, CASE WHEN (u * 100 + v) % 97 = 5 THEN 0.75 ELSE CAST(w % 90000 + 10 AS DOUBLE) / 1000000 END AS p, {obs} AS o FROM fx_edge WHERE NOT ((u * 100 + v) % 53 = 0 AND (u * 100 + v) % 97 <> 5)),
  lm AS (SELECT u, v, o, ln((1 - p) / p) AS l FROM pm), sc AS (SELECT 2 * 16383 / MAX(ABS(l)) AS scale FROM lm),
  qm AS (SELECT u, v, o, CAST(round(l * scale / 2) * 2 AS BIGINT) AS q FROM lm, sc), me AS (SELECT u, v, ABS(q) AS w, o AS obs_mask FROM qm),
  bs AS (SELECT COALESCE(SUM(q), 0) AS bw, COALESCE(bit_xor(o), 0) AS bo FROM qm WHERE q < 0),
  bd AS (SELECT det FROM (SELECT u AS det FROM qm WHERE q < 0 UNION ALL SELECT v FROM qm WHERE q < 0 AND v < 24) GROUP BY 1 HAVING COUNT(*) % 2 = 1),
  kept AS ({kept}), syn AS (SELECT shot_id, list(det ORDER BY det) AS key FROM (SELECT shot_id, det FROM (SELECT shot_id, det FROM fx_hits JOIN kept USING (shot_id) UNION ALL SELECT shot_id, det FROM kept, bd) GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1) GROUP BY 1)"""
    return f"""{prefix}, {matching_sql(edges="me", syndromes="SELECT * FROM syn")},
  predicted AS (SELECT k.shot_id, CAST(xor(COALESCE(b.obs, 0), bs.bo) AS BIGINT) AS pred_mask, (COALESCE(b.w, 0) + bs.bw) / sc.scale AS w, CASE WHEN y.key IS NULL THEN 'empty' ELSE 'exact' END AS reason
    FROM kept k CROSS JOIN bs CROSS JOIN sc LEFT JOIN syn y ON y.shot_id = k.shot_id LEFT JOIN best b ON b.k = y.key)"""


POST = "SELECT DISTINCT h.shot_id FROM fx_hits h JOIN fx_det d USING (det) WHERE d.post_flag = 1"


@query("pipe1_predict", f"""
  WITH {predicted_sql(f"SELECT shot_id FROM fx_shots WHERE shot_id NOT IN ({POST})")}
  SELECT shot_id, FALSE AS discarded, pred_mask, ROUND(w, 6) AS w, reason FROM predicted UNION ALL SELECT shot_id, TRUE, NULL, NULL, NULL FROM ({POST})""")
def _(fx):
    out = jobs.predict(fx.spark, shot_file(fx, "dets"), "dets", LAYOUT, model_lines(fx), fx.fx_shots.select("shot_id"), postselect_coord=3)
    kept = out["predictions"].select("shot_id", F.lit(False).alias("discarded"), "pred_mask", F.round("w", 6).alias("w"), "reason")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("pred_mask", "bigint"), ("w", "double"), ("reason", "string"))]
    return kept.unionByName(out["discards"].select("shot_id", F.lit(True).alias("discarded"), *none))


@query("pipe1_predict_to_files", f"""
  WITH {predicted_sql(f"SELECT shot_id FROM fx_shots WHERE shot_id NOT IN ({POST})")},
  placed AS (SELECT shot_id, pred_mask, ROW_NUMBER() OVER (ORDER BY shot_id) - 1 AS pos FROM predicted),
  flip AS (SELECT unnest([0, 1]) AS idx)
  SELECT 'predicted' AS file, pos, 'L' AS kind, idx FROM placed, flip WHERE (pred_mask >> idx) & 1 = 1
  UNION ALL SELECT 'kept', pos, 'D', det FROM placed JOIN fx_hits USING (shot_id)
  UNION ALL SELECT 'kept', pos, 'L', idx FROM placed JOIN fx_shots USING (shot_id), flip WHERE (obs_mask >> idx) & 1 = 1
  UNION ALL SELECT 'records', COUNT(*), NULL, NULL FROM placed UNION ALL SELECT 'discarded', COUNT(*), NULL, NULL FROM ({POST})""")
def _(fx):
    out, kept = new_path(fx.spark, "predicted"), new_path(fx.spark, "kept")
    made = jobs.predict_to_files(fx.spark, shot_file(fx, "b8"), "b8", LAYOUT, model_lines(fx), out, "b8", kept, "r8", fx.fx_shots.select("shot_id"), postselect_coord=3)
    flips = sh.Layout(n_obs=LAYOUT.n_obs)
    read = lambda name, path, fmt, layout: sh.read_shots(fx.spark, path, fmt, layout).select(F.lit(name).alias("file"), F.col("shot_id").alias("pos"), "kind", F.col("idx").cast("int").alias("idx"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("idx", "int"))]
    total = lambda name, df: df.agg(F.count("*").alias("pos")).select(F.lit(name).alias("file"), "pos", *none)
    both = read("predicted", out, "b8", flips).unionByName(read("kept", kept, "r8", LAYOUT))
    return both.unionByName(total("records", sh.count_shots(fx.spark, out, "b8", flips))).unionByName(total("discarded", made["discards"]))


@query("pipe1_wide_observables", f"""
  WITH {predicted_sql(f"SELECT shot_id FROM fx_shots WHERE shot_id NOT IN ({POST})", FAR_OBS)}
  SELECT shot_id, CASE pred_mask WHEN 0 THEN '' WHEN 1 THEN '70' WHEN 2 THEN '130' ELSE '70 130' END AS observables, ROUND(w, 6) AS w, reason FROM predicted""")
def _(fx):
    lines = model_lines(fx, "L70", " L130")
    out = jobs.predict(fx.spark, shot_file(fx, "b8"), "b8", LAYOUT, lines, fx.fx_shots.select("shot_id"), postselect_coord=3)["predictions"]
    return out.select("shot_id", F.array_join(bits.indices(F.col("pred_mask")).cast("array<string>"), " ").alias("observables"), F.round("w", 6).alias("w"), "reason")


@query("pipe2_count_mistakes", f"""
  WITH {predicted_sql("SELECT shot_id FROM fx_shots")}
  SELECT COUNT(*) AS shots, COUNT(*) FILTER (p.pred_mask <> s.obs_mask) AS errors, CAST(0 AS BIGINT) AS discards FROM fx_shots s JOIN predicted p USING (shot_id)""")
def _(fx):
    actual = fx.fx_shots.select("shot_id", F.col("obs_mask").cast("bigint").alias("obs_mask"))
    return jobs.count_mistakes(fx.spark, shot_file(fx, "b8"), "b8", LAYOUT, actual, model_lines(fx))


def limited_tasks(fx):
    # Eight tasks share the shots; a task is finished when its earlier shots reach its limit.
    per = fx.fx_stats.groupBy("d").agg(F.sum("shots").alias("s"))
    named = per.select(F.concat(F.lit("task-"), "d").alias("strong_id"), F.col("d").alias("part"), F.lit(None).cast("string").alias("decoder"), F.lit(10**6).cast("bigint").alias("max_shots"), F.lit(None).cast("bigint").alias("max_errors"), "s")
    existing = named.select("strong_id", F.when(F.col("s") % 3 < 2, 0).otherwise(10**6).cast("bigint").alias("shots"), F.lit(0).cast("bigint").alias("errors"))
    return named.drop("s"), existing


PREDICTIONS = {"as-recorded": "pred_mask", "vacuous": "0"}


def _collect_sql(name, pred):
    return f"""
  SELECT CONCAT(t.strong_id, '/{name}') AS strong_id, '{name}' AS decoder, COUNT(*) AS shots, CAST(SUM(CASE WHEN b.shot_id IS NULL AND {pred} <> obs_mask THEN 1 ELSE 0 END) AS BIGINT) AS errors, COUNT(b.shot_id) AS discards,
    CAST(SUM(s.shot_id % 7) AS DOUBLE) AS seconds, CAST(SUM(COALESCE(h.n, 0)) AS BIGINT) AS detection_events, CAST(SUM(CASE WHEN b.shot_id IS NULL AND xor({pred}, obs_mask) = 2 THEN 1 ELSE 0 END) AS BIGINT) AS second_only
  FROM fx_shots s JOIN (SELECT CONCAT('task-', CAST(d AS VARCHAR)) AS strong_id, d AS part FROM fx_stats GROUP BY 1, 2 HAVING SUM(shots) % 3 < 2) t ON t.part = s.shot_id % 8
  LEFT JOIN (SELECT DISTINCT h.shot_id FROM fx_hits h JOIN fx_det d USING (det) WHERE d.post_flag = 1) b ON b.shot_id = s.shot_id LEFT JOIN (SELECT shot_id, COUNT(*) AS n FROM fx_hits GROUP BY 1) h ON h.shot_id = s.shot_id GROUP BY 1"""


@query("pipe3_collect", " UNION ALL ".join(_collect_sql(n, p) for n, p in PREDICTIONS.items()))
def _(fx):
    tasks, existing = limited_tasks(fx)

    def recorded(name):
        pred = F.col("pred_mask") if name == "as-recorded" else F.lit(0)
        return fx.fx_shots.select("shot_id", (F.col("shot_id") % 8).alias("part"), pred.alias("pred_mask"), "obs_mask", (F.col("shot_id") % 7).cast("double").alias("seconds"))

    return flat_collected(jobs.collect(tasks, existing, list(PREDICTIONS), recorded, fx.fx_hits, mask(fx), 2, 24))


def flat_collected(stats):
    count = lambda k: F.coalesce(F.try_element_at("custom_counts", F.lit(k)), F.lit(0)).cast("bigint")
    return stats.select("strong_id", "decoder", "shots", "errors", "discards", "seconds", count("detection_events").alias("detection_events"), count("obs_mistake_mask=_E").alias("second_only"))


def _part_model_sql(odd: int) -> str:
    """Best matchings of the kept shots of tasks with an odd or even number, under the weights of these tasks."""
    syndromes = f"SELECT list(det ORDER BY det) AS key FROM fx_hits WHERE shot_id % 2 = {odd} AND shot_id NOT IN ({POST}) GROUP BY shot_id"
    edges = f"(SELECT u, v, CAST(w * (1 + {odd} * ((u + v) % 3)) AS BIGINT) AS w, obs_mask FROM fx_edge)"
    return f"SELECT {odd} AS odd, k, obs FROM (WITH {matching_sql(edges=edges, syndromes=syndromes)} SELECT k, obs FROM best)"


@query("pipe3_collect_decoding", f"""
  WITH solved AS ({_part_model_sql(0)} UNION ALL {_part_model_sql(1)}), todo AS (SELECT CONCAT('task-', CAST(d AS VARCHAR)) AS strong_id, d AS part FROM fx_stats GROUP BY 1, 2 HAVING SUM(shots) % 3 < 2),
  syn AS (SELECT shot_id, list(det ORDER BY det) AS key FROM fx_hits GROUP BY 1),
  pred AS (SELECT s.shot_id, s.shot_id % 8 AS part, s.obs_mask, COALESCE(len(key), 0) AS n, b.shot_id IS NOT NULL AS bad, COALESCE(m.obs, 0) AS exact, 0 AS none
    FROM fx_shots s LEFT JOIN syn USING (shot_id) LEFT JOIN ({POST}) b ON b.shot_id = s.shot_id LEFT JOIN solved m ON m.odd = s.shot_id % 2 AND m.k = syn.key),
  each AS (SELECT shot_id, part, obs_mask, n, bad, 'exact' AS decoder, exact AS p FROM pred UNION ALL SELECT shot_id, part, obs_mask, n, bad, 'vacuous', none FROM pred)
  SELECT CONCAT(strong_id, '/', decoder) AS strong_id, decoder, COUNT(*) AS shots, COUNT(*) FILTER (NOT bad AND p <> obs_mask) AS errors, COUNT(*) FILTER (bad) AS discards, CAST(SUM(shot_id % 7) AS DOUBLE) AS seconds,
    CAST(SUM(n) AS BIGINT) AS detection_events, COUNT(*) FILTER (NOT bad AND xor(p, obs_mask) = 2) AS second_only FROM each JOIN todo USING (part) GROUP BY 1, 2""")
def _(fx):
    tasks, existing = limited_tasks(fx)
    edges = fx.fx_edge.select("u", F.when(F.col("v") != BOUNDARY, F.col("v")).alias("v"), "w", "obs_mask", ((F.col("u") + F.col("v")) % 3).alias("far"))
    parts = tasks.select(F.col("part").cast("bigint").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("odd")).filter("part % 2 = odd")
    weighted = edges.withColumn("odd", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("w", (F.col("w") * (1 + F.col("odd") * F.col("far"))).cast("bigint"))
    models = weighted.join(parts, "odd").select("part", "u", "v", "w", "obs_mask")
    shots = fx.fx_shots.select("shot_id", (F.col("shot_id") % 8).cast("bigint").alias("part"), F.col("obs_mask").cast("bigint").alias("obs_mask"), (F.col("shot_id") % 7).cast("double").alias("seconds"))
    return flat_collected(jobs.collect_decoding(tasks, existing, {"exact": dc.decode, "vacuous": None}, shots, fx.fx_hits, models, mask(fx), 2, 24))


def stat_files(fx):
    new, old = new_path(fx.spark, "combine-new"), new_path(fx.spark, "combine-old")
    whole = rich(fx).withColumn("seconds", F.floor("seconds").cast("double"))
    sc.write_task_stats(whole.filter("discards >= 3"), new)
    sc.write_task_stats(whole.filter("discards < 3"), old)
    return [old, new]


@query("pipe4_combine", WRITTEN_SQL)
def _(fx):
    return flat(jobs.combine(fx.spark, stat_files(fx), "error"))


@query("pipe4_combine_lines", f"""
  SELECT CONCAT(LPAD(CAST(shots AS VARCHAR), 10, ' '), ',', LPAD(CAST(errors AS VARCHAR), 10, ' '), ',', LPAD(CAST(discards AS VARCHAR), 10, ' '), ',', LPAD(CASE WHEN seconds < 1 THEN printf('%.3f', seconds) WHEN seconds < 10 THEN printf('%.2f', seconds) ELSE printf('%.1f', seconds) END, 8, ' '), ',',
    decoder, ',', strong_id, ',"', replace(json_metadata, '"', '""'), '",') AS line FROM ({WRITTEN_SQL})""")
def _(fx):
    return sc.stat_lines(jobs.combine(fx.spark, stat_files(fx), "metadata", strip=True))


@query("pipe5_curves", """
  SELECT c AS curve, d AS x, ROUND(CASE WHEN e > 0 THEN e / k END, 9) AS best, label FROM (
    SELECT decoder AS c, d, CONCAT(strong_id, ':', n) AS label, SUM(CASE WHEN seq % 3 = 0 THEN 0 WHEN n = 'x' THEN errors ELSE seq % 4 END) AS e, SUM(shots) - SUM(discards) AS k
    FROM fx_stats, (SELECT unnest(['x', 'y']) AS n) WHERE d < 6 GROUP BY 1, 2, 3)""")
def _(fx):
    out = jobs.curves(fx.spark, stat_files(fx), "variant_get(m, '$.d', 'bigint')", "variant_get(m, '$.c', 'string')", keep="variant_get(m, '$.d', 'int') < 6", keys=["x", "y"])
    return out["points"].select("curve", "x", F.round("best", 9).alias("best"), "label")


@query("pipe6_evaluate", """
  WITH log AS (SELECT s.shot_id, s.shot_id % 5 AS task_id, CAST(COALESCE(h.hw, 0) AS BIGINT) AS hw, (s.shot_id * 37 + 11) % 500 AS us, s.pred_mask, s.obs_mask FROM fx_shots s LEFT JOIN (SELECT shot_id, COUNT(*) AS hw FROM fx_hits GROUP BY 1) h ON h.shot_id = s.shot_id),
  cut AS (SELECT *, COALESCE(SUM(CASE WHEN hw > 0 AND pred_mask <> obs_mask THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY shot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM log)
  SELECT hw, COUNT(*) AS trials, ROUND(AVG(us), 6) AS mean_us FROM cut WHERE b < 40 GROUP BY 1""")
def _(fx):
    log = decode_log(fx).withColumn("task_id", F.col("shot_id") % 5)
    return jobs.evaluate(log, 40)["histogram"].withColumn("mean_us", F.round("mean_us", 6))


@query("pipe6_evaluate_summary", """
  WITH log AS (SELECT s.shot_id, s.shot_id % 5 AS task_id, CAST(COALESCE(h.hw, 0) AS BIGINT) AS hw, (s.shot_id * 37 + 11) % 500 AS us, s.pred_mask, s.obs_mask FROM fx_shots s LEFT JOIN (SELECT shot_id, COUNT(*) AS hw FROM fx_hits GROUP BY 1) h ON h.shot_id = s.shot_id),
  cut AS (SELECT *, hw > 0 AND pred_mask <> obs_mask AS wrong, COALESCE(SUM(CASE WHEN hw > 0 AND pred_mask <> obs_mask THEN 1 ELSE 0 END) OVER (PARTITION BY task_id ORDER BY shot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM log)
  SELECT COUNT(*) FILTER (wrong) AS errors, COUNT(*) AS trials, COUNT(*) FILTER (hw = 0) AS trivial, ROUND(AVG(us), 6) AS mean_us, ROUND(AVG(us) FILTER (hw > 0), 6) AS mean_us_nontrivial, ROUND(COUNT(*) FILTER (wrong) / COUNT(*), 9) AS rate
  FROM cut WHERE b < 40""")
def _(fx):
    summary = jobs.evaluate(decode_log(fx).withColumn("task_id", F.col("shot_id") % 5), 40)["summary"]
    return summary.withColumns({c: F.round(c, d) for c, d in (("mean_us", 6), ("mean_us_nontrivial", 6), ("rate", 9))})
