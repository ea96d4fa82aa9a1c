"""Registered queries over error-model and circuit text and tables."""

from pyspark.sql import functions as F

from ..functions import bits
from ..lineage import cut
from ..operators import model as md
from ..sources import text_models as tm
from .registry import query

# The model fixture straight from the events: s is both the repeat count and the shift of a block.
EV = """
  SELECT *, COALESCE(SUM(jump) OVER w, 0) AS shift, COALESCE(SUM(jx0) OVER w, 0) AS x0, COALESCE(SUM(jx1) OVER w, 0) AS x1 FROM (
    SELECT user_id AS model_id, event_id AS ev, event_type AS t, user_id % 24 AS a, event_id % 24 AS b, (event_id + 5) % 24 AS c, event_id % 2 AS o, 1 + event_id % 3 AS s,
      CAST(CONCAT('0.', LPAD(CAST(1 + event_id % 400 AS VARCHAR), 4, '0')) AS DOUBLE) AS p,
      CASE event_type WHEN 'signup' THEN (1 + event_id % 3) * (1 + event_id % 3) WHEN 'error' THEN 1 + event_id % 3 ELSE 0 END AS jump,
      CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS jx0, CASE WHEN event_type = 'signup' THEN 2 * (1 + event_id % 3) ELSE 0 END AS jx1 FROM events)
  WINDOW w AS (PARTITION BY model_id ORDER BY ev ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
RUNS = f"""
  WITH ev AS ({EV}), it AS (SELECT ev.*, i, shift + i * s AS sh FROM ev, LATERAL (SELECT unnest(range(CASE WHEN t = 'signup' THEN s ELSE 1 END)) AS i))"""
FLAT = RUNS + """, flat AS (
  SELECT model_id, ev, i, CASE t WHEN 'purchase' THEN 'detector' WHEN 'error' THEN 'logical_observable' ELSE 'error' END AS name,
         CASE WHEN t = 'view' THEN 'src=view' ELSE '' END AS tag, CASE t WHEN 'purchase' THEN 1.5 + x0 WHEN 'error' THEN NULL ELSE p END AS arg0,
         CASE WHEN t = 'purchase' THEN CAST(b + x1 AS DOUBLE) END AS arg1,
         CASE t WHEN 'view' THEN CONCAT('D', CAST(a + sh AS VARCHAR), ' D', CAST(b + sh AS VARCHAR), ' L', CAST(o AS VARCHAR))
           WHEN 'click' THEN CONCAT('D', CAST(a + sh AS VARCHAR), ' D', CAST(b + sh AS VARCHAR), ' ^ D', CAST(c + sh AS VARCHAR), ' L', CAST(o AS VARCHAR))
           WHEN 'purchase' THEN CONCAT('D', CAST(a + sh AS VARCHAR)) WHEN 'signup' THEN CONCAT('D', CAST(a + sh AS VARCHAR), ' D', CAST(b + sh AS VARCHAR))
           ELSE CONCAT('L', CAST(o AS VARCHAR)) END AS targets, sh FROM it)"""


def model(fx):
    return tm.read_model_text(fx.fx_model_line)


def circuit(fx):
    return tm.read_circuit_text(fx.fx_circuit_line)


def show(df, keys):
    """Arguments and targets as plain columns."""
    return df.select(*keys, "name", "tag", F.get("args", F.lit(0)).alias("arg0"), F.get("args", F.lit(1)).alias("arg1"), F.array_join("targets", " ").alias("targets"))


def errors(fx):
    return fx.fx_err.select("err_id", "p", F.when(F.col("err_id") % 5 == 0, "odd]tag").otherwise("").alias("tag"))


TEXT_SQL = r"""
  SELECT model_id, seq, COALESCE(NULLIF(LOWER(regexp_extract(line, '^\s*([A-Za-z_]+|})', 1)), ''), '') AS name, regexp_extract(line, '^\s*(?:[A-Za-z_]+|})\[([^\]]*)\]', 1) AS tag,
         CAST(NULLIF(regexp_extract(line, '\(([^,)]*)', 1), '') AS DOUBLE) AS arg0, CAST(NULLIF(trim(regexp_extract(line, '\([^,)]*,([^)]*)\)', 1)), '') AS DOUBLE) AS arg1,
         CASE WHEN line LIKE 'repeat%' THEN '' ELSE trim(regexp_replace(regexp_replace(line, '^\s*([A-Za-z_]+|})(\[[^\]]*\])?(\([^)]*\))?', ''), '#.*$', '')) END AS targets,
         CAST(NULLIF(regexp_extract(line, '^repeat ([0-9]+)', 1), '') AS BIGINT) AS reps
  FROM fx_model_line"""


@query("src7_read_model_text", TEXT_SQL)
def _(fx):
    m = model(fx)
    return show(m, ["model_id", "seq", "reps"])


@query("src8_read_circuit_text", TEXT_SQL.replace("model_id", "circuit_id").replace("fx_model_line", "fx_circuit_line").replace("LOWER(", "UPPER(").replace("'repeat%'", "'REPEAT%'").replace("^repeat ", "^REPEAT "))
def _(fx):
    return show(circuit(fx), ["circuit_id", "seq", "reps"])


def round_trip(fx):
    return tm.read_model_text(tm.instruction_lines(model(fx)).select("model_id", "seq", "line"))


query("snk5_instruction_lines", TEXT_SQL)(lambda fx: show(round_trip(fx), ["model_id", "seq", "reps"]))


@query("snk5_write_model_text", r"""
  SELECT 0 AS section, e.err_id AS seq, CONCAT('error', CASE WHEN e.err_id % 5 = 0 THEN '[odd\Ctag]' ELSE '' END, '(', CAST(p AS VARCHAR), ') ', string_agg(s, ' ^ ' ORDER BY comp)) AS line
  FROM fx_err e JOIN (SELECT err_id, comp, string_agg(CONCAT(kind, CAST(idx AS VARCHAR)), ' ' ORDER BY kind, idx) AS s FROM fx_tgt GROUP BY 1, 2) c ON c.err_id = e.err_id GROUP BY e.err_id, p
  UNION ALL SELECT 1, CAST(det AS BIGINT), CONCAT('detector(', CAST(base_det AS VARCHAR), ', ', CAST(round_id AS VARCHAR), ') D', CAST(det AS VARCHAR)) FROM fx_det""")
def _(fx):
    det = fx.fx_det.select("det", F.array(F.col("base_det").cast("double"), F.col("round_id").cast("double")).alias("coords"))
    return tm.model_text(errors(fx), fx.fx_tgt, det)


@query("mdl1_flatten_model", FLAT + " SELECT model_id, name, tag, arg0, arg1, targets FROM flat")
def _(fx):
    return show(md.flatten_model(model(fx)), ["model_id"])


@query("win3_resolve_coordinates", FLAT + " SELECT model_id, ev * 8 AS seq, arg0 AS x, arg1 AS y FROM flat WHERE name = 'detector'")
def _(fx):
    flat = md.flatten_model(model(fx)).filter("name = 'detector'")
    return flat.select("model_id", F.element_at("path", -1).alias("seq"), F.get("args", F.lit(0)).alias("x"), F.get("args", F.lit(1)).alias("y"))


@query("mdl2_total_shift", f"""
  SELECT model_id, CAST(SUM(jump) AS BIGINT) AS det_shift, CAST(SUM(jx0) AS DOUBLE) AS x, CAST(SUM(jx1) AS DOUBLE) AS y FROM ({EV}) GROUP BY 1""")
def _(fx):
    s = md.total_shift(model(fx))
    return s.select("model_id", "det_shift", F.get("coord_shift", F.lit(0)).alias("x"), F.get("coord_shift", F.lit(1)).alias("y"))


@query("mdl3_detector_coordinates", FLAT + """
  SELECT w.model_id, w.det, m.x, m.y FROM (SELECT user_id AS model_id, event_id % 200 AS det FROM events GROUP BY 1, 2) w
  LEFT JOIN (SELECT model_id, CAST(targets[2:] AS BIGINT) AS det, MIN_BY(arg0, ev) AS x, MIN_BY(arg1, ev) AS y FROM flat WHERE name = 'detector' GROUP BY 1, 2) m ON w.model_id = m.model_id AND w.det = m.det""")
def _(fx):
    wanted = fx.events.select(F.col("user_id").alias("model_id"), (F.col("event_id") % 200).alias("det")).distinct()
    out = md.detector_coordinates(model(fx), wanted)
    return out.select("model_id", "det", F.get("coords", F.lit(0)).alias("x"), F.get("coords", F.lit(1)).alias("y"))


@query("mdl4_split_components", f"""
  SELECT ev * 8 AS seq, comp, kind, CAST(idx AS INT) AS idx FROM (
    SELECT ev, t, 0 AS comp, 'D' AS kind, a AS idx FROM ({EV}) WHERE t IN ('view', 'click') UNION ALL SELECT ev, t, 0, 'D', b FROM ({EV}) WHERE t IN ('view', 'click')
    UNION ALL SELECT ev, t, 0, 'L', o FROM ({EV}) WHERE t = 'view' UNION ALL SELECT ev, t, 1, 'L', o FROM ({EV}) WHERE t = 'click' UNION ALL SELECT ev, t, 1, 'D', c FROM ({EV}) WHERE t = 'click')
  UNION ALL SELECT ev * 8 + 1, 0, 'D', CAST(unnest([a, b]) AS INT) FROM ({EV}) WHERE t = 'signup'""")
def _(fx):
    return md.split_components(model(fx).filter("name = 'error'"), "seq")


COMP_SQL = """
  SELECT n.err_id, n.comp, COUNT(*) FILTER (kind = 'D') AS n_det, MIN(idx) FILTER (kind = 'D') AS u, CASE WHEN COUNT(*) FILTER (kind = 'D') = 2 THEN MAX(idx) FILTER (kind = 'D') END AS v,
         COALESCE(bit_or(1::BIGINT << idx) FILTER (kind = 'L'), 0) AS obs_mask, MIN(e.p) AS p
  FROM (SELECT err_id, comp, kind, idx FROM fx_tgt GROUP BY 1, 2, 3, 4 HAVING COUNT(*) % 2 = 1) n JOIN fx_err e ON e.err_id = n.err_id GROUP BY 1, 2"""


@query("mdl5_edges_from_model", f"""
  SELECT u, v, ROUND(0.5 * (1 - product(1 - 2 * p)), 9) AS p, MIN_BY(obs_mask, err_id * 64 + comp) AS obs_mask FROM ({COMP_SQL}) WHERE n_det IN (1, 2) GROUP BY 1, 2""")
def _(fx):
    return md.edges_from_model(fx.fx_err, fx.fx_tgt, 1).select("u", "v", F.round("p", 9).alias("p"), "obs_mask")


@query("mdl5_wide_observables", f"""
  SELECT u, v, ROUND(0.5 * (1 - product(1 - 2 * p)), 9) AS p, MIN_BY(CASE WHEN obs_mask = 0 THEN '' WHEN err_id % 2 = 0 THEN '70' ELSE '130' END, err_id * 64 + comp) AS observables
  FROM ({COMP_SQL}) WHERE n_det IN (1, 2) GROUP BY 1, 2""")
def _(fx):
    far = fx.fx_tgt.withColumn("idx", F.when(F.col("kind") == "L", F.when(F.col("err_id") % 2 == 0, 70).otherwise(130)).otherwise(F.col("idx")))
    edges = md.edges_from_model(fx.fx_err, far)
    return edges.select("u", "v", F.round("p", 9).alias("p"), F.array_join(bits.indices(F.col("obs_mask")).cast("array<string>"), " ").alias("observables"))


def raw_edges(fx):
    """Parallel edges with integer weights; equal weights are common."""
    w = F.round(1000 * F.log((1 - F.col("p")) / F.col("p")) / 50).cast("bigint")
    return fx.fx_err.select(F.col("d1").alias("u"), F.col("d2").alias("v"), w.cast("double").alias("w"), "p", F.col("obs_mask").cast("bigint").alias("obs_mask"), F.col("err_id").alias("seq"))


RAW_EDGES = """
  SELECT CASE WHEN d2 IS NULL THEN d1 ELSE LEAST(d1, d2) END AS u, CASE WHEN d2 IS NOT NULL THEN GREATEST(d1, d2) END AS v,
         CAST(ROUND(1000 * ln((1 - p) / p) / 50) AS DOUBLE) AS w, p, CAST(obs_mask AS BIGINT) AS obs_mask, err_id AS seq FROM fx_err"""
PICKS = {
    "smallest-weight": "arg_min(struct_pack(w := w, p := p, o := obs_mask), struct_pack(w := w, s := seq))",
    "keep-original": "arg_min(struct_pack(w := w, p := p, o := obs_mask), seq)",
    "replace": "arg_max(struct_pack(w := w, p := p, o := obs_mask), seq)",
}


def _register_merge(strategy, pick):
    @query(f"agg5_merge_{strategy.replace('-', '_')}", f"SELECT u, v, r.w AS w, r.p AS p, r.o AS obs_mask FROM (SELECT u, v, {pick} AS r FROM ({RAW_EDGES}) GROUP BY 1, 2)")
    def _(fx):
        return md.merge_parallel_edges(raw_edges(fx), strategy)


for _strategy, _pick in PICKS.items():
    _register_merge(_strategy, _pick)


@query("agg5_merge_independent", f"SELECT u, v, ROUND(0.5 * (1 - product(1 - 2 * p)), 9) AS p, MIN_BY(obs_mask, seq) AS obs_mask FROM ({RAW_EDGES}) GROUP BY 1, 2")
def _(fx):
    return md.merge_parallel_edges(raw_edges(fx), "independent").select("u", "v", F.round("p", 9).alias("p"), "obs_mask")


@query("agg5_merge_disallow", f"SELECT u, v, COUNT(*) AS n FROM ({RAW_EDGES}) GROUP BY 1, 2 HAVING COUNT(*) > 1")
def _(fx):
    return md.parallel_edges(raw_edges(fx))


@query("agg3_merge_duplicate_errors", """
  SELECT t.targets, CASE WHEN e.err_id % 5 = 0 THEN 'odd]tag' ELSE '' END AS tag, MIN(e.err_id) AS err_id, COUNT(*) AS n_merged, ROUND(0.5 * (1 - product(1 - 2 * p)), 9) AS p
  FROM fx_err e LEFT JOIN (SELECT err_id, string_agg(CONCAT(kind, CAST(idx AS VARCHAR)), ' ' ORDER BY kind, idx) AS targets
    FROM (SELECT err_id, kind, idx FROM fx_tgt GROUP BY 1, 2, 3 HAVING COUNT(*) % 2 = 1) GROUP BY 1) t ON t.err_id = e.err_id
  GROUP BY 1, 2""".replace("SELECT t.targets,", "SELECT COALESCE(t.targets, '') AS targets,"))
def _(fx):
    from ..operators.parity import targets_text

    merged = md.merge_duplicate_errors(errors(fx), fx.fx_tgt)
    return merged.withColumns({"targets": targets_text(F.col("targets")), "p": F.round("p", 9)})


@query("agg15_model_counts", FLAT + """
  SELECT model_id, MAX(CASE WHEN name <> 'logical_observable' THEN list_max([CAST(x AS BIGINT) FOR x IN regexp_extract_all(targets, 'D([0-9]+)', 1)]) ELSE -1 END) + 1 AS detectors,
         COALESCE(MAX(CAST(NULLIF(regexp_extract(targets, 'L([0-9]+)', 1), '') AS BIGINT)) + 1, 0) AS observables, CAST(SUM(CASE WHEN name = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM flat GROUP BY 1""")
def _(fx):
    return md.model_counts(model(fx))


CONV = "SELECT conv_id AS circuit_id, turn, role, LENGTH(text) % 9 AS a, 2 + LENGTH(text) % 4 AS r FROM conversations"


@query("agg16_circuit_stats", f"""
  SELECT circuit_id, MAX(CASE role WHEN 'user' THEN GREATEST(a, 2) WHEN 'assistant' THEN 10 ELSE GREATEST(a, 1) END) + 1 AS qubits,
         CAST(SUM(CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 2 * r ELSE 0 END) AS BIGINT) AS measurements, CAST(SUM(CASE WHEN role = 'assistant' THEN r ELSE 0 END) AS BIGINT) AS detectors,
         COALESCE(MAX(CASE WHEN role = 'assistant' THEN turn END) + 1, 0) AS observables, CAST(SUM(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS ticks,
         COALESCE(MAX(CASE WHEN role = 'user' THEN a END) + 1, 0) AS sweep_bits, MAX(CASE WHEN role = 'assistant' THEN 2 ELSE 0 END)::BIGINT AS max_lookback FROM ({CONV}) GROUP BY 1""")
def _(fx):
    return md.circuit_stats(circuit(fx))


@query("mdl20_qubit_coordinates", f"""
  SELECT circuit_id, a AS qubit, arg_max(CAST(c AS DOUBLE) + sx, turn) AS x, arg_max(CAST(turn AS DOUBLE) + sy, turn) AS y FROM (
    SELECT *, CASE WHEN role = 'user' THEN 2 ELSE 1 END AS c, COALESCE(SUM(CASE WHEN role = 'assistant' THEN r ELSE 0 END) OVER w, 0) AS sx, COALESCE(SUM(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER w, 0) AS sy
    FROM ({CONV}) WINDOW w AS (PARTITION BY circuit_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE role <> 'assistant' GROUP BY 1, 2""")
def _(fx):
    q = md.qubit_coordinates(circuit(fx))
    return q.select("circuit_id", "qubit", F.get("coords", F.lit(0)).alias("x"), F.get("coords", F.lit(1)).alias("y"))


@query("win1_resolve_record_index", """
  SELECT circuit_id, seq, CAST(k AS INT) AS lookback, CAST(before - k AS BIGINT) AS meas FROM (
    SELECT circuit_id, seq, op, n, COALESCE(SUM(CASE WHEN op = 'M' THEN n ELSE 0 END) OVER (PARTITION BY circuit_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM fx_instr),
    LATERAL (SELECT unnest(range(1, n + 1)) AS k) WHERE op = 'DETECTOR'""")
def _(fx):
    is_m = F.col("op") == "M"
    work = fx.fx_instr.select(
        "circuit_id", "seq", F.when(is_m, F.col("n")).otherwise(0).alias("n_meas"),
        F.when(F.col("op") == "DETECTOR", F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>")).alias("lookbacks"),
    )
    return md.resolve_record_index(work)


@query("win2_resolve_detector_index", """
  SELECT circuit_id, seq, CAST(det AS BIGINT) AS det FROM (SELECT circuit_id, seq, op, COALESCE(SUM(CASE op WHEN 'DETECTOR' THEN 1 WHEN 'SHIFT_COORDS' THEN n ELSE 0 END)
    OVER (PARTITION BY circuit_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS det FROM fx_instr) WHERE op = 'DETECTOR'""")
def _(fx):
    work = fx.fx_instr.select(
        "circuit_id", "seq", "op", F.when(F.col("op") == "DETECTOR", 1).otherwise(0).alias("n_det"), F.when(F.col("op") == "SHIFT_COORDS", F.col("n")).otherwise(0).alias("shift")
    )
    return md.resolve_detector_index(work).filter("op = 'DETECTOR'").select("circuit_id", "seq", "det")


@query("flt9_drop_tags", "SELECT model_id, seq, '' AS tag FROM fx_model_line")
def _(fx):
    return md.drop_tags(model(fx)).select("model_id", "seq", "tag")


@query("flt10_round_model", TEXT_SQL.replace("CAST(NULLIF(regexp_extract(line, '\\(([^,)]*)', 1), '') AS DOUBLE) AS arg0",
       "CASE WHEN LOWER(line) LIKE '%error%(%' THEN ROUND(CAST(NULLIF(regexp_extract(line, '\\(([^,)]*)', 1), '') AS DOUBLE), 2) ELSE CAST(NULLIF(regexp_extract(line, '\\(([^,)]*)', 1), '') AS DOUBLE) END AS arg0"))
def _(fx):
    return show(md.round_model(model(fx), 2), ["model_id", "seq", "reps"])


@query("flt11_without_noise", f"""
  SELECT circuit_id, turn * 8 + k AS seq, CASE WHEN role = 'user' AND k = 1 THEN CAST(0 AS INT) ELSE NULL END AS n_args FROM ({CONV}), LATERAL (SELECT unnest(range(CASE role WHEN 'system' THEN 3 ELSE 6 END)) AS k)
  WHERE NOT (role = 'user' AND k = 0)""".replace("CASE WHEN role = 'user' AND k = 1 THEN CAST(0 AS INT) ELSE NULL END AS n_args",
       "CAST(CASE role WHEN 'system' THEN [2, 0, 2][k + 1] WHEN 'user' THEN [0, 0, 0, 0, 0, 2][k + 1] ELSE [0, 0, 2, 1, 0, 1][k + 1] END AS INT) AS n_args"))
def _(fx):
    return md.without_noise(circuit(fx)).select("circuit_id", "seq", F.size("args").alias("n_args"))


@query("flt12_find_silent_errors", """
  SELECT err_id, COUNT(*) AS n_obs FROM (SELECT err_id, kind, idx FROM fx_tgt GROUP BY 1, 2, 3 HAVING COUNT(*) % 2 = 1) GROUP BY 1 HAVING COUNT(*) FILTER (kind = 'D') = 0 AND COUNT(*) FILTER (kind = 'L') > 0""")
def _(fx):
    return md.find_silent_errors(fx.fx_tgt)


@query("flt17_slice_instructions", """
  SELECT model_id, seq FROM (SELECT model_id, seq, ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY seq) - 1 AS p FROM fx_model_line) WHERE p IN (2, 5, 8, 11, 14)""")
def _(fx):
    return md.slice_instructions(model(fx), "model_id", 2, 3, 5).select("model_id", "seq")


@query("set4_concat_models", FLAT + """
  SELECT f.model_id, 0 AS part, targets FROM flat f UNION ALL
  SELECT f.model_id, 1, CASE WHEN name = 'logical_observable' THEN targets ELSE array_to_string([CASE WHEN x LIKE 'D%' THEN CONCAT('D', CAST(CAST(x[2:] AS BIGINT) + j AS VARCHAR)) ELSE x END FOR x IN string_split(targets, ' ')], ' ') END
  FROM flat f JOIN (SELECT model_id, SUM(jump) AS j FROM ev GROUP BY 1) t ON t.model_id = f.model_id""")
def _(fx):
    m = cut(model(fx), "parsed")
    flat = md.flatten_model(md.concat_models(m, m))
    end = m.groupBy("model_id").agg(F.max("seq").alias("hi"))
    return flat.join(end, "model_id").select("model_id", (F.col("path")[0] > F.col("hi")).cast("int").alias("part"), F.array_join("targets", " ").alias("targets"))


@query("set4_repeat_model", f"SELECT model_id, CAST(3 * SUM(jump) AS BIGINT) AS det_shift FROM ({EV}) GROUP BY 1")
def _(fx):
    return md.total_shift(md.repeat_model(model(fx), 3)).select("model_id", "det_shift")


@query("set5_model_diff", """
  SELECT model_id, seq, CASE WHEN line LIKE 'detector%' THEN 'removed' ELSE 'changed' END AS change FROM fx_model_line WHERE line LIKE 'detector%' OR line LIKE 'ERROR%'""")
def _(fx):
    m = model(fx)
    other = m.filter("name <> 'detector'").withColumn(
        "args", F.when(F.array_contains("targets", "^"), F.transform("args", lambda a: a + 0.01)).otherwise(F.transform("args", lambda a: a + 1e-9))
    )
    return md.model_diff(m, other, 1e-6)


@query("mdl10_validate_for_correlations", f"""
  WITH c AS (SELECT * FROM ({COMP_SQL})), n AS (SELECT err_id, MAX(comp) + 1 AS k FROM fx_tgt GROUP BY 1)
  SELECT err_id, 'probability above one half' AS reason FROM fx_err WHERE p * 3 > 0.5
  UNION ALL SELECT DISTINCT err_id, 'three or more detectors' FROM c WHERE n_det > 2
  UNION ALL SELECT DISTINCT c.err_id, 'undetectable component' FROM c JOIN n ON n.err_id = c.err_id WHERE n_det = 0 AND k > 1""")
def _(fx):
    return md.validate_for_correlations(fx.fx_err.withColumn("p", F.col("p") * 3), fx.fx_tgt)


@query("agg22_detectors_per_round", "SELECT COUNT(*) AS rounds, CASE WHEN MIN(n) = MAX(n) THEN MIN(n) END AS per_round, MIN(n) = MAX(n) AS uniform FROM (SELECT round_id, COUNT(*) AS n FROM fx_det GROUP BY 1)")
def _(fx):
    return md.detectors_per_round(fx.fx_det)
