"""Registered queries over matching graphs."""

from pyspark.sql import functions as F

from ..functions import bits
from ..functions import numeric as num
from ..operators import graph as gr
from ..operators import parity as pa
from .q_model import COMP_SQL, RAW_EDGES, errors, raw_edges
from .registry import query

BOUNDARY = 24


def distance_sql(rounds: int = 12, edges: str = "fx_edge") -> str:
    """Bellman-Ford rounds over the edge fixture as a chain of CTEs ending in d{rounds}."""
    out = f"""adj AS (SELECT u, v, w, CAST(obs_mask AS BIGINT) AS o FROM {edges} WHERE u <> v AND u <> 24 UNION ALL SELECT v, u, w, CAST(obs_mask AS BIGINT) FROM {edges} WHERE u <> v AND v <> 24),
  d0 AS (SELECT DISTINCT u AS src, u AS node, {{'dist': 0::BIGINT, 'hops': 0, 'prev': u, 'obs': 0::BIGINT}} AS l FROM adj)"""
    for r in range(rounds):
        out += f""", d{r + 1} AS (SELECT src, node, MIN(l) AS l FROM (SELECT src, node, l FROM d{r} UNION ALL
    SELECT d.src, a.v, {{'dist': d.l.dist + a.w, 'hops': d.l.hops + 1, 'prev': a.u, 'obs': xor(d.l.obs, a.o)}} FROM d{r} d JOIN adj a ON a.u = d.node) GROUP BY 1, 2)"""
    return out + f", paths AS (SELECT src, node, l.dist AS dist, l.hops AS hops, l.prev AS prev, l.obs AS obs FROM d{rounds})"


def columns(fx):
    """Check matrix of the mechanisms: one column per component, two columns a mechanism."""
    net = pa.xor_reduce(fx.fx_tgt, ["err_id", "comp", "kind", "idx"]).withColumn("col", F.col("err_id") * 2 + F.col("comp"))
    checks = net.filter("kind = 'D'").select(F.col("idx").alias("row"), "col")
    faults = net.filter("kind = 'L'").select(F.col("idx").alias("fault"), "col")
    return gr.read_check_matrix(checks, faults)


COLS_SQL = """
  SELECT err_id * 2 + comp AS col, COUNT(*) FILTER (kind = 'D') AS n_checks, MIN(idx) FILTER (kind = 'D') AS u, CASE WHEN COUNT(*) FILTER (kind = 'D') >= 2 THEN MAX(idx) FILTER (kind = 'D') END AS v,
         CAST(COUNT(*) FILTER (kind = 'L') AS BIGINT) AS obs_mask
  FROM (SELECT err_id, comp, kind, idx FROM fx_tgt GROUP BY 1, 2, 3, 4 HAVING COUNT(*) % 2 = 1) GROUP BY 1"""


@query("src10_read_check_matrix", COLS_SQL)
def _(fx):
    return columns(fx).drop("last_fault_col")


@query("src11_read_edge_list", "SELECT d1 AS u, d2 AS v, CAST(1 AS DOUBLE) AS w, p, CASE WHEN obs_mask = 1 THEN CAST(5 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS obs_mask, err_id AS seq FROM fx_err")
def _(fx):
    attrs = fx.fx_err.select(
        F.col("d1").alias("u"), F.col("d2").alias("v"), F.col("p").alias("error_probability"),
        F.when(F.col("obs_mask") == 1, F.array(F.lit(0), F.lit(2))).alias("fault_ids"), F.col("err_id").alias("seq"),
    )
    return gr.read_edge_list(attrs)


@query("src10_wide_observables", f"""
  SELECT col, CAST(n_checks AS BIGINT) AS n_checks, CASE WHEN obs_mask = 1 THEN CASE WHEN col % 4 = 0 THEN '70' ELSE '130' END ELSE '' END AS observables FROM ({COLS_SQL})""")
def _(fx):
    net = pa.xor_reduce(fx.fx_tgt, ["err_id", "comp", "kind", "idx"]).withColumn("col", F.col("err_id") * 2 + F.col("comp"))
    faults = net.filter("kind = 'L'").select(F.when(F.col("col") % 4 == 0, 70).otherwise(130).alias("fault"), "col")
    found = gr.read_check_matrix(net.filter("kind = 'D'").select(F.col("idx").alias("row"), "col"), faults)
    return found.select("col", F.col("n_checks").cast("bigint").alias("n_checks"), F.array_join(bits.indices(F.col("obs_mask")).cast("array<string>"), " ").alias("observables"))


@query("mdl6_edges_from_check_matrix", f"""
  WITH c AS ({COLS_SQL}), n AS (SELECT 2 * MAX(err_id) + 2 AS n_cols FROM fx_err), e AS (
    SELECT u + 24 * rep AS u, CASE WHEN n_checks = 2 THEN v + 24 * rep ELSE 72 END AS v, CAST(ROUND(1000 * ln((1 - p) / p) / 50) AS DOUBLE) AS w, p, c.obs_mask, rep * n_cols + col AS seq
    FROM c JOIN fx_err ON err_id = col // 2, n, (SELECT unnest([0, 1, 2]) AS rep) WHERE n_checks IN (1, 2)
    UNION ALL SELECT det + 24 * rep, det + 24 * rep + 24, 40.0 + det, 0.01, 0, 3 * n_cols + 24 * rep + det FROM fx_det, n, (SELECT unnest([0, 1]) AS rep))
  SELECT CAST(u AS BIGINT) AS u, CAST(v AS BIGINT) AS v, r.w AS w, r.p AS p, r.o AS obs_mask FROM (
    SELECT u, v, arg_min(struct_pack(w := w, p := p, o := obs_mask), struct_pack(w := w, s := seq)) AS r FROM (SELECT LEAST(u, v) AS u, GREATEST(u, v) AS v, w, p, obs_mask, seq FROM e) GROUP BY 1, 2)""")
def _(fx):
    weights = raw_edges(fx).select(F.explode(F.array(F.col("seq") * 2, F.col("seq") * 2 + 1)).alias("col"), "w", "p")
    timelike = fx.fx_det.select(F.col("det").alias("row"), (40.0 + F.col("det")).alias("w"), F.lit(0.01).alias("p"))
    n_cols = 2 * fx.fx_err.agg(F.max("err_id")).first()[0] + 2
    return gr.edges_from_check_matrix(columns(fx), weights, 24, n_cols, 3, timelike)


@query("mdl7_boundary_collapse", f"""
  WITH e AS (SELECT CASE WHEN u >= 20 THEN v ELSE u END AS u, CASE WHEN u >= 20 OR v >= 20 OR v IS NULL THEN NULL ELSE v END AS v, w, p, obs_mask, seq
             FROM ({RAW_EDGES}) WHERE NOT (u >= 20 AND (v >= 20 OR v IS NULL)))
  SELECT u, v, w, p, obs_mask FROM e WHERE v IS NOT NULL
  UNION ALL SELECT u, NULL, r.w, r.p, r.o FROM (SELECT u, arg_min(struct_pack(w := w, p := p, o := obs_mask), struct_pack(w := w, s := seq)) AS r FROM e WHERE v IS NULL GROUP BY 1)""")
def _(fx):
    e = raw_edges(fx).withColumns({"u": F.when(F.col("v").isNull(), F.col("u")).otherwise(F.least("u", "v")), "v": F.when(F.col("v").isNotNull(), F.greatest("u", "v"))})
    return gr.boundary_collapse(e, fx.fx_det.filter("post_flag = 1").select(F.col("det").alias("node")))


NEG = "(SELECT u, v, w - 5200 AS w, obs_mask FROM fx_edge)"


def shifted_edges(fx):
    return fx.fx_edge.withColumn("w", F.col("w") - 5200)


@query("mdl8_normalize_negative_edges", f"""
  SELECT (SELECT COUNT(*) FROM {NEG} WHERE w < 0) AS negative, COALESCE((SELECT CAST(SUM(w) AS BIGINT) FROM {NEG} WHERE w < 0), 0) AS base_w, COALESCE((SELECT bit_xor(obs_mask) FROM {NEG} WHERE w < 0), 0) AS base_obs,
         (SELECT CAST(SUM(ABS(w)) AS BIGINT) FROM {NEG}) AS total""")
def _(fx):
    parts = gr.normalize_negative_edges(shifted_edges(fx))
    negative = shifted_edges(fx).agg(F.count_if(F.col("w") < 0)).scalar()
    return parts["base"].select(negative.alias("negative"), "base_w", "base_obs", parts["edges"].agg(F.sum("w")).scalar().alias("total"))


@query("mdl8_toggle_base_hits", f"""
  WITH b AS (SELECT det FROM (SELECT u AS det FROM {NEG} WHERE w < 0 UNION ALL SELECT v FROM {NEG} WHERE w < 0) GROUP BY 1 HAVING COUNT(*) % 2 = 1)
  SELECT shot_id, det FROM (SELECT shot_id, det FROM fx_hits UNION ALL SELECT shot_id, det FROM fx_shots CROSS JOIN b) GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1""")
def _(fx):
    base_hits = gr.normalize_negative_edges(shifted_edges(fx))["base_hits"]
    return gr.toggle_base_hits(fx.fx_shots, fx.fx_hits, base_hits)


@query("mdl12_to_graph_tables", """
  SELECT 'node' AS row_type, n AS a, CASE WHEN n = 24 THEN 1 ELSE 0 END AS b FROM (SELECT d1 AS n FROM fx_err UNION SELECT COALESCE(d2, 24) FROM fx_err)
  UNION ALL SELECT 'edge', d1, COALESCE(d2, 24) FROM fx_err""")
def _(fx):
    t = gr.to_graph_tables(fx.fx_err.select(F.col("d1").alias("u"), F.col("d2").alias("v")), BOUNDARY)
    nodes = t["nodes"].select(F.lit("node").alias("row_type"), F.col("node").alias("a"), F.col("is_boundary").cast("int").alias("b"))
    return nodes.unionByName(t["edges"].select(F.lit("edge").alias("row_type"), F.col("u").alias("a"), F.col("v").alias("b")))


@query("mdl21_set_boundary", "SELECT n AS node, n IN (SELECT det FROM fx_det WHERE round_id = 2) AS is_boundary FROM (SELECT d1 AS n FROM fx_err UNION SELECT COALESCE(d2, 24) FROM fx_err UNION SELECT det FROM fx_det WHERE round_id = 2)")
def _(fx):
    nodes = gr.to_graph_tables(fx.fx_err.select(F.col("d1").alias("u"), F.col("d2").alias("v")), BOUNDARY)["nodes"]
    return gr.set_boundary(nodes, fx.fx_det.filter("round_id = 2").select(F.col("det").alias("node")))


@query("agg17_graph_properties", """
  SELECT (SELECT COUNT(*) FROM (SELECT u FROM fx_edge UNION SELECT v FROM fx_edge)) AS nodes, (SELECT COUNT(*) FROM (SELECT u FROM fx_edge UNION SELECT v FROM fx_edge) WHERE u <> 24) AS detectors, COUNT(*) AS edges, CAST(5 AS INT) AS fault_ids, MAX(ABS(w)) AS max_abs_weight, TRUE AS all_have_probability FROM fx_edge""")
def _(fx):
    edges = fx.fx_edge.withColumn("p", num.p_from_weight(F.col("w") / 1000))
    rim = edges.filter(F.col("v") == BOUNDARY).select(F.col("v").alias("node"))
    return gr.graph_properties(edges, rim, min_observables=5)


@query("agg17_wide_observables", "SELECT COUNT(*) AS edges, CAST(MAX(CASE WHEN obs_mask = 1 THEN 131 ELSE 71 END) AS INT) AS fault_ids FROM fx_edge")
def _(fx):
    ids = F.when(F.col("obs_mask") == 1, F.array(F.lit(70), F.lit(130))).otherwise(F.array(F.lit(70)))
    edges = gr.read_edge_list(fx.fx_edge.select("u", "v", F.col("w").alias("weight"), ids.alias("fault_ids"), F.lit(0).alias("seq")))
    return gr.graph_properties(edges).select("edges", "fault_ids")


JOINT = f"""
  WITH c AS (SELECT err_id, comp, u, COALESCE(v, -1) AS v, p FROM ({COMP_SQL}) WHERE n_det IN (1, 2) AND p > 0),
  joint AS (SELECT a.u AS u0, a.v AS v0, b.u AS u1, b.v AS v1, 0.5 * (1 - product(1 - 2 * a.p)) AS p FROM c a JOIN c b ON a.err_id = b.err_id GROUP BY 1, 2, 3, 4)"""


@query("agg18_joint_edge_probabilities", JOINT + " SELECT u0, v0, u1, v1, ROUND(p, 9) AS p FROM joint")
def _(fx):
    return gr.joint_edge_probabilities(fx.fx_err, fx.fx_tgt).withColumn("p", F.round("p", 9))


@query("mdl9_implied_weights", JOINT + """
  SELECT a.u0 AS cu, a.v0 AS cv, a.u1 AS au, a.v1 AS av, ROUND(ln((1 - LEAST(0.5, a.p / m.p)) / LEAST(0.5, a.p / m.p)), 6) AS w
  FROM joint a JOIN joint m ON m.u0 = a.u0 AND m.v0 = a.v0 AND m.u1 = a.u0 AND m.v1 = a.v0 WHERE NOT (a.u0 = a.u1 AND a.v0 = a.v1)""")
def _(fx):
    return gr.implied_weights(gr.joint_edge_probabilities(fx.fx_err, fx.fx_tgt)).withColumn("w", F.round("w", 6))


def locations(fx):
    """Every mechanism's target set doubles as the location table; several mechanisms share a set."""
    canon = pa.canonical_targets(fx.fx_tgt, "err_id").withColumn("targets_key", pa.targets_text(F.col("targets")))
    return canon.select("targets_key", F.col("err_id").alias("loc_id"), (F.col("err_id") % 3).alias("n_pauli"), (F.col("err_id") % 2).alias("n_meas"), (F.col("err_id") * 11 % 17).alias("tick"))


LOC_SQL = """
  SELECT string_agg(CONCAT(kind, CAST(idx AS VARCHAR)), ' ' ORDER BY kind, idx) AS targets_key, err_id AS loc_id, err_id % 3 AS n_pauli, err_id % 2 AS n_meas, err_id * 11 % 17 AS tick
  FROM (SELECT err_id, kind, idx FROM fx_tgt GROUP BY 1, 2, 3 HAVING COUNT(*) % 2 = 1) GROUP BY err_id"""
WANTED = "SELECT DISTINCT CONCAT('D', CAST(det AS VARCHAR), ' D', CAST(meas AS VARCHAR)) AS targets_key FROM fx_det_def"


def wanted(fx):
    return fx.fx_det_def.select(F.concat(F.lit("D"), "det", F.lit(" D"), "meas").alias("targets_key")).distinct()


@query("jn7_explain_errors", f"SELECT w.targets_key, loc_id, n_pauli, n_meas, tick FROM ({WANTED}) w LEFT JOIN ({LOC_SQL}) l ON l.targets_key = w.targets_key")
def _(fx):
    return gr.explain_errors(wanted(fx), locations(fx))


@query("jn7_explain_errors_single", f"""
  SELECT w.targets_key, r.loc_id AS loc_id, r.n_pauli AS n_pauli, r.n_meas AS n_meas, r.tick AS tick FROM ({WANTED}) w
  LEFT JOIN (SELECT targets_key, arg_min(l, struct_pack(a := -n_meas, b := n_pauli, c := loc_id)) AS r FROM ({LOC_SQL}) l GROUP BY 1) s ON s.targets_key = w.targets_key""")
def _(fx):
    return gr.explain_errors(wanted(fx), locations(fx), single=True)


@query("srt4_simplest_location", f"SELECT targets_key, arg_min(loc_id, struct_pack(a := -n_meas, b := n_pauli, c := loc_id)) AS loc_id FROM ({LOC_SQL}) GROUP BY 1")
def _(fx):
    return gr.simplest_location(locations(fx)).select("targets_key", "loc_id")


@query("mdl13_components", """
  WITH RECURSIVE adj AS (SELECT u, v FROM fx_local WHERE v IS NOT NULL UNION ALL SELECT v, u FROM fx_local WHERE v IS NOT NULL),
  reach AS (SELECT shot_id, det AS src, det FROM fx_hits UNION SELECT r.shot_id, r.src, h.det FROM reach r JOIN adj ON adj.u = r.det JOIN fx_hits h ON h.shot_id = r.shot_id AND h.det = adj.v)
  SELECT shot_id, cluster, COUNT(*) AS size, COUNT(*) % 2 = 1 AS odd, bool_or(src IN (SELECT u FROM fx_local WHERE v IS NULL)) AS touches_boundary
  FROM (SELECT shot_id, src, MIN(det) AS cluster FROM reach GROUP BY 1, 2) GROUP BY 1, 2""")
def _(fx):
    return gr.hit_components(fx.fx_hits, fx.fx_local)


@query("mdl14_undecodable_shots", """
  WITH RECURSIVE adj AS (SELECT u, v FROM fx_local WHERE v IS NOT NULL UNION ALL SELECT v, u FROM fx_local WHERE v IS NOT NULL),
  reach AS (SELECT det AS src, det AS node FROM (SELECT DISTINCT det FROM fx_hits) UNION SELECT u, u FROM adj UNION SELECT r.src, adj.v FROM reach r JOIN adj ON adj.u = r.node),
  parts AS (SELECT src AS det, MIN(node) AS part, bool_or(node IN (SELECT u FROM fx_local WHERE v IS NULL)) AS rim FROM reach GROUP BY 1)
  SELECT shot_id, COUNT(*) AS odd_parts FROM (SELECT shot_id, part FROM fx_hits JOIN parts USING (det) WHERE NOT rim GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1) GROUP BY 1""")
def _(fx):
    return gr.undecodable_shots(fx.fx_hits, fx.fx_local)


def paths(fx):
    return gr.pair_distances(fx.fx_edge, BOUNDARY)


@query("mdl15_pair_distances", f"WITH {distance_sql()} SELECT * FROM paths")
def _(fx):
    return paths(fx)


@query("mdl16_path_edges", f"""
  WITH RECURSIVE {distance_sql()}, walk AS (SELECT src, node, node AS cur FROM paths WHERE src <> node
    UNION ALL SELECT w.src, w.node, p.prev FROM walk w JOIN paths p ON p.src = w.src AND p.node = w.cur WHERE w.cur <> w.src)
  SELECT w.src, w.node, LEAST(p.prev, w.cur) AS u, GREATEST(p.prev, w.cur) AS v FROM walk w JOIN paths p ON p.src = w.src AND p.node = w.cur WHERE w.cur <> w.src""")
def _(fx):
    p = paths(fx)
    return gr.path_edges(p, p)


@query("mdl17_shortest_undetectable", """
  WITH e AS (SELECT u, v, obs_mask AS o FROM fx_edge WHERE v < 24 UNION ALL SELECT u, NULL, obs_mask FROM fx_edge WHERE v = 24), d AS (SELECT u, v, o FROM e WHERE v IS NOT NULL UNION ALL SELECT v, u, o FROM e WHERE v IS NOT NULL)
  SELECT CASE WHEN (SELECT COUNT(*) FROM d a JOIN d b ON b.u = a.v JOIN d c ON c.u = b.v AND c.v = a.u WHERE (a.o + b.o + c.o) % 2 = 1) > 0
         OR (SELECT COUNT(*) FROM e a JOIN d b ON b.u = a.u JOIN e c ON c.u = b.v WHERE a.v IS NULL AND c.v IS NULL AND (a.o + b.o + c.o) % 2 = 1) > 0 THEN CAST(3 AS BIGINT) END AS n_edges,
         CAST(0 AS BIGINT) AS open_detectors, CAST(1 AS BIGINT) AS obs""")
def _(fx):
    edges = fx.fx_edge.select("u", F.when(F.col("v") != BOUNDARY, F.col("v")).alias("v"), "obs_mask")
    found = gr.shortest_undetectable(edges)
    left = pa.xor_reduce(found.select(F.explode("dets").alias("d")), ["d"]).agg(F.count("*")).scalar()
    return found.agg(F.count("*").alias("n_edges"), F.bit_xor("obs").alias("obs")).select("n_edges", left.alias("open_detectors"), "obs")


def undetectable_sql(variant: int, where: str, obs: str) -> str:
    """Length of the shortest closed walk of odd observable parity, found apart from the operator: walks over (node, parity) from every
    node, where the boundary is a node like others; an edge met again with the other observables is a second edge."""
    return f"""SELECT {variant} AS variant, (WITH RECURSIVE e AS (SELECT u, v, {obs} AS o FROM fx_edge WHERE {where}), adj AS (SELECT u, v, o FROM e UNION SELECT v, u, o FROM e),
    walk AS (SELECT u AS s, u AS node, 0 AS o, 0 AS n FROM adj UNION SELECT w.s, b.v, xor(w.o, b.o), w.n + 1 FROM walk w JOIN adj b ON b.u = w.node WHERE w.n < 8)
    SELECT CAST(MIN(n) AS BIGINT) FROM walk WHERE node = s AND o = 1) AS n_edges"""


#: Filters and observables of the edge fixture: whole; each edge twice with different observables; only edges between odd and even nodes; a chain with bridges over four edges.
UNDETECTABLE = [
    ("TRUE", "CAST(obs_mask AS INT)"), ("TRUE", "unnest([0, 1])"), ("(u + v) % 2 = 1", "CAST(obs_mask AS INT)"), ("v - u IN (1, 4)", "CASE WHEN v - u = 4 THEN 1 ELSE 0 END"),
]


@query("mdl17_lengths", " UNION ALL ".join(f"SELECT variant, n_edges, CAST(0 AS BIGINT) AS open_detectors, n_edges IS NOT NULL AS flips FROM ({undetectable_sql(i, w, o)})" for i, (w, o) in enumerate(UNDETECTABLE)))
def _(fx):
    out = None
    for i, (where, obs) in enumerate(UNDETECTABLE):
        value = F.explode(F.array(F.lit(0), F.lit(1))) if "unnest" in obs else F.expr(obs)
        edges = fx.fx_edge.filter(where).withColumn("o", value).select("u", F.when(F.col("v") != BOUNDARY, F.col("v")).alias("v"), F.col("o").cast("bigint").alias("obs_mask"))
        found = gr.shortest_undetectable(edges)
        left = pa.xor_reduce(found.select(F.explode("dets").alias("d")), ["d"]).agg(F.count("*")).scalar()
        row = found.agg(F.count("*").alias("n_edges"), (F.bit_xor("obs") != 0).alias("flips")).select(F.lit(i).alias("variant"), "n_edges", left.alias("open_detectors"), "flips")
        out = row if out is None else out.unionByName(row)
    return out


@query("mdl18_pairs_of_mechanisms", """
  WITH net AS (SELECT err_id, kind, idx FROM fx_tgt GROUP BY 1, 2, 3 HAVING COUNT(*) % 2 = 1),
  m AS (SELECT DISTINCT COALESCE(bit_or(1::BIGINT << idx) FILTER (kind = 'D'), 0) AS d, COALESCE(bit_or(1::BIGINT << idx) FILTER (kind = 'L'), 0) AS o FROM net GROUP BY err_id)
  SELECT CASE WHEN COUNT(*) > 0 THEN CAST(2 AS BIGINT) END AS n_mechanisms, CAST(0 AS BIGINT) AS open_detectors, COUNT(*) > 0 AS flips FROM m a JOIN m b ON a.d = b.d AND a.o < b.o WHERE a.d <> 0""")
def _(fx):
    found = gr.undetectable_hyper(gr.hyperedges(fx.fx_tgt).filter(F.size("dets") > 0), 6, 5)
    left = pa.xor_reduce(found.select(F.explode("dets").alias("d")), ["d"]).agg(F.count("*")).scalar()
    return found.agg(F.count("*").alias("n_mechanisms"), (F.bit_xor("obs") != 0).alias("flips")).select("n_mechanisms", left.alias("open_detectors"), "flips")


@query("mdl18_undetectable_hyper", """
  SELECT '' AS dets, CAST(1 AS BIGINT) AS obs WHERE EXISTS (
    SELECT err_id FROM (SELECT err_id, kind, idx FROM fx_tgt GROUP BY 1, 2, 3 HAVING COUNT(*) % 2 = 1) GROUP BY 1 HAVING COUNT(*) FILTER (kind = 'D') = 0 AND COUNT(*) FILTER (kind = 'L') = 1)""")
def _(fx):
    found = gr.undetectable_hyper(gr.hyperedges(fx.fx_tgt), 6, 5)
    return found.select(F.array_join(F.transform("dets", lambda d: d.cast("string")), " ").alias("dets"), "obs")


@query("mdl19_missing_probability", "SELECT err_id FROM fx_err WHERE p <= 0.02")
def _(fx):
    return gr.missing_probability_edges(fx.fx_err.withColumn("p", F.when(F.col("p") > 0.02, F.col("p")))).select("err_id")
