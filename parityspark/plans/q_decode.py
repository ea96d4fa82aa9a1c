"""Registered queries over decoding and round windows."""

import numpy as np
from pyspark.sql import functions as F

from ..functions import bits
from ..lineage import cut
from ..operators import decode as dc
from ..operators import events as ev
from ..operators import graph as gr
from ..operators import windows as wn
from .q_graph import BOUNDARY, distance_sql
from .registry import query

SYN_SQL = "SELECT shot_id, list(det ORDER BY det) AS key FROM fx_hits GROUP BY 1"


def paths(fx):
    return gr.matching_paths(fx.fx_edge, BOUNDARY)


def key_text(df):
    return df.withColumn("key", F.array_join(F.transform("key", lambda d: d.cast("string")), " "))


def matching_sql(rounds: int = 24, edges: str = "fx_edge", syndromes: str = SYN_SQL) -> str:
    """Exact matching of every syndrome as a chain of CTEs ending in best(k, key, w, obs, c).

    A round matches the lowest open hit to the boundary or to another open hit and keeps the best way into
    each remaining set; ties go to the boundary, then to the lowest partner, for the lowest hit first.
    """
    out = f"""{distance_sql(edges=edges)}, keys AS (SELECT DISTINCT key AS k, CAST(list_sum([1::BIGINT << d FOR d IN key]) AS BIGINT) AS m FROM ({syndromes})),
  opts AS (SELECT src, CASE WHEN node = 24 THEN -1 ELSE node END AS b, CASE WHEN node = 24 THEN 0::BIGINT ELSE 1::BIGINT << node END AS bit, dist, obs FROM paths WHERE src <> node),
  m0 AS (SELECT k, m AS rem, {{'w': 0::BIGINT, 'c': CAST([] AS STRUCT(a INT, b INT)[]), 'o': 0::BIGINT}} AS s FROM keys)"""
    for r in range(rounds):
        out += f""", m{r + 1} AS (SELECT k, rem & ~((1::BIGINT << low) | bit) AS rem, MIN({{'w': s.w + dist, 'c': list_append(s.c, {{'a': low, 'b': b}}), 'o': xor(s.o, obs)}}) AS s
    FROM (SELECT k, rem, s, CAST(bit_count((rem & -rem) - 1) AS INT) AS low FROM m{r} WHERE rem <> 0) x JOIN opts ON src = low AND (b = -1 OR (rem & bit) <> 0) GROUP BY 1, 2)"""
    done = " UNION ALL ".join(f"SELECT k, s FROM m{r + 1} WHERE rem = 0" for r in range(rounds))
    return out + f", best AS (SELECT k, CAST(s.w AS DOUBLE) AS w, s.o AS obs, s.c AS c FROM (SELECT k, MIN(s) AS s FROM ({done}) GROUP BY 1))"


def greedy_sql(rounds: int = 16) -> str:
    """Greedy matching as repeated picks of the cheapest open option, ending in picked(k, s)."""
    out = f"""{distance_sql()}, keys AS (SELECT DISTINCT key AS k FROM ({SYN_SQL})), loc AS (
    SELECT k, det, p.dist AS rim, p.obs AS ro FROM (SELECT k, unnest(k) AS det FROM keys) h LEFT JOIN paths p ON p.src = det AND p.node = 24),
  o0 AS (SELECT a.k, a.det AS lo, b.det AS hi, p.dist AS d, p.obs AS o FROM loc a JOIN loc b ON a.k = b.k AND a.det < b.det JOIN paths p ON p.src = a.det AND p.node = b.det
           WHERE a.rim IS NULL OR b.rim IS NULL OR p.dist < a.rim + b.rim
         UNION ALL SELECT k, 24, det, rim, ro FROM loc WHERE rim IS NOT NULL)"""
    for r in range(rounds):
        out += f""", p{r} AS (SELECT k, MIN({{'d': d, 'lo': lo, 'hi': hi, 'o': o}}) AS s FROM o{r} GROUP BY 1),
  o{r + 1} AS (SELECT o.* FROM o{r} o JOIN p{r} p ON o.k = p.k WHERE (o.lo = 24 OR (o.lo <> p.s.lo AND o.lo <> p.s.hi)) AND o.hi <> p.s.hi AND o.hi <> p.s.lo)"""
    return out + ", picked AS (" + " UNION ALL ".join(f"SELECT * FROM p{r}" for r in range(rounds)) + ")"


KEY_TEXT = "array_to_string(k, ' ')"
PAIRS_SQL = "pairs AS (SELECT k, p.a AS a, p.b AS b FROM (SELECT k, unnest(c) AS p FROM best))"


@query("dec1_distinct_syndromes", f"SELECT array_to_string(key, ' ') AS key, COUNT(*) AS n FROM ({SYN_SQL}) GROUP BY 1")
def _(fx):
    return key_text(dc.distinct_syndromes(dc.shot_syndromes(fx.fx_hits)))


def syndromes(fx):
    return cut(dc.distinct_syndromes(dc.shot_syndromes(fx.fx_hits)), "distinct")


@query("dec2_decode_exact", f"WITH {matching_sql()} SELECT {KEY_TEXT} AS key, w, obs, 'exact' AS reason FROM best")
def _(fx):
    return key_text(dc.decode_exact(syndromes(fx), paths(fx), BOUNDARY)).drop("pairs")


@query("dec2_decode_by_clusters", f"WITH {matching_sql()} SELECT {KEY_TEXT} AS key, w, obs, 'exact' AS reason FROM best")
def _(fx):
    return key_text(dc.decode_by_clusters(syndromes(fx), paths(fx), BOUNDARY)).drop("pairs")


@query("dec3_decode_greedy", f"""WITH {greedy_sql()}, tot AS (
    SELECT k, CAST(SUM(s.d) AS DOUBLE) AS w, bit_xor(s.o) AS obs, SUM(CASE WHEN s.lo = 24 THEN 1 ELSE 2 END) = len(k) AS whole FROM picked GROUP BY k)
  SELECT {KEY_TEXT} AS key, CASE WHEN whole THEN w END AS w, CASE WHEN whole THEN obs END AS obs, CASE WHEN whole THEN 'greedy' ELSE 'infeasible' END AS reason FROM tot""")
def _(fx):
    return key_text(dc.decode_greedy(syndromes(fx), paths(fx), BOUNDARY)).drop("pairs")


def solved(fx, p):
    return cut(dc.decode(syndromes(fx), p, BOUNDARY), "solved")


@query("dec4_matched_pairs", f"WITH {matching_sql()}, {PAIRS_SQL} SELECT {KEY_TEXT} AS key, a, CASE WHEN b >= 0 THEN b END AS b FROM pairs")
def _(fx):
    return key_text(dc.matched_pairs(solved(fx, paths(fx))))


@query("dec4_mates", f"""WITH {matching_sql()}, {PAIRS_SQL}
  SELECT {KEY_TEXT} AS key, a AS det, b AS mate FROM pairs UNION ALL SELECT {KEY_TEXT}, b, a FROM pairs WHERE b >= 0""")
def _(fx):
    return key_text(dc.mates(solved(fx, paths(fx))))


@query("dec5_solution_edges", f"""WITH RECURSIVE {matching_sql()}, {PAIRS_SQL}, walk AS (SELECT src, node, node AS cur FROM paths WHERE src <> node
    UNION ALL SELECT w.src, w.node, p.prev FROM walk w JOIN paths p ON p.src = w.src AND p.node = w.cur WHERE w.cur <> w.src),
  steps AS (SELECT w.src, w.node, LEAST(p.prev, w.cur) AS u, GREATEST(p.prev, w.cur) AS v FROM walk w JOIN paths p ON p.src = w.src AND p.node = w.cur WHERE w.cur <> w.src)
  SELECT {KEY_TEXT} AS key, s.u AS u, s.v AS v FROM pairs q JOIN steps s ON s.src = q.a AND s.node = CASE WHEN q.b < 0 THEN 24 ELSE q.b END GROUP BY 1, 2, 3 HAVING COUNT(*) % 2 = 1""")
def _(fx):
    p = paths(fx)
    return key_text(dc.solution_edges(dc.matched_pairs(solved(fx, p)), p, BOUNDARY))


@query("dec6_predictions", f"""WITH {matching_sql()}
  SELECT s.shot_id, CASE WHEN y.key IS NULL THEN 0 ELSE obs END AS pred_mask, CASE WHEN y.key IS NULL THEN CAST(0 AS DOUBLE) ELSE w END AS w,
         CASE WHEN y.key IS NULL THEN 'empty' ELSE 'exact' END AS reason
  FROM fx_shots s LEFT JOIN ({SYN_SQL}) y ON y.shot_id = s.shot_id LEFT JOIN best ON best.k = y.key""")
def _(fx):
    return dc.decode_shots(fx.fx_shots, fx.fx_hits, paths(fx), BOUNDARY)


FAR_EDGES = "we AS (SELECT u, v, w, CAST(obs_mask + CASE WHEN (u + v) % 5 = 0 THEN 2 ELSE 0 END AS BIGINT) AS obs_mask FROM fx_edge)"
FAR_TEXT = "CASE {} WHEN 0 THEN '' WHEN 1 THEN '70' WHEN 2 THEN '130' WHEN 3 THEN '70 130' END"


def far_edges(fx):
    """The edge fixture with observables 70 and 130."""
    far = F.concat(F.when(F.col("obs_mask") == 1, F.array(F.lit(70))).otherwise(F.array().cast("array<int>")), F.when((F.col("u") + F.col("v")) % 5 == 0, F.array(F.lit(130))).otherwise(F.array().cast("array<int>")))
    listed = gr.read_edge_list(fx.fx_edge.select("u", "v", F.col("w").alias("weight"), far.alias("fault_ids"), F.lit(0).alias("seq")))
    return listed.select("u", "v", F.col("w").cast("bigint").alias("w"), "obs_mask")


@query("dec6_wide_observables", f"""WITH {FAR_EDGES}, {matching_sql(edges="we")}
  SELECT s.shot_id, {FAR_TEXT.format("CASE WHEN y.key IS NULL THEN 0 ELSE obs END")} AS observables, CASE WHEN y.key IS NULL THEN CAST(0 AS DOUBLE) ELSE w END AS w
  FROM fx_shots s LEFT JOIN ({SYN_SQL}) y ON y.shot_id = s.shot_id LEFT JOIN best ON best.k = y.key""")
def _(fx):
    out = dc.decode_shots(fx.fx_shots, fx.fx_hits, gr.matching_paths(far_edges(fx), BOUNDARY), BOUNDARY)
    return out.select("shot_id", F.array_join(bits.indices(F.col("pred_mask")).cast("array<string>"), " ").alias("observables"), "w")


def null_rim(df):
    return df.withColumn("v", F.when(F.col("v") != BOUNDARY, F.col("v")))


def windows_sql(first: str, edges: str, per_round: int, starts: list[int], commit: int, window: int, exempt: str = "FALSE", rounds: int = 24) -> str:
    """Windowed decoding unrolled into CTEs ending in flips(shot_id, obs) and rest(shot_id, det).

    ``first`` and ``edges`` name tables (shot_id, det) and (u, v, w, obs_mask) with boundary 24; ``exempt`` says which boundary edges d stay open.
    """
    out, now = [], first
    for i, start in enumerate(starts):
        lo, hi, done = start * per_round, (start + window) * per_round, (start + commit) * per_round
        inside = f"det >= {lo} AND det < {hi}"
        out.append(f"syn{i} AS (SELECT shot_id, list(det ORDER BY det) AS key FROM {now} WHERE {inside} AND shot_id IN (SELECT shot_id FROM {now} WHERE det >= {lo} AND det < {done}) GROUP BY 1)")
        out.append(f"edge{i} AS (SELECT * FROM {edges} WHERE u >= {lo} AND u < {hi} AND (v = 24 OR (v >= {lo} AND v < {hi})))")
        out.append(f"""done{i} AS (WITH RECURSIVE {matching_sql(rounds, f"edge{i}", f"SELECT * FROM syn{i}")}, {PAIRS_SQL}, walk AS (SELECT src, node, node AS cur FROM paths WHERE src <> node
    UNION ALL SELECT w.src, w.node, p.prev FROM walk w JOIN paths p ON p.src = w.src AND p.node = w.cur WHERE w.cur <> w.src),
  steps AS (SELECT w.src, w.node, LEAST(p.prev, w.cur) AS u, GREATEST(p.prev, w.cur) AS v FROM walk w JOIN paths p ON p.src = w.src AND p.node = w.cur WHERE w.cur <> w.src)
  SELECT k, s.u AS u, s.v AS v FROM pairs q JOIN steps s ON s.src = q.a AND s.node = CASE WHEN q.b < 0 THEN 24 ELSE q.b END GROUP BY 1, 2, 3 HAVING COUNT(*) % 2 = 1)""")
        out.append(f"""app{i} AS (SELECT shot_id, d.u, d.v, e.obs_mask AS obs FROM syn{i} y JOIN done{i} d ON d.k = y.key JOIN edge{i} e ON e.u = d.u AND e.v = d.v
    WHERE (d.u < {done} OR (d.v <> 24 AND d.v < {done})) AND NOT (d.v = 24 AND ({exempt})))""")
        out.append(f"h{i + 1} AS (SELECT shot_id, det FROM (SELECT shot_id, det FROM {now} UNION ALL SELECT shot_id, u FROM app{i} UNION ALL SELECT shot_id, v FROM app{i} WHERE v < 24) GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1)")
        now = f"h{i + 1}"
    every = " UNION ALL ".join(f"SELECT shot_id, obs FROM app{i}" for i in range(len(starts)))
    return ", ".join(out) + f", flips AS (SELECT shot_id, CAST(bit_xor(obs) AS BIGINT) AS obs FROM ({every}) GROUP BY 1), rest AS (SELECT * FROM {now})"


WINDOWED_OUT = """SELECT s.shot_id, COALESCE(obs, 0) AS pred_mask, COALESCE(r.t, '') AS still_open
  FROM fx_shots s LEFT JOIN flips f ON f.shot_id = s.shot_id LEFT JOIN (SELECT shot_id, string_agg(CAST(det AS VARCHAR), ' ' ORDER BY det) AS t FROM rest GROUP BY 1) r ON r.shot_id = s.shot_id"""


def windowed_out(fx, out):
    rest = out["left"].groupBy("shot_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("det")), lambda d: d.cast("string")), " ").alias("t"))
    return out["predictions"].join(rest, "shot_id", "left").select("shot_id", "pred_mask", F.coalesce("t", F.lit("")).alias("still_open"))


@query("dec7_decode_windowed", f"WITH {windows_sql('fx_hits', 'fx_edge', 4, [0, 2, 4], 2, 4, rounds=16)} {WINDOWED_OUT}")
def _(fx):
    return windowed_out(fx, dc.decode_windowed(fx.fx_shots, fx.fx_hits, null_rim(fx.fx_edge), fx.fx_det, 24, 6, 2, 4))


@query("dec7_exempt_boundary", f"WITH {windows_sql('fx_hits', 'fx_edge', 4, [0, 2, 4], 2, 4, 'd.u % 4 = 3', rounds=16)} {WINDOWED_OUT}")
def _(fx):
    exempt = fx.fx_det.filter("base_det = 3").select("det")
    return windowed_out(fx, dc.decode_windowed(fx.fx_shots, fx.fx_hits, null_rim(fx.fx_edge), fx.fx_det, 24, 6, 2, 4, exempt=exempt))


#: Detectors of bases 0 and 1 make the inner code, numbered round * 2 + base; every detector has a number in the outer code.
INNER_NO, OUTER_NO = "(det // 4) * 2 + det % 4", "(det // 12) * 4 + det % 4"
TWO_LEVEL = f"""num AS (SELECT det, CASE WHEN det % 4 < 2 THEN {INNER_NO} END AS i, {OUTER_NO} AS o FROM fx_det),
  ie AS (SELECT LEAST(a.i, COALESCE(b.i, 24)) AS u, GREATEST(a.i, COALESCE(b.i, 24)) AS v, w, obs_mask FROM fx_edge JOIN num a ON a.det = u LEFT JOIN num b ON b.det = v WHERE a.i IS NOT NULL AND (v = 24 OR b.i IS NOT NULL)),
  oe AS (SELECT u, v, MIN({{'w': w, 'o': obs_mask}}).w AS w, MIN({{'w': w, 'o': obs_mask}}).o AS obs_mask FROM (
    SELECT LEAST(a.o, COALESCE(b.o, 24)) AS u, GREATEST(a.o, COALESCE(b.o, 24)) AS v, w, obs_mask FROM fx_edge JOIN num a ON a.det = fx_edge.u LEFT JOIN num b ON b.det = fx_edge.v) WHERE u <> v GROUP BY 1, 2),
  ih AS (SELECT shot_id, i AS det FROM fx_hits JOIN num USING (det) WHERE i IS NOT NULL),
  {windows_sql('ih', 'ie', 2, [0, 2, 4], 2, 4, 'TRUE', rounds=12)},
  oh AS (SELECT shot_id, det FROM (
    SELECT shot_id, o AS det FROM fx_hits JOIN num USING (det) WHERE i IS NULL
    UNION ALL SELECT h.shot_id, n.o FROM fx_hits h JOIN num n ON n.det = h.det JOIN rest r ON r.shot_id = h.shot_id AND r.det = n.i) GROUP BY 1, 2 HAVING COUNT(*) % 2 = 1),
  osyn AS (SELECT shot_id, list(det ORDER BY det) AS key FROM oh GROUP BY 1),
  outer_best AS (WITH {matching_sql(8, "oe", "SELECT * FROM osyn")} SELECT k, obs FROM best)"""


@query("dec8_decode_two_level", f"""WITH {TWO_LEVEL}
  SELECT s.shot_id, CAST(xor(COALESCE(f.obs, 0), COALESCE(b.obs, 0)) AS BIGINT) AS pred_mask
  FROM fx_shots s LEFT JOIN flips f ON f.shot_id = s.shot_id LEFT JOIN osyn y ON y.shot_id = s.shot_id LEFT JOIN outer_best b ON b.k = y.key""")
def _(fx):
    from .q_events import base_map

    routed = ev.route_two_level(fx.fx_hits, fx.fx_det, base_map(fx), 2, 2, 4)
    outer_no = (F.floor(F.col("round_id") / 3) * 4 + F.col("base_det")).cast("int")
    inner_no = F.when(F.col("base_det") < 2, F.col("round_id") * 2 + F.col("base_det"))
    numbers = cut(fx.fx_det.select("det", "round_id", inner_no.alias("i"), outer_no.alias("o")), "numbers")
    both = cut(routed.join(numbers.select("det", F.col("o").alias("outer_idx")), "det").select("shot_id", "stream", "idx", "outer_idx"), "routed")
    of = lambda c, end: numbers.select(F.col("det").alias(c), F.col("i").alias(f"i{end}"), F.col("o").alias(f"o{end}"))
    ends = cut(fx.fx_edge.join(of("u", 1), "u").join(of("v", 2), "v", "left"), "renumbered")
    inner = ends.filter(f"i1 IS NOT NULL AND (v = {BOUNDARY} OR i2 IS NOT NULL)").select(F.col("i1").alias("u"), F.col("i2").alias("v"), "w", "obs_mask")
    far = F.coalesce("o2", F.lit(BOUNDARY))
    outer = ends.select(F.least("o1", far).alias("u"), F.greatest("o1", far).alias("v"), "w", "obs_mask").filter("u <> v").groupBy("u", "v").agg(F.min(F.struct("w", "obs_mask")).alias("e")).select("u", "v", "e.*")
    rounds = numbers.filter("i IS NOT NULL").select(F.col("i").alias("det"), "round_id")
    return dc.decode_two_level(fx.fx_shots, both, inner, rounds, 12, 6, 2, 4, gr.matching_paths(outer, BOUNDARY), BOUNDARY)


def correlated_sql(relax: int = 8, rounds: int = 16) -> str:
    """Second pass over cheaper edges as CTEs after matching_sql and the pairs, ending in again(k, w, obs).

    An edge (u - 1, v) of the first solution halves the weight of (u, v).
    """
    out = f"""{PAIRS_SQL}, walk AS (SELECT src, node, node AS cur FROM paths WHERE src <> node
    UNION ALL SELECT w.src, w.node, p.prev FROM walk w JOIN paths p ON p.src = w.src AND p.node = w.cur WHERE w.cur <> w.src),
  steps AS (SELECT w.src, w.node, LEAST(p.prev, w.cur) AS u, GREATEST(p.prev, w.cur) AS v FROM walk w JOIN paths p ON p.src = w.src AND p.node = w.cur WHERE w.cur <> w.src),
  used AS (SELECT k, s.u AS u, s.v AS v FROM pairs q JOIN steps s ON s.src = q.a AND s.node = CASE WHEN q.b < 0 THEN 24 ELSE q.b END GROUP BY 1, 2, 3 HAVING COUNT(*) % 2 = 1),
  low AS (SELECT k, e.u, e.v, e.w / 2 AS w, CAST(e.obs_mask AS BIGINT) AS o FROM used JOIN fx_edge e ON used.u = e.u - 1 AND used.v = e.v),
  mv AS (SELECT k, u AS a, v AS b, w, o FROM low UNION ALL SELECT k, v, u, w, o FROM low WHERE v <> 24),
  seen AS (SELECT DISTINCT k FROM low), hit AS (SELECT k, unnest(k) AS src FROM seen),
  tg AS (SELECT k, src AS node FROM hit UNION SELECT k, a FROM mv UNION SELECT k, b FROM mv UNION SELECT k, 24 FROM seen),
  hop AS (SELECT m.k, m.b AS v, p.node, CAST(p.dist AS DOUBLE) AS d, p.obs AS o FROM (SELECT DISTINCT k, b FROM mv) m JOIN paths p ON p.src = m.b JOIN tg ON tg.k = m.k AND tg.node = p.node
    UNION ALL SELECT k, 24, 24, CAST(0 AS DOUBLE), 0 FROM seen),
  l0 AS (SELECT h.k, h.src, p.node, {{'d': CAST(p.dist AS DOUBLE), 'o': p.obs}} AS s FROM hit h JOIN paths p ON p.src = h.src JOIN tg ON tg.k = h.k AND tg.node = p.node)"""
    for r in range(relax):
        out += f""", x{r} AS (SELECT l.k, l.src, m.b AS v, MIN({{'d': l.s.d + m.w, 'o': xor(l.s.o, m.o)}}) AS s FROM l{r} l JOIN mv m ON m.k = l.k AND m.a = l.node GROUP BY 1, 2, 3),
  l{r + 1} AS (SELECT k, src, node, MIN(s) AS s FROM (SELECT * FROM l{r} UNION ALL SELECT x.k, x.src, h.node, {{'d': x.s.d + h.d, 'o': xor(x.s.o, h.o)}} FROM x{r} x JOIN hop h ON h.k = x.k AND h.v = x.v) GROUP BY 1, 2, 3)"""
    out += f""", opt2 AS (SELECT l.k, l.src, CASE WHEN l.node = 24 THEN -1 ELSE l.node END AS b, CASE WHEN l.node = 24 THEN 0::BIGINT ELSE 1::BIGINT << l.node END AS bit, s.d AS d, s.o AS o
    FROM l{relax} l WHERE l.node = 24 OR (l.src < l.node AND list_contains(l.k, l.node))),
  n0 AS (SELECT k, CAST(list_sum([1::BIGINT << d FOR d IN k]) AS BIGINT) AS rem, {{'w': CAST(0 AS DOUBLE), 'c': CAST([] AS STRUCT(a INT, b INT)[]), 'o': 0::BIGINT}} AS s FROM seen)"""
    for r in range(rounds):
        out += f""", n{r + 1} AS (SELECT x.k, rem & ~((1::BIGINT << low) | bit) AS rem, MIN({{'w': s.w + d, 'c': list_append(s.c, {{'a': low, 'b': b}}), 'o': xor(s.o, q.o)}}) AS s
    FROM (SELECT k, rem, s, CAST(bit_count((rem & -rem) - 1) AS INT) AS low FROM n{r} WHERE rem <> 0) x JOIN opt2 q ON q.k = x.k AND q.src = low AND (b = -1 OR (rem & bit) <> 0) GROUP BY 1, 2)"""
    done = " UNION ALL ".join(f"SELECT k, s FROM n{r + 1} WHERE rem = 0" for r in range(rounds))
    return out + f", again AS (SELECT k, s.w AS w, s.o AS obs FROM (SELECT k, MIN(s) AS s FROM ({done}) GROUP BY 1))"


@query("dec9_decode_correlated", f"""WITH RECURSIVE {matching_sql(rounds=16)}, {correlated_sql()}
  SELECT {KEY_TEXT} AS key, w, obs, 'correlated' AS reason FROM again UNION ALL SELECT {KEY_TEXT}, w, obs, 'exact' FROM best WHERE k NOT IN (SELECT k FROM seen)""")
def _(fx):
    # Each edge implies its neighbour at half the neighbour's weight.
    e = fx.fx_edge.select("u", "v", "w")
    nxt = e.select((F.col("u") - 1).alias("cu"), "v", F.col("u").alias("au"), (F.col("w") / 2).alias("w"))
    implied = nxt.filter("cu >= 0").select("cu", F.col("v").alias("cv"), "au", F.col("v").alias("av"), "w")
    return key_text(dc.decode_correlated(syndromes(fx), paths(fx), fx.fx_edge, implied, BOUNDARY))


@query("dec10_decode_vacuous", "SELECT shot_id, CAST(0 AS INT) AS pred_mask FROM fx_shots")
def _(fx):
    return dc.decode_vacuous(fx.fx_shots)


def lookup_decoder(path):
    """Plug-in example: XOR the boundary-edge observables of the hits; even totals of more than eight hits are discarded."""
    import pyarrow.dataset as ds

    table = ds.dataset(path.removeprefix("file:"), format="parquet").to_table(columns=["det", "obs"])
    obs = np.zeros(int(max(table["det"].to_pylist(), default=0)) + 1, dtype=np.int64)
    obs[table["det"].to_numpy()] = table["obs"].to_numpy()

    def decode(batch):
        key = batch.column("key")
        flat, ends = key.flatten().to_numpy(), np.cumsum(np.asarray(key.value_lengths()))
        running = np.concatenate([[0], np.bitwise_xor.accumulate(obs[flat])]) if len(flat) else np.zeros(1, dtype=np.int64)
        sizes = np.asarray(key.value_lengths())
        return running[ends] ^ running[ends - sizes], sizes > 8

    return decode


PLUGIN_SQL = """
  SELECT y.shot_id, CAST(bit_xor(COALESCE(e.obs_mask, 0)) AS BIGINT) AS pred_mask, COUNT(*) > 8 AS discarded
  FROM fx_hits y LEFT JOIN fx_edge e ON e.u = y.det AND e.v = 24 GROUP BY 1"""


def plugged(fx):
    dc.register_decoder("boundary-lookup", lookup_decoder)
    model = fx.fx_edge.filter(F.col("v") == BOUNDARY).select(F.col("u").alias("det"), F.col("obs_mask").cast("bigint").alias("obs"))
    full = fx.fx_det.select("det").join(model, "det", "left").select("det", F.coalesce("obs", F.lit(0)).alias("obs"))
    return dc.decode_with(dc.shot_syndromes(fx.fx_hits), "boundary-lookup", full)


query("dec11_decode_with", PLUGIN_SQL)(plugged)
query("udf1_decoder_plugin", PLUGIN_SQL)(plugged)


@query("win4_truncate_at_k_errors", """
  SELECT task_id, shot_id FROM (SELECT strong_id AS task_id, seq AS shot_id, COALESCE(SUM(CASE WHEN errors > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY strong_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM fx_stats) WHERE b < 3""")
def _(fx):
    log = fx.fx_stats.select(F.col("strong_id").alias("task_id"), F.col("seq").alias("shot_id"), (F.col("errors") > 30).alias("is_error"))
    return wn.truncate_at_k_errors(log, 3).select("task_id", "shot_id")


@query("win5_limit_collection", """
  SELECT strong_id, seq FROM (SELECT strong_id, seq, COALESCE(SUM(shots) OVER w, 0) AS s, COALESCE(SUM(errors) OVER w, 0) AS e FROM fx_stats
    WINDOW w AS (PARTITION BY strong_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE s < 3000 AND e < 150""")
def _(fx):
    return wn.limit_collection(fx.fx_stats, 3000, 150).select("strong_id", "seq")


@query("win6_round_differences", """
  SELECT shot_id, "check", round_id FROM (SELECT shot_id, det % 4 AS "check", CAST(FLOOR(det / 4) AS INT) AS round_id FROM fx_hits UNION ALL
    SELECT shot_id, det % 4, CAST(FLOOR(det / 4) AS INT) + 1 FROM fx_hits WHERE det < 20) GROUP BY 1, 2, 3 HAVING COUNT(*) % 2 = 1""")
def _(fx):
    bits = fx.fx_hits.select("shot_id", (F.col("det") % 4).alias("check"), F.floor(F.col("det") / 4).cast("int").alias("round_id"))
    return wn.round_differences(bits, 6)


@query("win7_assign_windows", """
  SELECT shot_id, det, CAST(w AS INT) AS win, FLOOR(det / 4) < w * 2 + 2 AS in_commit FROM fx_hits, (SELECT unnest(range(3)) AS w) WHERE FLOOR(det / 4) >= w * 2 AND FLOOR(det / 4) < w * 2 + 3""")
def _(fx):
    hits = fx.fx_hits.join(fx.fx_det, "det").select("shot_id", "det", "round_id")
    return wn.assign_windows(hits, 2, 3).select("shot_id", "det", "win", "in_commit")


@query("win11_grid_to_detector", "SELECT shot_id, det FROM fx_hits")
def _(fx):
    cells = fx.fx_hits.select("shot_id", (F.col("det") % 4).alias("check"), F.floor(F.col("det") / 4).alias("step"), F.lit(1).alias("bit"))
    return wn.grid_to_detector(cells, 4)
