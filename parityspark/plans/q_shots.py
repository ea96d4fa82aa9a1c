"""Registered queries over shot files: the fixture's shots are written in an encoding and read back."""

from pyspark.sql import functions as F

from ..lineage import new_path
from ..operators.parity import xor_items
from ..ordered import global_index
from ..sources import shots as sh
from .registry import query

LAYOUT = sh.Layout(0, 24, 2)
ALL_SQL = """
  SELECT shot_id, 'D' AS kind, det AS idx FROM fx_hits UNION ALL SELECT shot_id, 'L', 0 FROM fx_shots WHERE obs_mask % 2 = 1
  UNION ALL SELECT shot_id, 'L', 1 FROM fx_shots WHERE obs_mask >= 2"""


def hits(fx):
    # The rows of fx_hits, cancelled as bits of words. Few lines of a scan share a shot, so they are dealt to their shots first.
    det = xor_items(fx.fx_hit_raw, ["shot_id"], "det", dealt=True)
    obs = fx.fx_shots.select("shot_id", F.lit("L").alias("kind"), F.explode(F.filter(F.array(F.lit(0), F.lit(1)), lambda i: F.getbit(F.col("obs_mask"), i) == 1)).alias("idx"))
    return det.select("shot_id", F.lit("D").alias("kind"), F.col("det").alias("idx")).unionByName(obs)


def round_trip(fx, fmt):
    path = new_path(fx.spark, f"shots-{fmt}")
    sh.write_shots(fx.fx_shots, hits(fx), path, fmt, LAYOUT)
    return sh.read_shots(fx.spark, path, fmt, LAYOUT)


for _n, _fmt in enumerate(["01", "b8", "hits", "dets", "r8", "ptb64"], 1):
    query(f"src{_n}_read_shots_{_fmt}", ALL_SQL)(lambda fx, fmt=_fmt: round_trip(fx, fmt))


@query("udtf1_decode_shot_file", ALL_SQL)
def _(fx):
    # SQL calls the table function for bounded pieces of whole records.
    path = new_path(fx.spark, "table-function")
    sh.write_shots(fx.fx_shots, hits(fx), path, "b8", LAYOUT)
    sh.register_functions(fx.spark)
    sh.table_pieces(fx.spark, path, "b8", LAYOUT).createOrReplaceTempView("shot_chunk")
    return fx.spark.sql(f"""
      SELECT first_shot + t.shot AS shot_id, CASE WHEN t.pos < {LAYOUT.n_det} THEN 'D' ELSE 'L' END AS kind, t.pos % {LAYOUT.n_det} AS idx
      FROM shot_chunk, LATERAL decode_b8(content, {LAYOUT.bits}) t""")


@query("snk1_write_shots_01", """
  SELECT s.shot_id, CONCAT(array_to_string([CASE WHEN list_contains(COALESCE(k, []), i) THEN '1' ELSE '0' END FOR i IN range(24)], ''), CAST(obs_mask % 2 AS VARCHAR), CASE WHEN obs_mask >= 2 THEN '1' ELSE '0' END) AS line
  FROM fx_shots s LEFT JOIN (SELECT shot_id, list(det) AS k FROM fx_hits GROUP BY 1) h ON h.shot_id = s.shot_id""")
def _(fx):
    return sh.shot_lines(fx.fx_shots, hits(fx), "01", LAYOUT)


@query("snk1_write_shots_hits", f"""
  SELECT s.shot_id, COALESCE(k, '') AS line FROM fx_shots s LEFT JOIN (
    SELECT shot_id, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS k FROM (SELECT shot_id, CASE kind WHEN 'D' THEN idx ELSE 24 + idx END AS p FROM ({ALL_SQL})) GROUP BY 1) h ON h.shot_id = s.shot_id""")
def _(fx):
    return sh.shot_lines(fx.fx_shots, hits(fx), "hits", LAYOUT)


@query("snk1_write_shots_dets", f"""
  SELECT s.shot_id, CASE WHEN k IS NULL THEN 'shot' ELSE CONCAT('shot ', k) END AS line FROM fx_shots s LEFT JOIN (
    SELECT shot_id, string_agg(CONCAT(kind, CAST(idx AS VARCHAR)), ' ' ORDER BY kind, idx) AS k FROM ({ALL_SQL}) GROUP BY 1) h ON h.shot_id = s.shot_id""")
def _(fx):
    return sh.shot_lines(fx.fx_shots, hits(fx), "dets", LAYOUT)


@query("snk2_write_shots_packed", f"""
  SELECT 'b8' AS fmt, COUNT(*) AS shots, CAST(4 * COUNT(*) AS BIGINT) AS bytes FROM fx_shots
  UNION ALL SELECT 'ptb64', COUNT(*), CAST(CEIL(COUNT(*) / 64.0) * 208 AS BIGINT) FROM fx_shots
  UNION ALL SELECT 'r8', COUNT(*), COUNT(*) + (SELECT COUNT(*) FROM ({ALL_SQL})) FROM fx_shots""")
def _(fx):
    out = None
    for fmt in sh.PACKED_FORMATS:
        files = sh.write_shots_packed(fx.fx_shots, hits(fx), new_path(fx.spark, f"packed-{fmt}"), fmt, LAYOUT)
        one = files.agg(F.sum("shots").alias("shots"), F.sum("bytes").alias("bytes")).select(F.lit(fmt).alias("fmt"), "shots", "bytes")
        out = one if out is None else out.unionByName(one)
    return out


def records(fx, fmt, size):
    """(first shot, hex) of the written bytes, ``size`` bytes a row."""
    path = new_path(fx.spark, f"contents-{fmt}")
    sh.write_shots(fx.fx_shots, hits(fx), path, fmt, LAYOUT)
    pieces = sh.scan_packed(fx.spark, path, fmt, LAYOUT, "chunks")
    at = F.explode(F.sequence(F.lit(0), F.octet_length("content") - 1, F.lit(size)))
    return pieces.select("first_shot", "content", at.alias("at")).select("first_shot", "at", F.lower(F.hex(F.substring(F.col("content"), F.col("at") + 1, F.lit(size)))).alias("content"))


def swapped(value, n_bytes):
    """SQL for the little-endian hex text of a number."""
    return "lower(" + " || ".join(f"printf('%02x', ({value} >> {8 * i}) & 255)" for i in range(n_bytes)) + ")"


POSITIONS = f"SELECT shot_id, CASE kind WHEN 'D' THEN idx ELSE 24 + idx END AS p FROM ({ALL_SQL})"


@query("snk2_contents_b8", f"""
  SELECT s.shot_id, {swapped("COALESCE(m, 0)", 4)} AS content FROM fx_shots s LEFT JOIN (SELECT shot_id, CAST(SUM(1::BIGINT << p) AS BIGINT) AS m FROM ({POSITIONS}) GROUP BY 1) USING (shot_id)""")
def _(fx):
    # The fixture numbers its shots 0, 1, 2, ... only up to gaps; files number them by place.
    found = records(fx, "b8", 4).select((F.col("first_shot") + F.floor(F.col("at") / 4)).alias("place"), "content")
    return shot_places(fx).join(found, "place").select("shot_id", "content")


def shot_places(fx):
    return global_index(fx.fx_shots.select("shot_id"), ["shot_id"], "place")


@query("snk2_contents_ptb64", f"""
  WITH n AS (SELECT shot_id, row_number() OVER (ORDER BY shot_id) - 1 AS i FROM fx_shots), w AS (
    SELECT i // 64 AS g, p, SUM(CASE WHEN i % 64 < 32 THEN 1::BIGINT << (i % 64) ELSE 0 END) AS lo, SUM(CASE WHEN i % 64 >= 32 THEN 1::BIGINT << (i % 64 - 32) ELSE 0 END) AS hi
    FROM ({POSITIONS}) JOIN n USING (shot_id) GROUP BY 1, 2)
  SELECT x.g AS grp, x.b AS bit, {swapped("CAST(COALESCE(lo, 0) AS BIGINT)", 4)} || {swapped("CAST(COALESCE(hi, 0) AS BIGINT)", 4)} AS content
  FROM (SELECT g, b FROM (SELECT unnest(range((COUNT(*) + 63) // 64)) AS g FROM fx_shots), (SELECT unnest(range(26)) AS b)) x LEFT JOIN w ON w.g = x.g AND w.p = x.b""")
def _(fx):
    numbered = shot_places(fx)
    path = new_path(fx.spark, "contents-ptb64")
    place = hits(fx).join(numbered, "shot_id").select(F.col("place").alias("shot_id"), "kind", "idx")
    sh.write_shots(numbered.select(F.col("place").alias("shot_id")), place, path, "ptb64", LAYOUT)
    pieces = sh.scan_packed(fx.spark, path, "ptb64", LAYOUT, "chunks")
    words = pieces.select("first_shot", "content", F.explode(F.sequence(F.lit(0), F.octet_length("content") - 1, F.lit(8))).alias("at"))
    return words.select(
        (F.floor(F.col("first_shot") / 64) + F.floor(F.col("at") / (8 * LAYOUT.bits))).alias("grp"), (F.floor(F.col("at") / 8) % LAYOUT.bits).alias("bit"),
        F.lower(F.hex(F.substring(F.col("content"), F.col("at") + 1, F.lit(8)))).alias("content"),
    )


@query("snk3_convert_shots", """
  SELECT shot_id, CASE WHEN part = 'prepend' AND idx < 24 THEN idx + 2 WHEN part = 'prepend' THEN idx - 24 ELSE idx END AS idx, part FROM (
    SELECT shot_id, det AS idx FROM fx_hits UNION ALL SELECT shot_id, 24 FROM fx_shots WHERE obs_mask % 2 = 1 UNION ALL SELECT shot_id, 25 FROM fx_shots WHERE obs_mask >= 2), (SELECT unnest(['append', 'prepend']) AS part)""")
def _(fx):
    a, b, c = (new_path(fx.spark, f"convert-{x}") for x in "abc")
    sh.write_shots(fx.fx_shots, hits(fx), a, "b8", LAYOUT)
    sh.convert_shots(fx.spark, a, "b8", b, "r8", LAYOUT, append_obs=True)
    sh.convert_shots(fx.spark, a, "b8", c, "hits", LAYOUT, prepend_obs=True)
    wide = sh.Layout(0, 26, 0)
    read = lambda p, f, part: sh.read_shots(fx.spark, p, f, wide).select("shot_id", "idx", F.lit(part).alias("part"))
    return read(b, "r8", "append").unionByName(read(c, "hits", "prepend"))


@query("snk3_split_observables", "SELECT shot_id, 0 AS idx FROM fx_shots WHERE obs_mask % 2 = 1 UNION ALL SELECT shot_id, 1 FROM fx_shots WHERE obs_mask >= 2")
def _(fx):
    a, b, c = (new_path(fx.spark, f"split-{x}") for x in "abc")
    sh.write_shots(fx.fx_shots, hits(fx), a, "dets", LAYOUT)
    sh.convert_shots(fx.spark, a, "dets", b, "b8", LAYOUT, obs_out=c)
    return sh.read_shots(fx.spark, c, "b8", sh.Layout(n_obs=2)).select("shot_id", "idx")
