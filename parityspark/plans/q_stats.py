"""Registered queries over task statistics, fits and curves."""

from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions import text as txt
from ..lineage import new_path
from ..operators import model as md
from ..operators import stats as st
from ..sources import stats_csv as sc
from .registry import query

FOLD_SQL = """
  SELECT strong_id, MIN(decoder) AS decoder, MIN(json_metadata) AS json_metadata, CAST(SUM(shots) AS BIGINT) AS shots, CAST(SUM(errors) AS BIGINT) AS errors,
         CAST(SUM(discards) AS BIGINT) AS discards, ROUND(SUM(seconds), 3) AS seconds,
         CAST(SUM(CASE WHEN seq % 3 = 0 THEN 0 ELSE errors END) AS BIGINT) AS x, CAST(SUM(CASE WHEN seq % 3 = 0 THEN 0 ELSE seq % 4 END) AS BIGINT) AS y
  FROM fx_rich GROUP BY 1"""
# Folded statistics with the metadata the curves need: d and the decoder class.
CURVE_SQL = "SELECT strong_id, decoder AS c, MIN(d) AS d, CAST(SUM(shots) AS BIGINT) AS shots, CAST(SUM(errors) AS BIGINT) AS errors, CAST(SUM(discards) AS BIGINT) AS discards FROM fx_stats GROUP BY 1, 2"


def rich(fx):
    return fx.fx_rich.withColumn("custom_counts", sc.parse_counts(F.col("counts_json"))).drop("counts_json")


def flat(folded):
    """Counts as plain columns, seconds rounded."""
    count = lambda k: F.coalesce(F.try_element_at("custom_counts", F.lit(k)), F.lit(0)).cast("bigint").alias(k)
    return folded.select("strong_id", "decoder", "json_metadata", "shots", "errors", "discards", F.round("seconds", 3).alias("seconds"), count("x"), count("y"))


def curve_points(fx):
    folded = st.fold_stats(rich(fx))
    return st.derive_columns(folded, d="variant_get(m, '$.d', 'bigint')", c="variant_get(m, '$.c', 'string')")


@query("agg11_combine_stats", """
  SELECT strong_id, MIN(decoder) AS decoder, MIN(json_metadata) AS json_metadata, CAST(SUM(shots) AS BIGINT) AS shots, CAST(SUM(errors) AS BIGINT) AS errors,
         CAST(SUM(discards) AS BIGINT) AS discards, ROUND(SUM(seconds), 3) AS seconds FROM fx_rich GROUP BY 1""")
def _(fx):
    return st.combine_stats(fx.fx_rich, strict=True).withColumn("seconds", F.round("seconds", 3))


@query("agg12_merge_custom_counts", """
  SELECT strong_id, CONCAT('{', array_to_string(list(CONCAT('"', name, '":', CAST(n AS VARCHAR)) ORDER BY name), ','), '}') AS counts FROM (
    SELECT strong_id, name, SUM(n) AS n FROM (SELECT strong_id, 'x' AS name, errors AS n FROM fx_rich WHERE counts_json <> ''
      UNION ALL SELECT strong_id, 'y', seq % 4 FROM fx_rich WHERE counts_json <> '') GROUP BY 1, 2 HAVING SUM(n) > 0) GROUP BY 1""")
def _(fx):
    return st.merge_custom_counts(rich(fx)).select("strong_id", F.to_json("custom_counts").alias("counts"))


@query("agg13_stat_conflicts", """
  SELECT strong_id, MIN(decoder) <> MAX(decoder) AS decoder_conflict, MIN(json_metadata) <> MAX(json_metadata) AS metadata_conflict
  FROM (SELECT decoder AS strong_id, CONCAT(CAST(d AS VARCHAR), 'x') AS decoder, CAST(d AS VARCHAR) AS json_metadata FROM fx_stats) GROUP BY 1
  HAVING MIN(decoder) <> MAX(decoder) OR MIN(json_metadata) <> MAX(json_metadata)""")
def _(fx):
    s = fx.fx_stats.select(F.col("decoder").alias("strong_id"), F.concat("d", F.lit("x")).alias("decoder"), F.concat(F.lit('{"d": '), "d", F.lit("}")).alias("json_metadata"))
    return st.stat_conflicts(s)


@query("agg14_common_properties", """
  SELECT key, MIN(v) AS value FROM (
    SELECT 'same' AS key, 'yes' AS v FROM fx_stats UNION ALL SELECT 'd', CAST(d AS VARCHAR) FROM fx_stats UNION ALL SELECT 'decoder', decoder FROM fx_stats)
  GROUP BY 1 HAVING MIN(v) = MAX(v)""")
def _(fx):
    meta = F.concat(F.lit('{"same":"yes","d":'), "d", F.lit("}"))
    return st.common_properties(fx.fx_stats.withColumn("json_metadata", meta))


@query("agg19_group_stats", f"SELECT c, COUNT(*) AS n_points, MIN(d) AS x_min, MAX(d) AS x_max FROM ({CURVE_SQL}) GROUP BY 1")
def _(fx):
    return st.group_stats(curve_points(fx), ["c"], "d")


@query("agg20_axis_range", f"""
  SELECT GREATEST(MIN(r), 0) AS min_v, ROUND(GREATEST(0.0, MAX(r)), 9) AS max_v FROM (SELECT errors / (shots - discards) AS r FROM ({CURVE_SQL})) WHERE r > 0""".replace("GREATEST(MIN(r), 0)", "CAST(0 AS DOUBLE)"))
def _(fx):
    pts = curve_points(fx).withColumn("r", F.col("errors") / (F.col("shots") - F.col("discards")))
    return st.axis_range(pts, ["r"], (0, 1), forced_min=0, positive=True).withColumn("max_v", F.round("max_v", 9))


@query("flt6_filter_stats", "SELECT seq, strong_id, shots FROM fx_stats WHERE d >= 4 AND decoder <> 'click'")
def _(fx):
    return st.filter_stats(fx.fx_rich, "variant_get(m, '$.d', 'int') >= 4 AND decoder <> 'click' AND variant_get(m, '$.nothing') IS NULL").select("seq", "strong_id", "shots")


@query("flt7_derive_columns", "SELECT seq, d AS x, decoder AS grp, d * 3 + 1 AS pieces FROM fx_stats")
def _(fx):
    return st.derive_columns(
        fx.fx_rich, x="variant_get(m, '$.d', 'bigint')", grp="variant_get(m, '$.c', 'string')", pieces="variant_get(m, '$.d', 'bigint') * 3 + 1"
    ).select("seq", "x", "grp", "pieces")


@query("flt8_edit_stats", "SELECT seq, 'merged' AS decoder, CASE WHEN errors > 25 THEN CAST(0 AS BIGINT) ELSE discards END AS discards FROM fx_stats")
def _(fx):
    edited = st.edit_stats(fx.fx_stats, decoder=F.lit("merged"), discards=F.when(F.col("errors") > 25, F.lit(0).cast("bigint")), shots=None)
    return edited.select("seq", "decoder", "discards")


@query("flt13_strip_custom_counts", "SELECT seq, 0 AS n_counts FROM fx_rich")
def _(fx):
    return st.strip_custom_counts(rich(fx)).select("seq", F.size("custom_counts").alias("n_counts"))


@query("flt15_validate_task_stats", """
  SELECT strong_id, seq, 'errors and discards exceed shots' AS rule FROM fx_stats WHERE shots - 140 < errors + discards
  UNION ALL SELECT strong_id, seq, 'negative shots' FROM fx_stats WHERE shots < 140""")
def _(fx):
    return st.validate_task_stats(fx.fx_stats.withColumn("shots", F.col("shots") - 140))


@query("set1_append_stats", FOLD_SQL.replace("SUM(CASE WHEN seq % 3 = 0 THEN 0 ELSE", "SUM(CASE WHEN seq % 3 = 0 OR discards < 3 THEN 0 ELSE"))
def _(fx):
    old = rich(fx).filter("discards < 3").drop("custom_counts")
    return flat(st.append_stats(rich(fx).filter("discards >= 3"), old, strict=True))


# Written metadata has sorted keys; seconds are whole so that the file's rounding keeps them.
WRITTEN_SQL = FOLD_SQL.replace("ROUND(SUM(seconds), 3)", "CAST(SUM(FLOOR(seconds)) AS DOUBLE)").replace(
    "MIN(json_metadata) AS json_metadata", """CONCAT('{"c":"', MIN(decoder), '","d":', MIN(regexp_extract(json_metadata, '[0-9]+')), '}') AS json_metadata""")


@query("src9_read_task_stats", WRITTEN_SQL.replace("SUM(CASE WHEN seq % 3 = 0 THEN 0 ELSE", "SUM(CASE WHEN seq % 3 = 0 OR discards < 3 THEN 0 ELSE"))
def _(fx):
    """Two sources, the older without a counts column, written, read back and folded."""
    new, old = new_path(fx.spark, "stats-csv"), new_path(fx.spark, "stats-csv-old")
    whole = rich(fx).withColumn("seconds", F.floor("seconds").cast("double"))
    sc.write_task_stats(whole.filter("discards >= 3"), new)
    whole.filter("discards < 3").select(*sc.COLUMNS[:-1]).write.csv(old, header=True, quote='"', escape='"')
    return flat(sc.read_task_stats(fx.spark, [old, new], strict=True).withColumn("json_metadata", txt.canonical_json(F.col("json_metadata"))))


@query("snk4_write_task_stats", """
  SELECT CONCAT(LPAD(CAST(shots AS VARCHAR), 10, ' '), ',', LPAD(CAST(errors AS VARCHAR), 10, ' '), ',', LPAD(CAST(discards AS VARCHAR), 10, ' '), ',',
    LPAD(CASE WHEN seconds < 1 THEN printf('%.3f', seconds) WHEN seconds < 10 THEN printf('%.2f', seconds) ELSE printf('%.1f', seconds) END, 8, ' '), ',',
    decoder, ',', strong_id, ',"{""c"":""', decoder, '"",""d"":', regexp_extract(json_metadata, '[0-9]+'), '}",',
    CASE WHEN seq % 3 = 0 THEN '' ELSE CONCAT('"{""x"":', CAST(errors AS VARCHAR), ',""y"":', CAST(seq % 4 AS VARCHAR), '}"') END) AS line
  FROM fx_rich""")
def _(fx):
    return sc.stat_lines(rich(fx))


@query("snk6_append_or_create_stats", WRITTEN_SQL)
def _(fx):
    path = new_path(fx.spark, "stats-append")
    whole = rich(fx).withColumn("seconds", F.floor("seconds").cast("double"))
    sc.append_or_create_stats(path, whole.filter("discards < 3"))
    return flat(sc.append_or_create_stats(path, whole.filter("discards >= 3")))


@query("srt1_natural_sort_key", """
  SELECT name, ROW_NUMBER() OVER (ORDER BY CAST(regexp_extract(name, '^d=([0-9]+)', 1) AS INT), regexp_extract(name, '[a-z]+$'), CAST(regexp_extract(name, 'r=([0-9]+)', 1) AS INT)) - 1 AS position
  FROM (SELECT DISTINCT CONCAT('d=', CAST(seq % 113 AS VARCHAR), ', r=', CAST(errors * 7 AS VARCHAR)) AS name FROM fx_stats)""")
def _(fx):
    names = fx.fx_stats.select(F.concat(F.lit("d="), F.col("seq") % 113, F.lit(", r="), F.col("errors") * 7).alias("name")).distinct()
    return st.global_index(names.withColumn("_k", txt.natural_sort_key(F.col("name"))), ["_k"], "position").select("name", "position")


@query("srt2_order_stats", """
  SELECT strong_id, ROW_NUMBER() OVER (ORDER BY errors / (shots - discards), discards / shots, strong_id) - 1 AS position
  FROM (SELECT strong_id, SUM(shots) AS shots, SUM(errors) AS errors, SUM(discards) AS discards FROM fx_stats GROUP BY 1)""")
def _(fx):
    return st.position_stats(st.combine_stats(fx.fx_stats), "error").select("strong_id", "position")


@query("fn1_log_factorial", "SELECT seq, ROUND(lgamma(seq * 37 + 1) / (seq * 37 + 1), 7) AS v FROM fx_stats")
def _(fx):
    return fx.fx_stats.select("seq", F.round(num.log_factorial(F.col("seq") * 37) / (F.col("seq") * 37 + 1), 7).alias("v"))


@query("fn2_log_binomial", """
  SELECT seq, ROUND(errors * ln(p) + (shots - errors) * ln(1 - p) + lgamma(shots + 1) - lgamma(errors + 1) - lgamma(shots - errors + 1), 6) AS v
  FROM (SELECT *, (1 + seq % 97) / 100.0::DOUBLE AS p FROM fx_stats)""")
def _(fx):
    p = (1 + F.col("seq") % 97) / F.lit(100.0)
    return fx.fx_stats.select("seq", F.round(num.log_binomial(p, F.col("shots"), F.col("errors")), 6).alias("v"))


def fit_sql(source: str, factor: float) -> str:
    """Bisection for both interval ends of source(k, n, h), as recursive SQL."""
    ll = "(CASE WHEN h = 0 THEN 0 WHEN {0} <= 0 THEN '-inf'::DOUBLE ELSE h * ln({0} / (100.0 * n)) END + CASE WHEN h = n THEN 0 WHEN {0} >= 100 * n THEN '-inf'::DOUBLE ELSE (n - h) * ln(1 - {0} / (100.0 * n)) END)"
    mid = "((lo + hi) // 2)"
    return f"""
  WITH RECURSIVE src AS ({source}), b AS (
    SELECT k, n, h, side, CASE side WHEN 'low' THEN 0 ELSE 100 * h END AS lo, CASE side WHEN 'low' THEN 100 * h ELSE 100 * n END AS hi, {ll.format('(100 * h)')} - ln({factor}) AS goal, 0 AS i
    FROM src, (SELECT unnest(['low', 'high']) AS side)
    UNION ALL SELECT k, n, h, side,
      CASE WHEN hi > lo + 1 AND (CASE side WHEN 'low' THEN {ll.format(mid)} <= goal ELSE {ll.format(mid)} >= goal END) THEN {mid} ELSE lo END,
      CASE WHEN hi > lo + 1 AND (CASE side WHEN 'low' THEN {ll.format(mid)} >= goal ELSE {ll.format(mid)} <= goal END) THEN {mid} ELSE hi END, goal, i + 1 FROM b WHERE i < 40),
  ends AS (SELECT k, n, h, side, CASE WHEN ABS({ll.format('hi')} - goal) < ABS({ll.format('lo')} - goal) THEN hi ELSE lo END / (100.0 * n) AS v FROM b WHERE i = 40),
  fit AS (SELECT k, n, h, MAX(CASE WHEN side = 'low' THEN v END) AS low, h / n AS best, MAX(CASE WHEN side = 'high' THEN v END) AS high FROM ends GROUP BY k, n, h)
  """


@query("fn3_fit_binomial", fit_sql("SELECT seq AS k, shots - discards AS n, errors AS h FROM fx_stats", 1000) + "SELECT k AS seq, ROUND(low, 9) AS low, ROUND(best, 9) AS best, ROUND(high, 9) AS high FROM fit")
def _(fx):
    fit = num.fit_binomial(F.col("shots") - F.col("discards"), F.col("errors"), 1000)
    return fx.fx_stats.withColumn("fit", fit).select("seq", *[F.round(f"fit.{e}", 9).alias(e) for e in ("low", "best", "high")])


@query("fn4_piece_rate", """
  SELECT seq, ROUND(CASE WHEN pieces = 1 THEN s ELSE 1 - (1 - CASE WHEN q > 0.5 THEN 1 - (1 - (2 * q - 1) ** (1.0 / pieces)) / 2 ELSE (1 - (1 - 2 * q) ** (1.0 / pieces)) / 2 END) ** v END, 9) AS rate
  FROM (SELECT *, 1 - (1 - s) ** (1.0 / v) AS q FROM
    (SELECT seq, CAST(seq % 1001 AS DOUBLE) / 1000 AS s, CAST(1 + d AS DOUBLE) AS pieces, CAST(1 + seq % 3 AS DOUBLE) AS v FROM fx_stats))""")
def _(fx):
    rate = num.piece_rate((F.col("seq") % 1001).cast("double") / 1000, (1 + F.col("d")).cast("double"), (1 + F.col("seq") % 3).cast("double"))
    return fx.fx_stats.select("seq", F.round(rate, 9).alias("rate"))


def rounded(df, keys, digits=6):
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in df.columns if c not in keys])


@query("fn5_fit_line", "SELECT decoder, ROUND(regr_slope(errors, shots), 6) AS slope, ROUND(regr_intercept(errors, shots), 6) AS intercept FROM fx_stats GROUP BY 1")
def _(fx):
    cols = num.fit_line(F.col("shots"), F.col("errors"))
    return rounded(fx.fx_stats.groupBy("decoder").agg(*[c.alias(k) for k, c in cols.items()]), ["decoder"])


@query("fn6_fit_line_slope", """
  SELECT decoder, ROUND(regr_slope(seconds, d) - sqrt(2.5 / regr_sxx(seconds, d)), 6) AS low, ROUND(regr_slope(seconds, d), 6) AS best,
         ROUND(regr_slope(seconds, d) + sqrt(2.5 / regr_sxx(seconds, d)), 6) AS high FROM fx_stats GROUP BY 1""")
def _(fx):
    cols = num.fit_line_slope(F.col("d"), F.col("seconds"), 2.5)
    return rounded(fx.fx_stats.groupBy("decoder").agg(*[c.alias(k) for k, c in cols.items()]), ["decoder"])


@query("fn7_fit_line_y_at_x", """
  SELECT decoder, ROUND(y - h, 6) AS low, ROUND(y, 6) AS best, ROUND(y + h, 6) AS high FROM (
    SELECT decoder, regr_slope(seconds, d) * 11 + regr_intercept(seconds, d) AS y,
           sqrt(1.5 * (1.0 / COUNT(*) + (AVG(d) - 11) ** 2 / regr_sxx(seconds, d))) AS h FROM fx_stats GROUP BY 1)""")
def _(fx):
    cols = num.fit_line_y_at_x(F.col("d"), F.col("seconds"), 11, 1.5)
    return rounded(fx.fx_stats.groupBy("decoder").agg(*[c.alias(k) for k, c in cols.items()]), ["decoder"])


@query("fn8_rescale", """
  SELECT seq, seconds AS linear, ROUND(ln(seconds), 9) AS log, ROUND(sqrt(seconds), 9) AS sqrt, ROUND(exp(seconds / 100), 9) AS unlog, ROUND(seconds ** 2, 6) AS unsqrt FROM fx_stats""")
def _(fx):
    s = F.col("seconds")
    return fx.fx_stats.select(
        "seq", num.rescale(s, "linear").alias("linear"), num.round_half_away(num.rescale(s, "log"), 9).alias("log"), num.round_half_away(num.rescale(s, "sqrt"), 9).alias("sqrt"),
        num.round_half_away(num.rescale(s / 100, "log", True), 9).alias("unlog"), num.round_half_away(num.rescale(s, "sqrt", True), 6).alias("unsqrt"),
    )


@query("fn9_key_values_from_path", """SELECT seq, CONCAT('{"d":', CAST(d AS VARCHAR), ',"r":', CAST(errors AS VARCHAR), '.5,"x":"', decoder, '"}') AS metadata FROM fx_stats""")
def _(fx):
    path = F.concat(F.lit("runs/d="), "d", F.lit(",r="), "errors", F.lit(".5,x="), "decoder", F.lit(".txt"))
    return fx.fx_stats.select("seq", txt.key_values_from_path(path).alias("metadata"))


@query("fn10_strong_id", """
  SELECT seq, sha256(CONCAT('{"circuit": "H ', CAST(d AS VARCHAR), '\\nM 0", "decoder": "', decoder, '", "decoder_error_model": "error(0.1) D0", "postselection_mask": ',
    CASE WHEN d = 0 THEN 'null' ELSE CONCAT('[', CAST(d AS VARCHAR), ', 1]') END, ', "json_metadata": {"d": ', CAST(d AS VARCHAR), ', "c": "', decoder, '"}}')) AS id
  FROM fx_rich JOIN (SELECT seq, d FROM fx_stats) USING (seq)""")
def _(fx):
    s = fx.fx_rich.join(fx.fx_stats.select("seq", "d"), "seq")
    circuit = F.concat(F.lit("H "), "d", F.lit("\nM 0"))
    mask = F.when(F.col("d") > 0, F.array(F.col("d"), F.lit(1).cast("bigint")))
    return s.select("seq", txt.strong_id(circuit, F.col("decoder"), F.lit("error(0.1) D0"), mask, F.col("json_metadata")).alias("id"))


@query("fn11_combine_options", """
  SELECT seq, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE LEAST(a, b) END AS max_shots FROM
  (SELECT seq, CASE WHEN seq % 3 > 0 THEN shots END AS a, CASE WHEN seq % 5 > 0 THEN errors * 20 END AS b FROM fx_stats)""")
def _(fx):
    a = F.when(F.col("seq") % 3 > 0, F.col("shots"))
    b = F.when(F.col("seq") % 5 > 0, F.col("errors") * 20)
    return fx.fx_stats.select("seq", num.combine_limits(a, b).alias("max_shots"))


@query("fn12_weight_from_p", "SELECT err_id, ROUND(ln((1 - p) / p), 9) AS w, ROUND(p, 9) AS p FROM fx_err")
def _(fx):
    w = num.weight_from_p(F.col("p"))
    return fx.fx_err.select("err_id", F.round(w, 9).alias("w"), F.round(num.p_from_weight(w), 9).alias("p"))


@query("fn13_quantize_weight", """
  SELECT err_id, CAST(2 * ROUND(w * 999 / m) AS BIGINT) AS q FROM (SELECT err_id, w, MAX(ABS(w)) OVER () AS m FROM (SELECT err_id, ROUND(ln((1 - p) / p), 6) AS w FROM fx_err))""")
def _(fx):
    edges = fx.fx_err.select("err_id", F.round(num.weight_from_p(F.col("p")), 6).alias("w"))
    return md.quantize_weights(edges, 1000).select("err_id", "q")


@query("fn14_quantize_neg_log", "SELECT err_id, CAST(ROUND(-100 * ln(p)) AS SMALLINT) AS q FROM fx_err")
def _(fx):
    return fx.fx_err.select("err_id", num.quantize_neg_log(F.col("p")).alias("q"))


@query("fn15_mask_pack", "SELECT shot_id, CAST(SUM(1::BIGINT << det) AS BIGINT) AS mask, CAST(COUNT(*) AS INT) AS ones, MIN(det) AS lowest FROM fx_hits GROUP BY 1")
def _(fx):
    packed = fx.fx_hits.groupBy("shot_id").agg(num.mask_pack(F.col("det")).alias("mask"))
    return packed.select("shot_id", "mask", F.bit_count("mask").alias("ones"), F.get(num.mask_unpack(F.col("mask"), 24), F.lit(0)).alias("lowest"))


@query("fn15_words", "SELECT shot_id, array_to_string(list(det * 6 + 1 ORDER BY det), ' ') AS set_bits FROM fx_hits GROUP BY 1")
def _(fx):
    packed = fx.fx_hits.groupBy("shot_id").agg(num.mask_pack(F.col("det") * 6 + 1, 140).alias("mask"))
    return packed.select("shot_id", F.array_join(num.mask_unpack(F.col("mask"), 140).cast("array<string>"), " ").alias("set_bits"))


@query("fn15_mask_unpack", "SELECT shot_id, det FROM fx_hits")
def _(fx):
    packed = fx.fx_hits.groupBy("shot_id").agg(num.mask_pack(F.col("det")).alias("mask"))
    return packed.select("shot_id", F.explode(num.mask_unpack(F.col("mask"), 24)).alias("det"))


@query("fn16_json_equal", "SELECT seq, d % 2 = 0 AS same FROM fx_stats")
def _(fx):
    a = F.concat(F.lit('{"a": [1, '), "d", F.lit('], "b": {"x": 1.0, "y": null}}'))
    b = F.concat(F.lit('{"b":{"y":null,"x":1},"a":[1,'), F.col("d") - F.col("d") % 2, F.lit("]}"))
    return fx.fx_stats.select("seq", txt.json_equal(a, b).alias("same"))


@query("fn17_split_custom_counts", """
  SELECT seq, CONCAT(strong_id, ':', k) AS strong_id, CONCAT('{"d":', CAST(d AS VARCHAR), ',"c":"', decoder, '","custom_error_count_key":"', k, '","original_error_count":', CAST(errors AS VARCHAR), '}') AS json_metadata,
         CAST(CASE WHEN seq % 3 = 0 OR k = 'z' THEN 0 WHEN k = 'x' THEN errors ELSE seq % 4 END AS BIGINT) AS errors, shots
  FROM fx_stats, (SELECT unnest(['x', 'y', 'z']) AS k)""")
def _(fx):
    return st.split_custom_counts(rich(fx), ["x", "y", "z"]).select("seq", "strong_id", "json_metadata", "errors", "shots")


def _piece(c: str) -> str:
    return f"(CASE WHEN pieces = 1 THEN {c} WHEN {c} > 0.5 THEN 1 - (1 - (2 * {c} - 1) ** (1.0 / pieces)) / 2 ELSE (1 - (1 - 2 * {c}) ** (1.0 / pieces)) / 2 END)"


@query("fn18_error_rate_points", fit_sql(f"SELECT strong_id AS k, shots - discards AS n, errors AS h FROM ({CURVE_SQL})", 1000) + f"""
  SELECT k AS strong_id, ROUND({_piece('low')}, 6) AS low, CASE WHEN h > 0 THEN ROUND({_piece('best')}, 6) END AS best, ROUND({_piece('high')}, 6) AS high
  FROM fit JOIN (SELECT strong_id, CAST(1 + d AS DOUBLE) AS pieces FROM ({CURVE_SQL})) c ON c.strong_id = k""")
def _(fx):
    pts = st.error_rate_points(curve_points(fx), 1000, (1 + F.col("d")).cast("double"))
    return pts.select("strong_id", *[F.round(c, 6).alias(c) for c in ("low", "best", "high")])


@query("fn18_discard_rate_points", fit_sql(f"SELECT strong_id AS k, shots AS n, discards AS h FROM ({CURVE_SQL})", 9) + "SELECT k AS strong_id, ROUND(low, 6) AS low, ROUND(best, 6) AS best, ROUND(high, 6) AS high FROM fit")
def _(fx):
    return st.discard_rate_points(curve_points(fx), 9).select("strong_id", *[F.round(c, 6).alias(c) for c in ("low", "best", "high")])


@query("fn19_curve_table", f"""
  SELECT c, d AS x, ROUND(CASE WHEN errors > 0 THEN errors / (shots - discards) END, 9) AS best, strong_id AS label,
         ROUND(CASE WHEN errors > 0 THEN errors / (shots - discards) END, 9) AS label_y FROM ({CURVE_SQL})""")
def _(fx):
    # A likelihood factor of 1 closes the interval on the best value, which plain SQL can reproduce.
    pts = st.error_rate_points(curve_points(fx), 1)
    table = st.curve_table(pts, ["c"], "d", "strong_id")
    return table.select("c", "x", F.round("best", 9).alias("best"), "label", F.round("label_y", 9).alias("label_y"))


@query("fn20_line_fit_curves", f"""
  SELECT c, i, ROUND(exp(x), 6) AS x, ROUND(y, 6) AS y FROM (SELECT c, CAST(i AS INT) AS i, a + (i * 21 / 999.0 - 10) * (b - a) AS x, (a + (i * 21 / 999.0 - 10) * (b - a)) * slope + intercept AS y
    FROM (SELECT c, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, MIN(x) AS a, MAX(x) AS b
          FROM (SELECT c, ln(1 + d) / 10 AS x, errors / (shots - discards) AS y FROM ({CURVE_SQL}) WHERE errors > 0) GROUP BY 1), (SELECT unnest(range(1000)) AS i) WHERE a < b)""")
def _(fx):
    pts = curve_points(fx).filter("errors > 0").withColumns(
        {"best": F.col("errors") / (F.col("shots") - F.col("discards")), "x": F.pow(1 + F.col("d"), F.lit(0.1))}
    )
    return rounded(st.line_fit_curves(pts, ["c"], "log", "linear"), ["c", "i"])


@query("win9_rank_curves", """
  SELECT strong_id, p AS color, p % 11 AS marker, p % 4 AS linestyle FROM (
    SELECT strong_id, ROW_NUMBER() OVER (ORDER BY split_part(strong_id, '-', 1), CAST(split_part(strong_id, '-', 2) AS INT)) - 1 AS p FROM (SELECT DISTINCT strong_id FROM fx_stats))""")
def _(fx):
    return st.rank_curves(fx.fx_stats, "strong_id", 11, 4)


@query("win8_dedup_first", """
  SELECT strong_id, MIN(seq) AS seq, MIN_BY(shots, seq) AS shots, MIN_BY(errors, seq) AS errors FROM fx_stats GROUP BY 1""")
def _(fx):
    return st.first_rows(fx.fx_stats.select("strong_id", "seq", "shots", "errors"), ["strong_id"], "seq")


TASKS_SQL = "SELECT strong_id, CAST(4000 + MIN(seq) % 5000 AS BIGINT) AS max_shots, CASE WHEN MIN(seq) % 2 = 0 THEN CAST(300 AS BIGINT) END AS max_errors FROM fx_stats GROUP BY 1"


def tasks(fx):
    return fx.fx_stats.groupBy("strong_id").agg(F.min("seq").alias("m")).select(
        "strong_id", (4000 + F.col("m") % 5000).alias("max_shots"), F.when(F.col("m") % 2 == 0, F.lit(300).cast("bigint")).alias("max_errors")
    )


@query("jn8_pending_tasks", f"""
  SELECT * FROM (SELECT t.strong_id, max_shots - COALESCE(s, 0) AS shots_left, LEAST(COALESCE(max_errors, max_shots), max_shots) - COALESCE(e, 0) AS errors_left
    FROM ({TASKS_SQL}) t LEFT JOIN (SELECT strong_id, CAST(SUM(shots) AS BIGINT) AS s, CAST(SUM(errors) AS BIGINT) AS e FROM fx_stats GROUP BY 1) x ON t.strong_id = x.strong_id)
  WHERE shots_left > 0 AND errors_left > 0""")
def _(fx):
    return st.pending_tasks(tasks(fx), st.combine_stats(fx.fx_stats))


@query("jn8_pending_by_count", f"""
  SELECT * FROM (SELECT t.strong_id, max_shots - COALESCE(s, 0) AS shots_left, LEAST(COALESCE(max_errors, max_shots), max_shots) - COALESCE(e, 0) AS errors_left
    FROM ({TASKS_SQL}) t LEFT JOIN (SELECT strong_id, CAST(SUM(shots) AS BIGINT) AS s, CAST(SUM(CASE WHEN seq % 3 <> 0 THEN seq % 4 ELSE 0 END) AS BIGINT) AS e FROM fx_stats GROUP BY 1) x ON t.strong_id = x.strong_id)
  WHERE shots_left > 0 AND errors_left > 0""")
def _(fx):
    return st.pending_tasks(tasks(fx), st.fold_stats(rich(fx)), error_key="y")


@query("jn9_expand_tasks", """
  SELECT seq, k AS decoder FROM fx_stats, (SELECT unnest(['alpha', 'beta']) AS k) WHERE d >= 4
  UNION ALL SELECT seq, decoder FROM fx_stats WHERE d < 4""")
def _(fx):
    t = fx.fx_stats.select("seq", F.when(F.col("d") < 4, F.col("decoder")).alias("decoder"))
    return st.expand_tasks(t, ["alpha", "beta"])


ETA_SQL = f"""
  SELECT t.strong_id, max_shots - s AS shots_left, COALESCE(max_errors - e, e) AS errors_left,
         ROUND(LEAST((max_shots - s) * sec / s, CASE WHEN e > 0 AND max_errors IS NOT NULL THEN (max_errors - e) * sec / e ELSE (max_shots - s) * sec / s END) / 60 / 4, 6) AS minutes_left
  FROM ({TASKS_SQL}) t JOIN (SELECT strong_id, CAST(SUM(shots) AS BIGINT) AS s, CAST(SUM(errors) AS BIGINT) AS e, SUM(seconds) AS sec FROM fx_stats GROUP BY 1) x ON t.strong_id = x.strong_id"""


@query("win10_progress_eta", ETA_SQL)
def _(fx):
    out = st.progress_eta(tasks(fx), st.combine_stats(fx.fx_stats), workers=4)
    return out.withColumn("minutes_left", F.round("minutes_left", 6))


@query("udf4_preprocess_stats", FOLD_SQL.replace("FROM fx_rich GROUP BY", "FROM (SELECT * REPLACE (decoder AS strong_id) FROM fx_rich) GROUP BY"))
def _(fx):
    return flat(st.preprocess(rich(fx), lambda df: df.withColumn("strong_id", F.col("decoder"))))
