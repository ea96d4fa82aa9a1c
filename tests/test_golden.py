"""Small literal cases with known answers."""

import hashlib
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parityspark.functions import numeric as num
from parityspark.functions import text as txt
from parityspark.operators import decode as dc
from parityspark.operators import events as ev
from parityspark.operators import graph as gr
from parityspark.operators import model as md
from parityspark.operators import stats as st
from parityspark.plans import jobs
from parityspark.sources import shots as sh
from parityspark.sources import stats_csv as sc
from parityspark.sources import text_models as tm


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def model(spark, text):
    return spark.createDataFrame([(0, i, line) for i, line in enumerate(text.splitlines())], "model_id int, seq bigint, line string")


def table(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_three_error_model_predictions(spark, tmp_path):
    lines = model(spark, "error(0.1) D0 L0\nerror(0.1) D0 D1 L1\nerror(0.1) D1 L2")
    (tmp_path / "in.dets").write_text("shot\nshot D0\nshot D1\nshot D0 D1\n")
    layout = sh.Layout(0, 2, 3)
    out = jobs.predict(spark, str(tmp_path / "in.dets"), "dets", layout, lines)
    assert table(out["predictions"].select("shot_id", "pred_mask", "reason"), "shot_id") == [
        (0, 0, "empty"), (1, 1, "exact"), (2, 4, "exact"), (3, 2, "exact")]
    actual = spark.createDataFrame([(0, 0), (1, 1), (2, 4), (3, 0)], "shot_id bigint, obs_mask bigint")
    got = jobs.count_mistakes(spark, str(tmp_path / "in.dets"), "dets", layout, actual, lines).first()
    assert tuple(got) == (4, 1, 0)


def test_measurements_to_events_with_expectation(spark):
    shots = spark.range(3).withColumnRenamed("id", "shot_id")
    meas = spark.createDataFrame([(2, 0)], "shot_id bigint, meas int")
    defs = spark.createDataFrame([(0, 0), (2, 0), (9, 0)], "det int, meas int")
    expect = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (9, 1)], "det int, expect int")
    got = table(ev.measurements_to_events(shots, meas, defs, expect), "shot_id", "det")
    assert got == [(0, 0), (0, 2), (0, 9), (1, 0), (1, 2), (1, 9)]


def chain(spark):
    return spark.createDataFrame([(i, i + 1, 1, 0) for i in range(6)] + [(0, -1, 1, 1)], "u int, v int, w bigint, obs_mask bigint")


def test_matched_pairs_on_a_chain(spark):
    key = spark.createDataFrame([([1, 4, 6],)], "key array<int>")
    solved = dc.decode_exact(key, gr.pair_distances(chain(spark), -1))
    assert table(dc.matched_pairs(solved).select("a", "b"), "a") == [(1, None), (4, 6)]
    assert solved.first().w == 4.0
    assert table(dc.mates(solved).select("det", "mate"), "det") == [(1, -1), (4, 6), (6, 4)]


def test_check_matrix_correction(spark):
    ones = [(r, c) for r in range(4) for c in (r, r + 1)]
    checks = spark.createDataFrame(ones, "row int, col bigint")
    faults = spark.createDataFrame([(c, c) for c in range(5)], "fault int, col bigint")
    weights = spark.createDataFrame([(c, 1.0, None) for c in range(5)], "col bigint, w double, p double")
    edges = gr.edges_from_check_matrix(gr.read_check_matrix(checks, faults), weights, 4, 5, virtual_boundary=True)
    full = edges.select(F.col("u").cast("int").alias("u"), F.coalesce("v", F.lit(-1)).cast("int").alias("v"), F.col("w").cast("bigint").alias("w"), "obs_mask")
    got = dc.decode_exact(spark.createDataFrame([([1],)], "key array<int>"), gr.pair_distances(full, -1)).first()
    assert (got.obs, got.w) == (0b00011, 2.0)


def test_merge_smallest_weight(spark):
    e = spark.createDataFrame([(0, 1, 2.0, 1, 0), (0, 1, 1.0, 2, 1), (1, 0, 3.0, 4, 2)], "u int, v int, w double, obs_mask bigint, seq int").withColumn("p", F.lit(None).cast("double"))
    assert table(md.merge_parallel_edges(e, "smallest-weight").select("u", "v", "w", "obs_mask"), "u") == [(0, 1, 1.0, 2)]
    with pytest.raises(Exception, match="parallel edge"):
        md.merge_parallel_edges(e, "disallow").collect()


def test_text_records(spark, tmp_path):
    lay = sh.Layout(3, 0, 0)
    lines = spark.createDataFrame([(0, "1,1")], "shot_id bigint, value string")
    assert sh.parse_shot_lines(lines, "hits", lay).count() == 0
    assert [r.idx for r in sh.parse_shot_lines(lines, "hits", lay, "keep").collect()] == [1, 1]
    for fmt, bad in (("hits", "3"), ("01", "0101"), ("01", "01x"), ("dets", "shot M3"), ("dets", "D1")):
        with pytest.raises(Exception):
            sh.parse_shot_lines(spark.createDataFrame([(0, bad)], "shot_id bigint, value string"), fmt, lay).collect()


def test_repeats_cancel_inside_their_line(spark):
    lay, r = sh.Layout(3, 24, 2), random.Random(5)
    rows = [(i, [k + str(r.randrange(n)) for k, n in (r.choice([("M", 3), ("D", 24), ("L", 2)]) for _ in range(r.randrange(12)))]) for i in range(200)]
    rows.append((200, ["D7", "D8", "D7"] * 20_001))
    written = Counter((i, w[0], int(w[1:])) for i, ws in rows for w in ws)
    at = {"M": 0, "D": 3, "L": 27}
    texts = {"dets": [(i, " ".join(["shot", *ws])) for i, ws in rows], "hits": [(i, ",".join(str(at[w[0]] + int(w[1:])) for w in ws)) for i, ws in rows]}
    for fmt, lines in texts.items():
        parse = lambda dedup: sh.parse_shot_lines(spark.createDataFrame(lines, "shot_id bigint, value string"), fmt, lay, dedup)
        assert Counter(map(tuple, parse("keep").collect())) == written
        assert Counter(map(tuple, parse("xor").collect())) == Counter(k for k, n in written.items() if n % 2)
        assert "Exchange" not in parse("xor")._jdf.queryExecution().executedPlan().toString()
    for bad in ("shotD1", "shot D1 x", "shot D1 D", " shot D1", "shot D1D2", "shot D24", "shot M1 L2"):
        with pytest.raises(Exception):
            sh.parse_shot_lines(spark.createDataFrame([(0, bad)], "shot_id bigint, value string"), "dets", lay).collect()


def test_packed_bytes(spark, tmp_path):
    bits = "00001111001101"
    lay = sh.Layout(len(bits), 0, 0)
    shots = spark.range(1).withColumnRenamed("id", "shot_id")
    hits = spark.createDataFrame([(0, "M", i) for i, b in enumerate(bits) if b == "1"], "shot_id bigint, kind string, idx int")
    for fmt, want in (("b8", bytes([0xF0, 0x2C])), ("r8", bytes([4, 0, 0, 0, 2, 0, 1, 0]))):
        sh.write_shots(shots, hits, str(tmp_path / fmt), fmt, lay)
        (file,) = list((tmp_path / fmt).glob("shots-*"))
        assert file.read_bytes() == want
    assert sh.shot_lines(shots, hits, "01", lay).first().line == bits


def test_postselection_mask_from_coordinates(spark):
    d = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, [1.0, 1.0, 1.0, 1.0]), (2, [1.0, 1.0, 1.0, 0.0]), (80, [1.0, 1.0, 1.0, 999.0])], "det int, coords array<double>")
    assert [r.det for r in ev.postselect_mask_from_coord(d).orderBy("det").collect()] == [1, 80]


def stat(spark, rows):
    return spark.createDataFrame(rows, "strong_id string, decoder string, json_metadata string, shots bigint, errors bigint, discards bigint, seconds double, custom_counts map<string,bigint>")


def test_combine_and_counts(spark):
    s = stat(spark, [("a", "d", "{}", 300, 1, 20, 1.0, {}), ("a", "d", "{}", 300, 100, 200, 2.0, {})])
    assert tuple(st.fold_stats(s).select("shots", "errors", "discards", "seconds").first()) == (600, 101, 220, 3.0)
    old = stat(spark, [("a", "d", "{}", 100, 1, 20, 10.0, {})]).drop("custom_counts")
    new = stat(spark, [("a", "d", "{}", 300, 1, 20, 20.0, {"x": 2, "z": 0}), ("a", "d", "{}", 300, 1, 20, 30.0, {"y": 3})])
    got = st.append_stats(new, old).first()
    assert (got.shots, got.errors, got.discards, got.seconds, got.custom_counts) == (700, 3, 60, 60.0, {"x": 2, "y": 3})
    clash = stat(spark, [("a", "d", "{}", 1, 0, 0, 0.0, {}), ("a", "e", "{}", 1, 0, 0, 0.0, {})])
    with pytest.raises(Exception, match="conflicting"):
        st.fold_stats(clash, strict=True).collect()
    same = stat(spark, [("a", "d", '{"b":1,"a":[1]}', 1, 0, 0, 0.0, {}), ("a", "d", '{"a": [1], "b": 1.0}', 1, 0, 0, 0.0, {})])
    assert st.fold_stats(same, strict=True).count() == 1


def test_csv_round_trip_and_format(spark, tmp_path):
    s = stat(spark, [("i,d", 'q"x', '{"b": 2, "a": "y,z"}', 3, 2, 1, 0.0625, {"k": 4}), ("b", "d", "null", 10, 0, 0, 9.999, {}), ("c", "d", "5", 1, 0, 0, 12.25, {})])
    lines = sorted(r.line for r in sc.stat_lines(s).collect())
    assert lines == sorted([
        '         3,         2,         1,   0.062,"q""x","i,d","{""a"":""y,z"",""b"":2}","{""k"":4}"',
        "        10,         0,         0,   10.00,d,b,null,", "         1,         0,         0,    12.2,d,c,5,"])
    sc.write_task_stats(s, str(tmp_path / "csv"))
    header = next(f for f in (tmp_path / "csv").glob("part-*")).read_text().splitlines()[0]
    assert header == "     shots,    errors,  discards, seconds,decoder,strong_id,json_metadata,custom_counts"
    back = {r.strong_id: r for r in sc.read_task_stats(spark, [str(tmp_path / "csv")]).collect()}
    assert back["i,d"].decoder == 'q"x' and json.loads(back["i,d"].json_metadata) == {"a": "y,z", "b": 2} and back["i,d"].custom_counts == {"k": 4}
    bad = tmp_path / "bad.csv"
    bad.write_text("shots,errors\n1,2\n")
    with pytest.raises(ValueError, match="lacks the columns"):
        sc.read_task_stats(spark, [str(bad)])


def test_natural_order(spark):
    items = ["distance=199999, rounds=3", "distance=2, rounds=3", "distance=199999, rounds=199999", "distance=2, rounds=199999", "v1.2.10", "v1.2.9"]
    df = spark.createDataFrame([(i,) for i in items], "s string").orderBy(txt.natural_sort_key(F.col("s")))
    assert [r.s for r in df.collect()] == ["distance=2, rounds=3", "distance=2, rounds=199999", "distance=199999, rounds=3", "distance=199999, rounds=199999", "v1.2.9", "v1.2.10"]


def test_likelihood_values(spark):
    want = {10: 15.1044125730755, 100: 363.739375555563, 1000: 5912.12817848816, 10000: 82108.9278368144, 100000: 1051299.22189912}
    got = one(spark, *[num.log_factorial(F.lit(n)) for n in want])
    assert all(math.isclose(g, w, rel_tol=1e-11) for g, w in zip(got, want.values()))
    got = one(spark, *[num.log_binomial(F.lit(p), F.lit(2), F.lit(1)) for p in (0.0, 1.0, 0.1, 0.5)])
    assert got[0] == got[1] == -math.inf and math.isclose(got[2], math.log(0.18)) and math.isclose(got[3], math.log(0.5))


@pytest.mark.parametrize("shots,hits,factor,want", [
    (10**8, 2, 1000, (2e-10, 2e-8, 1.259e-7)), (10, 5, 9, (0.202, 0.5, 0.798)), (1000, 500, 1000, (0.44143, 0.5, 0.55857)),
    (100, 50, 1000, (0.3204, 0.5, 0.6796)), (0, 0, 1000, (0.0, 0.5, 1.0))])
def test_fit_binomial(spark, shots, hits, factor, want):
    got = one(spark, num.fit_binomial(F.lit(shots), F.lit(hits), factor)).c0
    assert got.low == pytest.approx(want[0], rel=1e-4) and got.best == pytest.approx(want[1]) and got.high == pytest.approx(want[2], rel=1e-3)


def test_piece_rates(spark):
    got = one(spark, num.piece_rate(F.lit(0.1), 2), num.piece_rate(F.lit(0.6), 10, 2), num.piece_rate(F.lit(0.0975), 10, 2), num.piece_rate(F.lit(1e-100), 100),
              num.piece_rate(F.lit(0.05278640450004207), 0.5), num.piece_rate(F.lit(0.5), 3), num.piece_rate(F.lit(0.3), 1, 5))
    want = [0.05278640450004207, 0.12052311142021144, 0.0104533, 1e-102, 0.1, 0.5, 0.3]
    assert all(math.isclose(g, w, rel_tol=1e-5) for g, w in zip(got, want))


def test_line_fits(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, 12.0), (3.0, 14.0)], "x double, y double")
    s = df.agg(*[c.alias(k) for k, c in num.fit_line_slope(F.col("x"), F.col("y"), 1).items()]).first()
    assert (s.low, s.best, s.high) == pytest.approx((1.2929, 2, 2.7071), abs=1e-4)
    s = df.agg(*[c.alias(k) for k, c in num.fit_line_y_at_x(F.col("x"), F.col("y"), 4, 1).items()]).first()
    assert (s.low, s.best, s.high) == pytest.approx((14.4725, 16, 17.5275), abs=1e-4)


def test_metadata_from_path(spark):
    assert one(spark, txt.key_values_from_path(F.lit("folder/d=5,r=3.5,x=abc.txt"))).c0 == '{"d":5,"r":3.5,"x":"abc"}'
    assert one(spark, txt.key_values_from_path(F.lit("folder/d=5,r.txt"), strict=False)).c0 is None
    with pytest.raises(Exception, match="key=value"):
        one(spark, txt.key_values_from_path(F.lit("folder/d=5,r.txt")))


@pytest.mark.parametrize("circuit,mask,meta,obs", [("", None, None, None), ("H 0\n\"é\U0001f600", [1, 0, 255], {"d": 5, "s": "a, b: é", "l": [1, {"x": None}]}, [3])])
def test_strong_id_matches_json_hash(spark, circuit, mask, meta, obs):
    doc = {"circuit": circuit, "decoder": "exact", "decoder_error_model": "", "postselection_mask": mask, "json_metadata": meta}
    if obs is not None:
        doc["postselected_observables_mask"] = obs
    arr = lambda a: F.array(*[F.lit(x) for x in a]) if a is not None else F.lit(None).cast("array<int>")
    # Metadata is JSON text in ASCII, as the writers produce it.
    text = F.lit(None if meta is None else json.dumps(meta, separators=(",", ":"))).cast("string")
    got = one(spark, txt.strong_id(F.lit(circuit), F.lit("exact"), F.lit(""), arr(mask), text, arr(obs))).c0
    assert got == hashlib.sha256(json.dumps(doc).encode()).hexdigest()


def test_limits_combine(spark):
    n = lambda v: F.lit(v).cast("bigint")
    assert tuple(one(spark, num.combine_limits(n(1000000), n(100000)), num.combine_limits(n(None), n(100)), num.combine_limits(n(100), n(None)))) == (100000, 100, 100)


def test_flatten_ring_and_nested(spark):
    ring = model(spark, "error(.1) D9 D0 L0\nrepeat 9 {\n error(.1) D0 D1\n shift_detectors 1\n}")
    got = [r.targets for r in md.flatten_model(tm.read_model_text(ring)).orderBy("path").collect()]
    assert got == [["D9", "D0", "L0"]] + [[f"D{i}", f"D{i + 1}"] for i in range(9)]
    nested = model(spark, "REPEAT 2 {\n error(0.1) D0\n repeat 3 {\n  shift_detectors(1, 2) 1\n  detector(5, 0, 7) D0\n }\n shift_detectors(10) 4\n}\ndetector(0) D0\nshift_detectors 1")
    m = tm.read_model_text(nested)
    flat = [(r.name, r.targets[0], r.args) for r in md.flatten_model(m).orderBy("path").collect()]
    inner = lambda base, x: [("detector", f"D{base + k}", [5.0 + x + k, 2.0 * (k + (3 if x else 0)), 7.0]) for k in (1, 2, 3)]
    assert flat == [("error", "D0", [0.1]), *inner(0, 0), ("error", "D7", [0.1]), *[("detector", f"D{7 + k}", [5.0 + 13 + k, 6.0 + 2.0 * k, 7.0]) for k in (1, 2, 3)], ("detector", "D14", [26.0])]
    assert tuple(md.total_shift(m).select("det_shift", "coord_shift").first()) == (15, [26.0, 12.0])
    assert tuple(md.model_counts(m).select("detectors", "errors").first()) == (15, 2)
    with pytest.raises(ValueError):
        md.flatten_model(m, max_rows=5)


def test_counting_does_not_unroll(spark):
    big = model(spark, "repeat 1000000000000 {\n error(0.1) D0 D1\n shift_detectors 3\n}")
    assert tuple(md.model_counts(tm.read_model_text(big)).select("detectors", "errors").first()) == (3 * (10**12 - 1) + 2, 10**12)


def test_shortest_undetectable_distance(spark):
    for d in (3, 5):
        edges = spark.createDataFrame([(i, i + 1, 0) for i in range(d - 2)] + [(0, None, 1), (d - 2, None, 0)], "u int, v int, obs_mask bigint")
        assert gr.shortest_undetectable(edges).count() == d


def test_undecodable_component(spark):
    edges = spark.createDataFrame([(0, 1, 1, 0), (2, 3, 1, 0), (2, None, 1, 0)], "u int, v int, w bigint, obs_mask bigint")
    hits = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (2, 2), (3, 9)], "shot_id bigint, det int")
    assert table(gr.undecodable_shots(hits, edges), "shot_id") == [(1, 1), (3, 1)]


def test_logarithms_of_zero_and_below_are_no_missing_values(spark):
    got = one(spark, *[num.rescale(F.lit(v), "log") for v in (0.0, -0.0, -1.0, 1.0)])
    assert got[0] == got[1] == -math.inf and math.isnan(got[2]) and got[3] == 0.0
    assert one(spark, num.rescale(F.lit(None).cast("double"), "log"))[0] is None
    points = spark.createDataFrame([("a", float(x), float(x)) for x in (0, 1, 2, 4)], "g string, x double, best double")
    ends = [(r.x, r.y) for r in st.line_fit_curves(points, ["g"], "log", "log", 3).collect()]
    assert len(ends) == 3 and all(x == pytest.approx(y) and math.isfinite(x) for x, y in ends)


def test_rounding_follows_the_scaled_double(spark):
    # As DuckDB rounds; F.round gives ...286.
    assert one(spark, num.round_half_away(num.rescale(F.lit(712.91) / 100, "log", True), 9))[0] == 1247.753483287
    assert one(spark, *[num.round_half_away(F.lit(v), d) for v, d in ((-2.5, 0), (0.125, 2), (1e300, 9), (-math.inf, 9))])[:4] == (-3.0, 0.13, 1e300, -math.inf)
    got = one(spark, num.round_half_away(F.lit(math.nan), 9), num.round_half_away(F.lit(None).cast("double"), 9))
    assert math.isnan(got[0]) and got[1] is None
