"""Laws, brute-force comparisons and skewed inputs."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parityspark import ordered
from parityspark.operators import decode as dc
from parityspark.operators import events as ev
from parityspark.operators import graph as gr
from parityspark.operators.matching import solve_subsets
from parityspark.operators import model as md
from parityspark.operators import parity as pa
from parityspark.operators import stats as st
from parityspark.operators import windows as wn
from parityspark.sources import shots as sh
from parityspark.sources import text_models as tm


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_running_sums_agree_when_a_key_is_hot(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 < 2, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("k"), (F.col("id") * 7 % 3001).alias("o"), (F.col("id") % 11).alias("v"))
    plain = ordered.running_sums(df, ["k"], ["o"], {"s": F.col("v"), "n": F.lit(1)})
    split = ordered.running_sums(df, ["k"], ["o"], {"s": F.col("v"), "n": F.lit(1)}, max_group=10)
    assert rows(plain, "k", "o") == rows(split, "k", "o")
    assert [r[0] for r in rows(ordered.global_index(df, ["o"], "i").select("i"), "i")] == list(range(3000))


def test_xor_is_its_own_inverse(spark):
    a = spark.range(500).select((F.col("id") % 20).alias("shot_id"), (F.col("id") * 13 % 24).cast("int").alias("det"))
    b = spark.range(300).select((F.col("id") % 25).alias("shot_id"), (F.col("id") * 5 % 24).cast("int").alias("det"))
    keys = ["shot_id", "det"]
    assert rows(pa.xor_sets(pa.xor_sets(a, b, keys), b, keys), *keys) == rows(pa.xor_reduce(a, keys), *keys)


def test_weight_merge_forms_agree(spark):
    pairs = [(3.0, 4.0), (-3.0, 4.0), (0.0, 5.0), (40.0, 41.0), (600.0, 2.0), (-1e-3, -2.0)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a double, b double")
    pair = [r.w for r in df.orderBy("i").select(pa.merge_weights_pair(F.col("a"), F.col("b")).alias("w")).collect()]
    long = df.select("i", F.explode(F.array("a", "b")).alias("w")).groupBy("i").agg(pa.merge_weights(F.col("w")).alias("w")).orderBy("i")
    assert [r.w for r in long.collect()] == pytest.approx(pair, rel=1e-9, abs=1e-12)


@pytest.mark.parametrize("fmt", ["01", "hits", "dets", "b8", "r8", "ptb64"])
def test_shot_files_round_trip(spark, tmp_path, fmt):
    rnd = random.Random(fmt)
    lay = sh.Layout(3, 600, 2)
    n = 64 * 3 if fmt == "ptb64" else 131
    data = [(s, k, i) for s in range(n) for k, m in lay.counts.items() for i in range(m) if rnd.random() < 0.01 and s % 5]
    shots = spark.range(n).withColumnRenamed("id", "shot_id")
    hits = spark.createDataFrame(data, "shot_id bigint, kind string, idx int")
    path = str(tmp_path / "out")
    sh.write_shots(shots, hits, path, fmt, lay)
    assert rows(sh.read_shots(spark, path, fmt, lay), "shot_id", "kind", "idx") == sorted(data)
    if fmt != "r8":
        assert sh.count_shots(spark, path, fmt, lay).count() == n


@pytest.mark.parametrize("fmt", ["b8", "r8", "ptb64"])
def test_packed_reader_splits_files_and_pieces(spark, tmp_path, monkeypatch, fmt):
    from parityspark.sources import shot_source

    lay = sh.Layout(2, 300, 1)
    data = [(s, "D", (s * 37 + k * 101) % 300) for s in range(192) for k in range(3)] + [(s, "L", 0) for s in range(0, 192, 7)] + [(s, "M", 1) for s in range(0, 192, 5)]
    hits = pa.xor_reduce(spark.createDataFrame(data, "shot_id bigint, kind string, idx int"), ["shot_id", "kind", "idx"])
    path = str(tmp_path / fmt)
    files = sh.write_shots_packed(spark.range(192).withColumnRenamed("id", "shot_id"), hits, path, fmt, lay)
    assert sum(r.shots for r in files.collect()) == 192 and files.count() == len(list((tmp_path / fmt).glob("shots-*")))
    small = sh.read_shots(spark, path, fmt, lay, split_bytes="60", parallelism="1000")
    assert small.rdd.getNumPartitions() > files.count() if fmt != "ptb64" else True
    assert rows(small, "shot_id", "kind", "idx") == rows(hits, "shot_id", "kind", "idx")
    # The same pieces inside one range, read by the reader itself.
    monkeypatch.setattr(shot_source, "CHUNK", 64)
    options = {"split_bytes": "100000000"} | ({"index": sh.index_runs(spark, path, lay)[0]} if fmt == "r8" else {})
    reader = shot_source.ShotReader(f"file://{path}", shot_source.Shape(fmt, 2, 300, 1), "hits", options)
    parts = reader.partitions()
    batches = [b for p in parts for b in reader.read(p)]
    assert len(parts) < len(batches)
    assert sorted(tuple(r.values()) for b in batches for r in b.to_pylist()) == rows(hits, "shot_id", "kind", "idx")


def test_packed_writes_appear_whole_or_not_at_all(spark, tmp_path):
    lay, path = sh.Layout(0, 8, 0), tmp_path / "out"
    shots = spark.range(1000).withColumnRenamed("id", "shot_id")
    hits = shots.select("shot_id", F.lit("D").alias("kind"), F.lit(3).alias("idx"))
    dying = hits.withColumn("idx", F.when(F.col("shot_id") == 900, F.raise_error(F.lit("power cut")).cast("int")).otherwise(F.col("idx")))
    late = sh._shot_rows(shots, hits, lay).repartitionByRange(4, "shot_id").sortWithinPartitions("shot_id")
    late = late.withColumn("pos", F.when(F.col("shot_id") == 999, F.raise_error(F.lit("power cut")).cast("array<int>")).otherwise(F.col("pos")))
    for failing in (lambda: sh.write_shots(shots, dying, str(path), "b8", lay), lambda: late.write.format("shots").options(**sh._source(spark, str(path), "b8", lay)).mode("append").save()):
        with pytest.raises(Exception, match="power cut"):
            failing()
        assert not list(path.rglob("*"))  # neither files nor what the finished tasks had written
    sh.write_shots(shots, hits, str(path), "b8", lay)
    assert sh.read_shots(spark, str(path), "b8", lay).count() == 1000
    sh.write_shots_packed(shots.filter("shot_id < 10"), hits.filter("shot_id < 10"), str(path), "b8", lay, overwrite=True)
    assert sh.read_shots(spark, str(path), "b8", lay).count() == 10
    assert not list(path.glob("_temporary*"))


def test_shot_source_through_the_plain_reader(spark, tmp_path):
    lay = sh.Layout(0, 8, 1)
    sh.write_shots(spark.range(3).withColumnRenamed("id", "shot_id"), spark.createDataFrame([(1, "L", 0), (2, "D", 5)], "shot_id bigint, kind string, idx int"), str(tmp_path / "a"), "b8", lay)
    read = spark.read.format("shots").option("encoding", "b8").option("n_det", 8).option("n_obs", 1)
    assert rows(read.load(f"file://{tmp_path}/a"), "shot_id", "kind", "idx") == [(1, "L", 0), (2, "D", 5)]
    assert rows(read.load(f"file://{tmp_path}/a/*.b8"), "shot_id", "kind", "idx") == [(1, "L", 0), (2, "D", 5)]
    for bad, options in ((f"{tmp_path}/a", {}), (f"file://{tmp_path}/none", {}), (f"file://{tmp_path}/a", {"n_det": "30"}), (f"file://{tmp_path}/a", {"encoding": "r8"})):
        with pytest.raises(Exception):
            read.options(**options).load(bad).collect()


def brute(key, dist, rim):
    if not key:
        return 0.0
    a, rest = key[0], key[1:]
    best = rim.get(a, float("inf")) + brute(rest, dist, rim)
    for b in rest:
        best = min(best, dist.get((a, b), float("inf")) + brute([x for x in rest if x != b], dist, rim))
    return best


def graph(spark, seed, n=8):
    rnd = random.Random(seed)
    edges = [(i, j, rnd.randint(1, 20), rnd.randint(0, 1)) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.5]
    edges += [(i, 99, rnd.randint(5, 15), rnd.randint(0, 1)) for i in range(0, n, 3)]
    return spark.createDataFrame(edges, "u int, v int, w bigint, obs_mask bigint")


def lookup(paths):
    table = {(r.src, r.node): float(r.dist) for r in paths.collect()}
    return {k: v for k, v in table.items() if k[1] != 99}, {a: v for (a, b), v in table.items() if b == 99}


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_matching_against_brute_force(spark, seed):
    paths = gr.pair_distances(graph(spark, seed), 99)
    keys = [list(c) for k in range(1, 9) for c in itertools.combinations(range(8), k)]
    solved = dc.decode_exact(spark.createDataFrame([(k,) for k in keys], "key array<int>"), paths, 99)
    dist, rim = lookup(paths)
    got = {tuple(r.key): r for r in solved.collect()}
    obs = {(r.src, r.node): r.obs for r in paths.collect()}
    for key in keys:
        r, want = got[tuple(key)], brute(key, dist, rim)
        assert (r.w if r.w is not None else float("inf")) == want
        if r.w is not None:
            x = 0
            for p in r.pairs:
                x ^= obs[(p.a, 99 if p.b is None else p.b)]
            assert x == r.obs
            assert sorted(d for p in r.pairs for d in (p.a, p.b) if d is not None) == key


def test_pruned_paths_give_the_same_matchings(spark):
    keys = spark.createDataFrame([(list(c),) for k in (2, 4, 7) for c in itertools.combinations(range(8), k)], "key array<int>")
    for seed in (8, 9):
        edges = graph(spark, seed)
        everything, pruned = gr.pair_distances(edges, 99), gr.matching_paths(edges, 99)
        assert pruned.count() <= everything.count()
        show = lambda p: rows(dc.decode_exact(keys, p, 99).select("key", "w", "obs", F.to_json("pairs").alias("p")), "key")
        assert show(everything) == show(pruned)


def test_greedy_is_a_matching_and_never_better(spark):
    paths = gr.pair_distances(graph(spark, 3), 99)
    keys = spark.createDataFrame([(list(c),) for k in (3, 5, 8) for c in itertools.combinations(range(8), k)], "key array<int>")
    exact = {tuple(r.key): r.w for r in dc.decode_exact(keys, paths, 99).collect()}
    for r in dc.decode_greedy(keys, paths, 99).collect():
        if r.w is not None:
            assert sorted(d for p in r.pairs for d in (p.a, p.b) if d is not None) == list(r.key)
            assert r.w >= exact[tuple(r.key)]


def test_large_syndromes_are_answered(spark):
    chain = spark.createDataFrame([(i, i + 1, 2, 0) for i in range(29)] + [(i, 99, 7, 1) for i in range(30)], "u int, v int, w bigint, obs_mask bigint")
    keys = spark.createDataFrame([(list(range(0, 30, 2)),), ([1, 2],)], "key array<int>")
    paths = gr.pair_distances(chain, 99)
    got = {len(r.key): r for r in dc.decode(keys, paths, 99).collect()}
    dist, rim = lookup(paths)
    # Seven neighbours at distance 4 and one way out at 7.
    assert {k: r.reason for k, r in got.items()} == {15: "exact", 2: "exact"} and got[15].w == 7 * 4 + 7 and got[2].w == 2


def test_rounds_in_spark_agree_with_the_tables(spark):
    rng = np.random.default_rng(5)
    cases, want = [], {}
    for n, k in enumerate([1, 2, 3, 5, 5, 6, 6, 7, 13]):
        rim, pair = rng.integers(3, 9, k).astype(float), rng.integers(1, 9, (k, k)).astype(float)
        pair = np.minimum(pair, pair.T)
        rim[rng.random(k) < 0.3] = np.inf
        if n == 3:
            rim[:], pair[0, :], pair[:, 0] = np.inf, np.inf, np.inf
        total, mate = (x[0] for x in solve_subsets(rim[None], pair[None]))
        key = [100 * n + i for i in range(k)]
        flat = [*rim, *pair[np.triu_indices(k, 1)]]
        obs = [int(x) for x in rng.integers(0, 8, len(flat))]
        cases.append((key, [None if np.isinf(x) else float(x) for x in flat], obs))
        pairs = [(i, int(j)) for i, j in enumerate(mate) if j < 0 or j > i]
        where = {(i, j): k + m for m, (i, j) in enumerate(itertools.combinations(range(k), 2))} | {(i, -1): i for i in range(k)}
        mask = 0
        for x in pairs:
            mask ^= obs[where[x]]
        want[tuple(key)] = (total, mask, [(key[i], key[j] if j >= 0 else -1) for i, j in pairs]) if np.isfinite(total) else (None, None, None)
    got = dc._by_rounds(spark.createDataFrame(cases, "key array<int>, d array<double>, o array<bigint>")).collect()
    assert {tuple(r.key): (r.w, r.obs, r.a and list(zip(r.a, r.b))) for r in got} == want and sum(w is None for w, _, _ in want.values()) > 0
    paths = gr.pair_distances(spark.createDataFrame([(i, j, 1 + (i * j) % 3, i % 2) for i in range(14) for j in range(i)], "u int, v int, w bigint, obs_mask bigint"), 99)
    dense = dc.decode_exact(spark.createDataFrame([(list(range(14)),)], "key array<int>"), paths, 99)
    assert dense.first().reason == "exact" and len(dense.first().pairs) == 7


def test_paths_reach_along_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1, 1, 0) for i in range(70)] + [(0, 999, 1, 1)], "u int, v int, w bigint, obs_mask bigint").coalesce(1)
    found = gr.pair_distances(chain, 999, sources=spark.createDataFrame([(70,)], "src int"))
    assert found.filter("node = 999").select("dist", "hops").first()[:] == (71, 71)
    with pytest.raises(Exception, match="negative edge weight"):
        gr.pair_distances(chain.withColumn("w", -F.col("w")), 999).count()


def test_far_apart_clusters_are_solved_exactly(spark):
    edges = [(i, i + 1, 2, i % 2) for i in range(59)] + [(i, 99, 5, 1) for i in range(60)]
    paths = gr.pair_distances(spark.createDataFrame(edges, "u int, v int, w bigint, obs_mask bigint"), 99)
    key = [0, 1, 2, 10, 11, 20, 21, 22, 23, 30, 40, 41, 50, 51, 52]
    got = dc.decode(spark.createDataFrame([(key,)], "key array<int>"), paths, 99).first()
    dist, rim = lookup(paths)
    parts = [[0, 1, 2], [10, 11], [20, 21, 22, 23], [30], [40, 41], [50, 51, 52]]
    assert got.reason == "exact" and got.w == sum(brute(p, dist, rim) for p in parts)
    assert sorted(d for p in got.pairs for d in (p.a, p.b) if d is not None) == key


def test_one_wide_window_equals_global_decoding(spark):
    edges = graph(spark, 5)
    rim = edges.withColumn("v", F.when(F.col("v") != 99, F.col("v")))
    rounds = spark.range(8).select(F.col("id").cast("int").alias("det"), F.floor(F.col("id") / 2).cast("int").alias("round_id"))
    rnd = random.Random(0)
    hits = spark.createDataFrame([(s, d) for s in range(40) for d in range(8) if rnd.random() < 0.3], "shot_id bigint, det int")
    shots = spark.range(40).withColumnRenamed("id", "shot_id")
    out = dc.decode_windowed(shots, hits, rim, rounds, 8, 4, 4, 4)
    want = dc.decode_shots(shots, hits, gr.pair_distances(edges, 99), 99).select("shot_id", "pred_mask")
    assert rows(out["predictions"], "shot_id") == rows(want, "shot_id")
    assert out["left"].isEmpty()


def test_windowed_decoding_moves_shots_and_not_hits(spark, monkeypatch):
    edges = graph(spark, 5)
    rim = edges.withColumn("v", F.when(F.col("v") != 99, F.col("v")))
    rounds = spark.range(8).select(F.col("id").cast("int").alias("det"), F.floor(F.col("id") / 2).cast("int").alias("round_id"))
    rnd = random.Random(4)
    # Hit (0, 7) is recorded twice and cancels; detector 8 has no round.
    once = [(s, d) for s in range(40) for d in range(8) if rnd.random() < 0.4 and (s, d) != (0, 7)]
    hits = spark.createDataFrame([*once, (0, 7), (0, 7), (1, 8)], "shot_id bigint, det int")
    shots = spark.range(40).withColumnRenamed("id", "shot_id")
    written, plain = [], dc.cut
    monkeypatch.setattr(dc, "cut", lambda df, label="step": written.append((label, plain(df, label))) or written[-1][1])
    monkeypatch.setattr(dc, "drop", lambda *tables: None)
    out = dc.decode_windowed(shots, hits, rim, rounds, 8, 4, 1, 2)
    # One written row a shot and window at most, and every hit laid out once.
    for label, table in written:
        if "shot_id" in table.columns and label != "hits-by-window":
            assert table.count() == table.select("shot_id").distinct().count() > 0, label
    laid = dict(written)["hits-by-window"]
    assert laid.groupBy("shot_id", "win").count().filter("count > 1").isEmpty()
    assert laid.agg(F.sum(F.size("hits"))).first()[0] == len(once)
    # Edges explain hits: what they toggle is what was recorded, up to the hits left over.
    assert out["predictions"].count() == 40
    assert out["left"].groupBy("shot_id", "det").count().filter("count > 1").isEmpty()


def test_two_level_decoding_without_inner_hits_is_the_outer_decoder(spark):
    edges = graph(spark, 6)
    paths = gr.pair_distances(edges, 99)
    rnd = random.Random(2)
    hits = spark.createDataFrame([(s, d) for s in range(30) for d in range(8) if rnd.random() < 0.3], "shot_id bigint, det int")
    shots = spark.range(30).withColumnRenamed("id", "shot_id")
    routed = hits.select("shot_id", F.lit("outer").alias("stream"), F.col("det").alias("idx"), F.col("det").alias("outer_idx"))
    rim = edges.withColumn("v", F.when(F.col("v") != 99, F.col("v")))
    rounds = spark.range(8).select(F.col("id").cast("int").alias("det"), F.floor(F.col("id") / 2).cast("int").alias("round_id"))
    got = dc.decode_two_level(shots, routed, rim, rounds, 8, 4, 4, 4, paths, 99)
    want = dc.decode_shots(shots, hits, paths, 99).select("shot_id", F.coalesce("pred_mask", F.lit(0).cast("bigint")).alias("pred_mask"))
    assert rows(got, "shot_id") == rows(want, "shot_id")
    # With every hit inner and no boundary commit, hits the inner pass cannot pair up move to the outer code.
    inner = routed.withColumn("stream", F.lit("inner"))
    both = dc.decode_two_level(shots, inner, rim, rounds, 8, 4, 4, 4, paths, 99)
    assert both.count() == 30 and both.filter("pred_mask IS NULL").isEmpty()


def test_correlated_second_pass_against_brute_force(spark):
    edges = graph(spark, 7)
    paths = gr.pair_distances(edges, 99)
    implied_rows = [(r.u, r.v, (r.u + 1) % 8, 99 if r.v == 99 else (r.v + 1) % 8) for r in edges.collect()]
    known = {tuple(sorted((r.u, r.v))): (r.w, r.obs_mask) for r in edges.collect()}
    rules = [(a, b, c, d, known[tuple(sorted((c, d)))][0] / 4) for a, b, c, d in implied_rows if tuple(sorted((c, d))) in known]
    implied = spark.createDataFrame(rules, "cu int, cv int, au int, av int, w double")
    keys = [list(c) for k in (2, 3, 4) for c in itertools.combinations(range(8), k)]
    frame = spark.createDataFrame([(k,) for k in keys], "key array<int>")
    got = {tuple(r.key): r.w for r in dc.decode_correlated(frame, paths, edges, implied, 99).collect()}
    first = dc.decode_exact(frame, paths, 99)
    used = {}
    for r in dc.solution_edges(dc.matched_pairs(first), paths, 99).collect():
        used.setdefault(tuple(r.key), []).append(tuple(sorted((r.u, r.v))))
    for key in keys:
        w = {e: float(v[0]) for e, v in known.items()}
        for a, b, c, d, low in rules:
            if tuple(sorted((a, b))) in used.get(tuple(key), []):
                e = tuple(sorted((c, d)))
                w[e] = min(w[e], low)
        d = {(i, j): (0.0 if i == j else w.get(tuple(sorted((i, j))), float("inf"))) for i in range(8) for j in range(8)}
        for m in range(8):
            for i in range(8):
                for j in range(8):
                    d[i, j] = min(d[i, j], d[i, m] + d[m, j])
        rim = {i: min(d[i, j] + w.get((j, 99), float("inf")) for j in range(8)) for i in range(8)}
        want = brute(key, d, rim)
        have = got[tuple(key)]
        assert (have if have is not None else float("inf")) == pytest.approx(want)


def test_hyperedge_search_against_brute_force(spark):
    rnd = random.Random(4)
    mech = {(tuple(sorted(rnd.sample(range(6), rnd.randint(1, 3)))), rnd.randint(0, 1)) for _ in range(9)}
    moves = spark.createDataFrame([(list(d), o) for d, o in mech], "dets array<int>, obs bigint")
    best = None
    for n in range(1, len(mech) + 1):
        for c in itertools.combinations(mech, n):
            acc, o = set(), 0
            for d, x in c:
                acc ^= set(d)
                o ^= x
            if not acc and o:
                best = n
                break
        if best:
            break
    if best is None:
        with pytest.raises(ValueError):
            gr.undetectable_hyper(moves, 6, 3)
    else:
        found = gr.undetectable_hyper(moves, 6, 3).collect()
        assert len(found) >= best
        acc, o = set(), 0
        for r in found:
            acc ^= set(r.dets)
            o ^= r.obs
        assert not acc and o


def test_masks_hold_any_observable(spark):
    from parityspark.functions import bits
    from parityspark.functions import numeric as num

    errors = spark.createDataFrame([(0, 0.1)], "err_id bigint, p double")
    parts = lambda k: spark.createDataFrame([(0, 0, "D", 70), (0, 0, "L", k)], "err_id bigint, comp int, kind string, idx int")
    assert md.edges_from_model(errors, parts(62)).first().obs_mask == 1 << 62
    for k in (63, 64, 70, 130, 1000):
        row = md.edges_from_model(errors, parts(k)).select("obs_mask", bits.indices(F.col("obs_mask")).alias("i")).first()
        assert row.i == [k] and len(row.obs_mask) == k // 64 + 1
    with pytest.raises(Exception, match="not 64"):  # never a wrap-around where the number of observables was understated
        md.edges_from_model(errors, parts(64), n_obs=10).collect()
    with pytest.raises(Exception, match="not 200"):
        md.edges_from_model(errors, parts(200), n_obs=100).collect()
    packed = spark.createDataFrame([(0, 5), (0, 63), (0, 127), (1, None)], "g int, i int").groupBy("g").agg(num.mask_pack(F.col("i"), 130).alias("m"))
    assert {r.g: r.i for r in packed.select("g", num.mask_unpack(F.col("m"), 130).alias("i")).collect()} == {0: [5, 63, 127], 1: []}


def test_vectors_of_words_are_aligned(spark):
    from parityspark.functions import bits

    rows = [(0, [1, 2]), (0, [3]), (0, [0, 0, -(1 << 63)]), (1, []), (2, None), (2, [7])]
    df = spark.createDataFrame(rows, "g int, m array<bigint>")
    assert {r.g: r.m for r in bits.xor_by(df, ["g"], "m").collect()} == {0: [2, 2, -(1 << 63)], 2: [7]}
    m = bits.Masks(True)
    value = m.value((1 << 191) + 2)
    got = df.filter("m is not null").select(m.any(m.both(F.col("m"), value)).alias("hit"), m.xor(F.col("m"), m.zero()).alias("same"), "m").collect()
    assert [r.hit for r in got] == [False, True, True, False, True] and all(r.same == r.m for r in got)


def test_wide_observables_follow_the_narrow_ones(spark):
    """Every decoder gives the observables of the narrow run, moved beyond one word."""
    from parityspark.functions import bits

    rng = np.random.default_rng(5)
    n = 15
    links = [(i, i + 1, int(rng.integers(1, 20)), int(rng.integers(0, 4))) for i in range(n - 1)] + [(i, int(j), int(rng.integers(1, 40)), int(rng.integers(0, 4))) for i in range(n) for j in rng.integers(0, n, 2) if i != j]
    links = {(min(a, b), max(a, b)): (w, o) for a, b, w, o in links}
    rows = [(a, b, w, o) for (a, b), (w, o) in links.items()] + [(0, -1, 9, 1), (7, -1, 25, 2)]
    narrow = spark.createDataFrame(rows, "u int, v int, w bigint, obs_mask bigint")
    far = F.when(F.getbit("obs_mask", F.lit(0)) == 1, bits.single(F.lit(64), 3)).otherwise(bits.literal(0, 3))
    wide = narrow.withColumn("obs_mask", bits.Masks(True).xor(far, F.when(F.getbit("obs_mask", F.lit(1)) == 1, bits.single(F.lit(191), 3)).otherwise(bits.literal(0, 3))))
    keys = {tuple(sorted(rng.choice(n, size=int(k), replace=False).tolist())) for k in rng.integers(1, n + 1, 12)}
    syndromes = spark.createDataFrame([(list(k),) for k in keys], "key array<int>")
    a, b = (gr.matching_paths(e, -1) for e in (narrow, wide))
    for decoder in (dc.decode, dc.decode_greedy):
        want = {tuple(r.key): [x for x, y in ((64, 1), (191, 2)) if r.obs & y] for r in decoder(syndromes, a).collect()}
        got = {tuple(r.key): r.i for r in decoder(syndromes, b).select("key", bits.indices(F.col("obs")).alias("i")).collect()}
        assert got == want


def test_piece_rates_refuse_bad_ranges(spark):
    from parityspark.functions import numeric as num

    for rate, pieces in ((1.5, 2), (-0.1, 2), (0.5, 0)):
        with pytest.raises(Exception, match="number of pieces"):
            spark.range(1).select(num.piece_rate(F.lit(rate) + F.col("id"), pieces)).collect()


def test_a_missing_prediction_is_never_right(spark):
    actual = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "shot_id bigint, obs_mask bigint")
    pred = spark.createDataFrame([(0, 0), (1, None)], "shot_id bigint, pred_mask bigint")
    assert {r.shot_id: r.is_error for r in ev.score_predictions(pred, actual).collect()} == {0: False, 1: True, 2: True}


def test_packed_files_are_not_mixed_with_older_ones(spark, tmp_path):
    layout, shots = sh.Layout(0, 3, 0), spark.range(5).withColumnRenamed("id", "shot_id")
    hits = spark.createDataFrame([(1, "D", 2)], "shot_id bigint, kind string, idx int")
    for fmt in ("b8", "r8"):
        sh.write_shots(shots, hits, f"{tmp_path}/{fmt}", fmt, layout)
        assert sh.count_shots(spark, f"{tmp_path}/{fmt}", fmt, layout).count() == 5
        with pytest.raises(FileExistsError):
            sh.write_shots(shots, hits, f"{tmp_path}/{fmt}", fmt, layout)


def test_merge_is_order_independent(spark):
    rnd = random.Random(1)
    data = [(f"t{i % 4}", "d", "{}", rnd.randint(1, 99), rnd.randint(0, 9), 0, float(rnd.randint(0, 9)), {"k": 1}) for i in range(200)]
    schema = "strong_id string, decoder string, json_metadata string, shots bigint, errors bigint, discards bigint, seconds double, custom_counts map<string,bigint>"
    a = st.fold_stats(spark.createDataFrame(data, schema))
    half = st.append_stats(st.fold_stats(spark.createDataFrame(data[::2], schema)), st.fold_stats(spark.createDataFrame(data[1::2], schema)))
    show = lambda df: rows(df.withColumn("custom_counts", F.to_json("custom_counts")).select("strong_id", "shots", "errors", "seconds", "custom_counts"), "strong_id")
    assert show(a) == show(half)


def test_components_follow_long_chains(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1, 1, 0) for i in range(n)], "u int, v int, w bigint, obs_mask bigint")
    hits = spark.createDataFrame([(0, i) for i in range(n) if i != 100], "shot_id bigint, det int")
    assert rows(gr.hit_components(hits, edges).select("cluster", "size"), "cluster") == [(0, 100), (101, n - 101)]


@pytest.mark.parametrize("fold_rows", [256, 6, 0])
def test_components_folded_and_in_rounds_agree(spark, monkeypatch, fold_rows):
    monkeypatch.setattr(gr, "FOLD_ROWS", fold_rows)
    rnd = random.Random(fold_rows)
    nodes, links, want = [], [], {}
    for g in range(12):
        n = rnd.randint(1, 14)
        label = list(range(n))
        nodes += [(g, i) for i in range(n)] + [(g, 0)]
        for _ in range(rnd.randint(0, n)):
            u, v = rnd.randrange(n), rnd.randrange(n)
            links += [(g, u, v)] * rnd.randint(1, 2)
            lo, hi = sorted((label[u], label[v]))
            label = [lo if x == hi else x for x in label]
        want.update({(g, i): x for i, x in enumerate(label)})
    found = gr.connected_components(spark.createDataFrame(nodes, "grp int, node int"), spark.createDataFrame(links, "grp int, u int, v int")).collect()
    assert {(r.grp, r.node): r.label for r in found} == want and len(found) == len(want)
    assert gr.connected_components(spark.createDataFrame([], "grp int, node int"), spark.createDataFrame([], "grp int, u int, v int")).count() == 0


def test_distances_of_real_weights_and_improved_labels(spark):
    """A long cheap way beats a short dear one in a later round; weights need not be whole numbers."""
    edges = spark.createDataFrame([(0, 5, 9.5, 1), (0, 1, 0.5, 0), (1, 2, 0.5, 1), (2, 3, 0.5, 0), (3, 4, 0.5, 1), (4, 5, 0.5, 1)], "u int, v int, w double, obs_mask bigint")
    found = {r.node: (r.dist, r.hops, r.prev, r.obs) for r in gr.pair_distances(edges, 99, sources=spark.createDataFrame([(0,)], "src int")).collect()}
    assert found[5] == (2.5, 5, 4, 1) and found[4] == (2.0, 4, 3, 0) and len(found) == 6


def test_text_round_trip(spark):
    lines = [(0, 0, "error[x\\Cy\\B](0.25) D0 ^ D1 L2"), (0, 1, "detector(1, 2.5) D7"), (0, 2, "# nothing"), (0, 3, "repeat 3 {"), (0, 4, "  shift_detectors 1"), (0, 5, "}")]
    m = tm.read_model_text(spark.createDataFrame(lines, "model_id int, seq bigint, line string"))
    again = tm.read_model_text(tm.instruction_lines(m).select("model_id", "seq", "line"))
    assert m.filter("seq = 0").first().tag == "x]y\\"
    assert rows(m.withColumn("t", F.to_json(F.struct("args", "targets"))).drop("args", "targets"), "seq") == rows(again.withColumn("t", F.to_json(F.struct("args", "targets"))).drop("args", "targets"), "seq")
    assert md.model_diff(m, again, 0.0).isEmpty()


def test_round_differences_match_lag(spark):
    bits = pa.xor_reduce(spark.range(400).select((F.col("id") % 9).alias("shot_id"), (F.col("id") % 4).cast("int").alias("check"), (F.col("id") * 3 % 7).cast("int").alias("round_id")), ["shot_id", "check", "round_id"])
    have = {tuple(r) for r in bits.collect()}
    want = sorted((s, c, r) for s in range(9) for c in range(4) for r in range(7) if ((s, c, r) in have) != ((s, c, r - 1) in have))
    assert rows(wn.round_differences(bits, 7).select("shot_id", "check", "round_id"), "shot_id", "check", "round_id") == want


def test_two_level_renumbering(spark):
    det = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (2, 0, 3), (3, 1, 3)], "det int, base_det int, round_id int")
    base = spark.createDataFrame([(0, 0, 0), (1, None, 1)], "base_det int, inner_id int, outer_id int")
    hits = spark.createDataFrame([(0, d) for d in range(4)], "shot_id bigint, det int")
    got = rows(ev.route_two_level(hits, det, base, 2, 1, 2).select("det", "stream", "idx"), "det")
    assert got == [(0, "inner", 0), (1, "outer", 1), (2, "inner", 3), (3, "outer", 3)]


def test_parity_sets_agree_with_their_rows(spark):
    from parityspark.operators.parity_sets import ParitySets

    rng = random.Random(2)
    shots = spark.createDataFrame([(i,) for i in range(40)], "shot_id bigint")
    draw = lambda p: {(s, d) for s in range(30) for d in range(12) if rng.random() < p}
    for base in ([], [3], list(range(0, 12, 2)), list(range(12))):
        one, two = draw(0.2), draw(0.1)
        frame = lambda x: spark.createDataFrame(sorted(x), "shot_id bigint, det int")
        sets = ParitySets(shots, frame(one), spark.createDataFrame([(d,) for d in base], "det int")).xor(frame(two))
        want = {(s, d) for s in range(40) for d in range(12) if ((s, d) in one) ^ ((s, d) in two) ^ (d in base)}
        assert rows(sets.rows(), "shot_id", "det") == sorted(want)
        assert sets.total().first().n == len(want)
        assert {r.shot_id: r.n for r in sets.sizes().collect()} == {s: sum(x == s for x, _ in want) for s in range(40)}
        mask = spark.createDataFrame([(1,), (2,), (99,)], "det int")
        assert {r.shot_id for r in sets.within(mask).any().collect()} == {s for s, d in want if d in (1, 2)}
        assert rows(sets.of(shots.filter("shot_id < 5")).rows(), "shot_id", "det") == sorted(x for x in want if x[0] < 5)


def test_toggled_predictions_cover_shots_without_hits_and_cancelled_ones(spark):
    from parityspark.plans import jobs

    lines = ["error(0.8) D0 D1 L0", "error(0.1) D0 L1", "error(0.1) D1", "error(0.05) D2 L2", "error(0.2) D1 D2"]
    model = spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "model_id int, seq bigint, line string")
    tables = jobs.model_tables(model)
    paths = jobs.model_paths(tables["errors"], tables["targets"])
    base_obs, base_w = paths["base"].select("base_obs", "base_w").first()
    shots = spark.range(5).withColumnRenamed("id", "shot_id")
    hits = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (3, 2), (4, 0), (4, 1), (4, 2)], "shot_id bigint, det int")
    got = {r.shot_id: r for r in jobs._toggled_predictions(shots, dc.shot_syndromes(hits), paths["toggles"], paths["paths"]).collect()}
    probs = [(0.8, {0, 1}, 1), (0.1, {0}, 2), (0.1, {1}, 0), (0.05, {2}, 4), (0.2, {1, 2}, 0)]
    for shot in range(5):
        want = {r.det for r in hits.filter(F.col("shot_id") == shot).collect()}
        best = None
        for pick in itertools.product((0, 1), repeat=5):
            flips, obs, p = set(), 0, 1.0
            for on, (q, dets, o) in zip(pick, probs):
                p *= q if on else 1 - q
                if on:
                    flips, obs = flips ^ dets, obs ^ o
            if flips == want and (best is None or p > best[0]):
                best = (p, obs)
        assert got[shot].pred_mask ^ base_obs == best[1]
    assert got[2].reason == "empty" and got[0].reason == "exact"


def test_correlated_rounds_agree_with_the_tables(spark, monkeypatch):
    edges = graph(spark, 4, 9)
    rng = random.Random(8)
    implied = spark.createDataFrame([(rng.randrange(9), rng.randrange(9), r.u, r.v, r.w * rng.choice([0.0, 0.25, 0.5])) for r in edges.collect() for _ in range(4)], "cu int, cv int, au int, av int, w double")
    paths = gr.matching_paths(edges, 99)
    frame = spark.createDataFrame([(sorted(rng.sample(range(9), k)),) for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, 4, 4)], "key array<int>").distinct()
    show = lambda: sorted((tuple(r.key), r.w, r.obs, r.reason) for r in dc.decode_correlated(frame, paths, edges, implied, 99).collect())
    inside = show()
    assert sum(r[3] == "correlated" for r in inside) > 3
    monkeypatch.setattr(dc, "DENSE_HITS", 2)
    assert [(k, w) for k, w, _, _ in show()] == [(k, w) for k, w, _, _ in inside]


def test_overridden_graphs_relaxed_as_rows_equal_the_rounds(spark):
    # Small whole weights leave many ties, which both ways must break alike.
    rng = random.Random(31)
    ends = {(a, b): (rng.choice([2, 4, 6]), rng.randrange(8)) for a in range(12) for b in rng.sample([*range(a + 1, 13), 99], min(3, 13 - a))}
    edges = spark.createDataFrame([(u, v, w, o) for (u, v), (w, o) in ends.items()], "u int, v int, w bigint, obs_mask bigint")
    pairs = list(ends)
    implied = spark.createDataFrame([(*rng.choice(pairs), *p, ends[p][0] * rng.choice([0.0, 0.5])) for p in pairs for _ in range(9)], "cu int, cv int, au int, av int, w double")
    paths = gr.matching_paths(edges, 99)
    frame = spark.createDataFrame([(sorted(rng.sample(range(13), k)),) for k in (1, 2, 3, 4, 5, 6, 7, 8) for _ in range(8)], "key array<int>").distinct()
    show = lambda widest: sorted(map(str, dc.decode_correlated(frame, paths, edges, implied, 99, widest).select("key", "w", "obs", "reason").collect()))
    as_rows = show(32)
    assert sum("correlated" in r for r in as_rows) > 20
    assert as_rows == show(0) == show(7)


def test_tasks_decoded_together_under_their_own_models(spark):
    from parityspark.plans import jobs

    # Same hits, different models: task 0 goes through the boundary, task 1 along its middle edge, task 2 has no way.
    models = [(0, 1, None, 1, 1), (0, 2, None, 1, 0), (0, 1, 2, 9, 0), (1, 1, None, 9, 1), (1, 2, None, 9, 0), (1, 1, 2, 1, 0), (2, 1, None, 1, 1)]
    models = spark.createDataFrame(models, "part int, u int, v int, w bigint, obs_mask bigint")
    shots = spark.createDataFrame([(s, s % 3) for s in range(9)], "shot_id bigint, part int")
    hits = spark.createDataFrame([(s, s % 3, d) for s in range(6) for d in (1, 2)], "shot_id bigint, part int, det int")
    found = {r.shot_id: (r.pred_mask, r.w) for r in jobs.decode_tasks(shots, hits, models).collect()}
    assert found == {s: ([(1, 2.0), (0, 1.0), (None, None)][s % 3] if s < 6 else (0, 0.0)) for s in range(9)}
    tasks = spark.createDataFrame([(f"t{p}", p, None, 100, None) for p in range(3)], "strong_id string, part int, decoder string, max_shots bigint, max_errors bigint")
    have = spark.createDataFrame([("t1", 100, 0)], "strong_id string, shots bigint, errors bigint")
    recorded = shots.select("shot_id", "part", F.lit(0).cast("bigint").alias("obs_mask"), F.lit(1.0).alias("seconds"))
    nothing = spark.createDataFrame([], "det int")
    out = jobs.collect_decoding(tasks, have, {"exact": dc.decode, "none": None}, recorded, hits.select("shot_id", "det"), models, nothing, 1, 3)
    got = {r.strong_id: (r.shots, r.errors, r.discards, r.custom_counts.get("obs_mistake_mask=E", 0)) for r in out.collect()}
    # An infeasible shot is an error without a pattern; the finished task is left out.
    assert got == {"t0/exact": (3, 2, 0, 2), "t0/none": (3, 0, 0, 0), "t2/exact": (3, 2, 0, 0), "t2/none": (3, 0, 0, 0)}


def test_predictions_as_files_name_infeasible_shots(spark, tmp_path):
    """Shot 2 alone is postselected away; shot 3 hits a detector without errors, so that nothing explains it."""
    from parityspark.plans import jobs

    lines = ["error(0.1) D0 L0", "error(0.01) D1 L1", "error(0.05) D0 D1", "detector(0, 0, 0, 0) D0", "detector(0, 0, 1, 0) D1", "detector(0, 0, 0, 1) D2", "detector(0, 0, 0, 0) D3"]
    model = spark.createDataFrame([(0, i, x) for i, x in enumerate(lines)], "model_id int, seq bigint, line string")
    shots = spark.createDataFrame([(i,) for i in range(5)], "shot_id bigint")
    hits = spark.createDataFrame([(0, "D", 0), (1, "D", 1), (2, "D", 2), (3, "D", 3), (4, "L", 1)], "shot_id bigint, kind string, idx int")
    layout = sh.Layout(0, 4, 2)
    src, out, kept = (str(tmp_path / n) for n in ("src", "out", "kept"))
    sh.write_shots(shots, hits, src, "b8", layout)
    made = jobs.predict_to_files(spark, src, "b8", layout, model, out, "01", kept, "01", shots, postselect_coord=3)
    # Records of shots 0, 1, 3 and 4: D1 alone is likelier by its own error (0.01) than by two others (0.05 times 0.1).
    assert [r.value for r in spark.read.text(out).collect()] == ["10", "01", "00", "00"]
    assert [r.value for r in spark.read.text(kept).collect()] == ["100000", "010000", "000100", "000001"]
    assert rows(made["infeasible"], "shot_id") == [(3, 2)] and rows(made["discards"], "shot_id") == [(2,)]


def test_items_in_words_agree_with_counting_them(spark):
    rng = random.Random(5)
    data = [(rng.randrange(4), rng.choice("ab"), rng.choice([None, -(2**31), 2**31 - 1, -33, -32, -1, 0, 31, 32, 63, 64, 1000])) for _ in range(400)]
    hits = spark.createDataFrame(data, "shot_id bigint, kind string, idx int")
    keys = ["shot_id", "kind"]
    for of in ("int", "bigint", "string", "double"):
        typed = hits.withColumn("idx", F.col("idx").cast(of))
        got = pa.xor_items(typed, keys, "idx")
        assert got.schema == typed.schema
        show = lambda df: sorted(map(tuple, df.collect()), key=repr)
        assert show(got) == show(pa.xor_reduce(typed, [*keys, "idx"])) != []
    text = hits.select(*keys, F.col("idx").cast("string").alias("idx"))
    a, b = (hits.filter(F.abs(F.hash("shot_id", "kind", "idx")) % 5 != n) for n in (0, 1))
    as_text = lambda df: df.join(text, ["shot_id", "kind"], "left_semi").select("shot_id", F.col("idx").cast("string").alias("idx"))
    want = sorted(map(tuple, pa.is_subset(as_text(a), as_text(b), "shot_id", "idx").collect()))
    assert sorted(map(tuple, pa.is_subset(a, b, "shot_id", "idx").collect())) == want


def test_parity_of_shots_holds_words_and_not_hits(spark):
    """The tables that tasks hold have one row a word, so they do not grow with the hits of a shot."""
    hits = spark.range(1000).select((F.col("id") % 10).alias("shot_id"), (F.col("id") % 24).cast("int").alias("det"))
    effect = spark.range(96).select((F.col("id") % 24).cast("int").alias("det"), (F.col("id") % 32).cast("int").alias("sweep"))
    sweep = hits.select("shot_id", F.col("det").alias("sweep"))
    targets = effect.select(F.col("sweep").alias("err_id"), F.lit("D").alias("kind"), F.col("det").alias("idx"))
    jobs = [
        ev.apply_sweep(hits, sweep, effect), ev.replay_errors(sweep.withColumnRenamed("sweep", "err_id"), targets),
        wn.round_differences(hits.withColumns({"check": F.lit(0), "round_id": F.col("det")}), 24), pa.is_subset(hits, hits, "shot_id", "det"),
        gr.toggle_base_hits(hits.select("shot_id").distinct(), hits, effect.select("det").distinct()),
    ]
    for job in jobs:
        plan = job._jdf.queryExecution().executedPlan().toString()
        assert any("_word" in keys for keys in re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", plan))


@pytest.mark.parametrize("fmt", ["b8", "ptb64", "r8"])
def test_packed_reader_hands_over_small_pieces(tmp_path, fmt):
    """Dense records of 2 MB: no batch of rows grows with the range."""
    from parityspark.sources import shot_source

    shape = shot_source.Shape(fmt, 0, 64, 0)
    data = np.zeros(1 << 21, np.uint8) if fmt == "r8" else np.full(1 << 21, 255, np.uint8)
    (tmp_path / f"a.{fmt}").write_bytes(data.tobytes())
    reader = shot_source.ShotReader(f"file://{tmp_path}", shape, "chunks" if fmt == "b8" else "hits", {"piece_bytes": "2000", "index": "none"})
    sizes = [(b.num_rows, b.nbytes) for b in reader.read(shot_source.Ranges([shot_source.Range(str(tmp_path / f"a.{fmt}"), 0, len(data))]))]
    assert max(size for _, size in sizes) < 32 << 20
    if fmt == "b8":
        pieces = [r for b in reader.read(shot_source.Ranges([shot_source.Range(str(tmp_path / "a.b8"), 0, len(data))])) for r in b.to_pylist()]
        assert max(len(p["content"]) for p in pieces) == 2000 and sum(len(p["content"]) for p in pieces) == len(data)
        assert [p["first_shot"] for p in pieces] == np.cumsum([0] + [len(p["content"]) // 8 for p in pieces])[:-1].tolist()
    elif fmt == "ptb64":
        assert sum(n for n, _ in sizes) == 8 * len(data)
    else:
        assert sum(n for n, _ in sizes) == len(data) // 65 * 64 + len(data) % 65
