"""Decoding as batch table jobs: distinct syndromes are solved once and joined back to their shots."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from ..lineage import cut, drop
from .graph import connected_components, matching_paths, path_edges
from .matching import _TABLE_CELLS, DENSE_HITS, by_size, matrix, solutions, unfold
from .parity import xor_reduce

# Nodes of a syndrome's own graph up to which its paths are one row; a row then holds at most about a thousand costs.
WIDEST_GRAPH = 32


def shot_syndromes(hits: DataFrame) -> DataFrame:
    """Sorted hit list of every shot that has hits; a list holds each detector of the model at most once."""
    return hits.groupBy("shot_id").agg(F.array_sort(F.collect_list("det")).alias("key"))


def distinct_syndromes(per_shot: DataFrame) -> DataFrame:
    """Each syndrome once, with how many shots show it (DEC1)."""
    return per_shot.groupBy("key").agg(F.count("*").alias("n"))


def carries_observables(decoder):
    """Let a decoder of BIGINT observables serve paths whose observables are arrays of words.

    Matching does not depend on observables, and those of a solution are the XOR over its pairs' paths. So the pairs are found first and
    then meet their paths once, one row a pair of each distinct syndrome.
    """

    @wraps(decoder)
    def run(syndromes: DataFrame, dist: DataFrame, boundary: int = -1) -> DataFrame:
        m = bits.Masks.of(dist, "obs")
        if not m.words:
            return decoder(syndromes, dist, boundary)
        plain = dist.withColumn("obs", F.lit(0).cast("bigint"))
        solved = cut(decoder(syndromes, plain, boundary), "solved")
        ends = matched_pairs(solved).select("key", F.col("a").alias("src"), F.coalesce("b", F.lit(boundary)).alias("node"))
        total = m.xor_over(ends.join(dist.select("src", "node", F.col("obs").alias("total")), ["src", "node"]), ["key"], "total")
        return solved.drop("obs").join(total, "key", "left").select(
            "key", "w", F.when(F.col("w").isNotNull(), F.coalesce("total", m.zero())).alias("obs"), "pairs", "reason"
        )

    return run


def _asked(syndromes: DataFrame, boundary: int) -> DataFrame:
    """Rows (key, ..., pos, src, node): the costs that the matching of each syndrome expects, boundary first, then pairs."""
    k = F.size("key")
    last = k - 1
    ends = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("pos"), F.get("key", i).alias("src"), F.lit(boundary).alias("node")))
    empty = F.array().cast("array<struct<pos:int,src:int,node:int>>")
    pairs = F.flatten(F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.when(i < last, F.transform(
            F.sequence(i + 1, F.greatest(last, i + 1)),
            lambda j: F.struct((k + i * k - F.floor(i * (i + 1) / 2).cast("int") + j - i - 1).alias("pos"), F.get("key", i).alias("src"), F.get("key", j).alias("node")),
        )).otherwise(empty),
    ))
    return syndromes.withColumn("_c", F.explode(F.concat(ends, pairs))).select(*syndromes.columns, "_c.*")


def _listed(costs: DataFrame) -> DataFrame:
    """(key, d, o): cost lists of each syndrome in order of ``pos``."""
    listed = costs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "dist", "obs"))).alias("_l"))
    return listed.select(
        "key", F.transform("_l", lambda c: c["dist"]).alias("d"), F.transform("_l", lambda c: F.coalesce(c["obs"], F.lit(0).cast("bigint"))).alias("o")
    )


def _hit_costs(syndromes: DataFrame, dist: DataFrame, boundary: int) -> DataFrame:
    asked = _asked(syndromes.select("key"), boundary)
    return _listed(asked.join(dist.select("src", "node", F.col("dist").cast("double").alias("dist"), "obs"), ["src", "node"], "left"))


_SOLVED = "key array<int>, w double, obs bigint, a array<int>, b array<int>"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, rows in by_size(batch, "key"):
            rim, pair = unfold(matrix(batch, "d", rows, np.float64), k)
            rim_obs, pair_obs = unfold(matrix(batch, "o", rows, np.int64), k)
            yield solutions(batch, "key", rows, matrix(batch, "key", rows, np.int64), rim, pair, rim_obs, pair_obs)


def _by_rounds(costs: DataFrame) -> DataFrame:
    """Exact matching as rounds over (row, open hits): each round settles one hit in every set of open hits that has it.

    Sets are rows, so those of one cluster spread over tasks and disk. A set keeps its lightest way, on ties the one that prefers the
    boundary, then the earliest partner, for the lowest hit first; a pair that costs no less than both exits is no option.
    """
    costs = cut(costs.withColumn("cid", F.monotonically_increasing_id()), "dense-costs")
    k = F.size("key")
    at = lambda i, j: (k + i * k - F.floor(i * (i + 1) / 2) + j - i - 1).cast("int")
    option = lambda i, j, pos: F.struct(i.cast("int").alias("lo"), j.cast("int").alias("hi"), F.get("d", pos).alias("cost"), F.get("o", pos).alias("obs"))
    every = F.sequence(F.lit(0), k - 1)
    pairs = F.flatten(F.transform(every, lambda i: F.transform(F.filter(every, lambda j: j > i), lambda j: option(i, j, at(i, j)))))
    ends = F.transform(every, lambda i: option(i, F.lit(-1), i))
    asked = costs.select("cid", "d", F.explode(F.concat(ends, pairs)).alias("c")).select("cid", "c.*", F.get("d", F.col("c.lo")).alias("ra"), F.when(F.col("c.hi") >= 0, F.get("d", F.greatest(F.col("c.hi"), F.lit(0)))).alias("rb"))
    options = cut(asked.filter("cost IS NOT NULL AND (hi < 0 OR ra IS NULL OR rb IS NULL OR cost < ra + rb)").drop("ra", "rb"), "dense-options")
    nothing = F.array().cast("array<struct<lo:int,hi:int,obs:bigint>>")
    state = cut(costs.select("cid", every.alias("open"), F.lit(0.0).alias("w"), nothing.alias("pairs")), "dense-round")
    for low in range(costs.agg(F.max(k)).first()[0] or 0):
        mine = F.coalesce(F.get("open", F.lit(0)) == low, F.lit(False))
        moved = state.filter(mine).join(options.filter(F.col("lo") == low), "cid").filter("hi < 0 OR array_contains(open, hi)")
        moved = moved.select("cid", F.array_except("open", F.array("lo", "hi")).alias("open"), (F.col("w") + F.col("cost")).alias("w"), F.concat("pairs", F.array(F.struct("lo", "hi", "obs"))).alias("pairs"))
        best = moved.unionByName(state.filter(~mine)).groupBy("cid", "open").agg(F.min(F.struct("w", "pairs")).alias("best"))
        after = cut(best.select("cid", "open", "best.*"), "dense-round")
        drop(state)
        state = after
    found = costs.select("cid", "key").join(state.filter("size(open) = 0").drop("open"), "cid", "left")
    return found.select(
        "key", "w", F.aggregate("pairs", F.lit(0).cast("bigint"), lambda x, p: x.bitwiseXOR(p["obs"])).alias("obs"),
        F.transform("pairs", lambda p: F.get("key", p["lo"])).alias("a"),
        F.transform("pairs", lambda p: F.when(p["hi"] >= 0, F.get("key", F.greatest(p["hi"], F.lit(0)))).otherwise(-1)).alias("b"),
    )


@carries_observables
def decode_exact(syndromes: DataFrame, dist: DataFrame, boundary: int = -1) -> DataFrame:
    """Exact minimum-weight matching of whole syndromes (DEC2): few hits inside a task, more by rounds of Spark joins.

    Returns key, w, obs, the matched pairs and a reason; infeasible syndromes have NULL w.
    """
    few = _exact(_hit_costs(syndromes.filter(F.size("key").between(1, DENSE_HITS)), dist, boundary).mapInArrow(_solve, _SOLVED))
    many = cut(syndromes.filter(F.size("key") > DENSE_HITS).select("key"), "dense")
    return few if many.isEmpty() else few.unionByName(_exact(_by_rounds(_hit_costs(many, dist, boundary))))


def _exact(solved: DataFrame) -> DataFrame:
    return solved.select(
        "key", "w", "obs", F.when(F.col("w").isNotNull(), _pairs(F.col("a"), F.col("b"))).alias("pairs"), F.when(F.col("w").isNull(), "infeasible").otherwise("exact").alias("reason")
    )


def _pairs(a: Column, b: Column) -> Column:
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: F.struct(p["a"].alias("a"), F.when(p["b"] >= 0, p["b"]).alias("b")))


def _local_options(nodes: DataFrame, dist: DataFrame, boundary: int) -> tuple[DataFrame, DataFrame]:
    """Partners and boundary exits worth considering for the hits nodes(sid, det).

    A pair that costs at least as much as sending both ends to the boundary can be replaced by these two
    exits without loss, so it is never a candidate.
    """
    near = dist.select("src", "node", F.col("dist").cast("double").alias("dist"), "obs")
    rim = near.filter(F.col("node") == boundary).select(F.col("src").alias("det"), F.col("dist").alias("rim"), F.col("obs").alias("rim_obs"))
    local = nodes.join(rim, "det", "left")
    pairs = (
        local.select("sid", F.col("det").alias("src"), F.col("rim").alias("_ra"))
        .join(near.filter((F.col("node") != boundary) & (F.col("src") < F.col("node"))), "src")
        .join(local.select("sid", F.col("det").alias("node"), F.col("rim").alias("_rb")), ["sid", "node"])
        .filter(F.col("_ra").isNull() | F.col("_rb").isNull() | (F.col("dist") < F.col("_ra") + F.col("_rb")))
        .select("sid", F.col("src").alias("lo"), F.col("node").alias("hi"), "dist", "obs")
    )
    ends = local.filter("rim IS NOT NULL").select("sid", F.lit(boundary).alias("lo"), F.col("det").alias("hi"), F.col("rim").alias("dist"), F.col("rim_obs").alias("obs"))
    return pairs, ends


@carries_observables
def decode_greedy(syndromes: DataFrame, dist: DataFrame, boundary: int = -1) -> DataFrame:
    """Approximate matching of syndromes of any size: rounds of mutually nearest partners (DEC3).

    All options are compared in one total order, so each round settles at least the cheapest option of
    every open syndrome.
    """
    ids = cut(syndromes.select("key").withColumn("sid", F.monotonically_increasing_id()), "greedy-ids")
    pairs, ends = _local_options(ids.select("sid", F.explode("key").alias("det")), dist, boundary)
    options = cut(pairs.unionByName(ends), "greedy-options")
    matched = None
    while not options.isEmpty():
        offer = F.struct("dist", "lo", "hi", "obs")
        sides = options.select("sid", F.explode(F.array("lo", "hi")).alias("det"), offer.alias("o")).filter(F.col("det") != boundary)
        best = sides.groupBy("sid", "det").agg(F.min("o").alias("o"))
        agreed = best.groupBy("sid", "o").agg(F.count("*").alias("n")).filter((F.col("n") == 2) | (F.col("o.lo") == boundary)).select("sid", "o.*")
        agreed = cut(agreed, "greedy-round")
        matched = agreed if matched is None else matched.unionByName(agreed)
        gone = agreed.select("sid", F.explode(F.array("lo", "hi")).alias("det"))
        mark = lambda c: gone.withColumnRenamed("det", c)
        options = cut(options.join(mark("lo").filter(F.col("lo") != boundary), ["sid", "lo"], "left_anti").join(mark("hi"), ["sid", "hi"], "left_anti").select("sid", "lo", "hi", "dist", "obs"), "greedy-options")
    if matched is None:
        matched = options
    found = matched.groupBy("sid").agg(
        F.sum("dist").alias("w"), F.bit_xor("obs").alias("obs"), F.sum(F.when(F.col("lo") == boundary, 1).otherwise(2)).alias("_n"),
        F.array_sort(F.collect_list(F.struct(F.when(F.col("lo") == boundary, F.col("hi")).otherwise(F.col("lo")).alias("a"), F.when(F.col("lo") != boundary, F.col("hi")).alias("b")))).alias("pairs"),
    )
    full = F.col("_n") == F.size("key")
    return ids.join(found, "sid", "left").select(
        "key", F.when(full, F.col("w")).alias("w"), F.when(full, F.col("obs")).alias("obs"), F.when(full, F.col("pairs")).alias("pairs"),
        F.when(full, "greedy").otherwise("infeasible").alias("reason"),
    )


@carries_observables
def decode_by_clusters(syndromes: DataFrame, dist: DataFrame, boundary: int = -1) -> DataFrame:
    """Exact matching of syndromes of any size by independent clusters.

    Hits linked by candidate pairs form clusters that a best matching never crosses, so each cluster is
    solved on its own and every distinct cluster once; a syndrome's answer is the sum of its clusters'.
    """
    ids = cut(syndromes.filter(F.size("key") > 0).select("key").withColumn("sid", F.monotonically_increasing_id()), "cluster-ids")
    nodes = ids.select("sid", F.explode("key").alias("det"))
    pairs, _ = _local_options(nodes, dist, boundary)
    labels = connected_components(
        nodes.select(F.col("sid").alias("grp"), F.col("det").alias("node")), pairs.select(F.col("sid").alias("grp"), F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    parts = cut(labels.groupBy("grp", "label").agg(F.array_sort(F.collect_list("node")).alias("part")).select(F.col("grp").alias("sid"), "part"), "clusters")
    each = cut(parts.select(F.col("part").alias("key")).distinct(), "distinct-clusters")
    joined = parts.join(decode_exact(each, dist, boundary).withColumnRenamed("key", "part"), "part")
    whole = joined.groupBy("sid").agg(
        F.bool_and(F.col("w").isNotNull()).alias("_ok"), F.sum("w").alias("w"), F.bit_xor("obs").alias("obs"), F.array_sort(F.flatten(F.collect_list("pairs"))).alias("pairs"),
    )
    ok = F.col("_ok")
    return ids.join(whole, "sid").select(
        "key", F.when(ok, F.col("w")).alias("w"), F.when(ok, F.col("obs")).alias("obs"), F.when(ok, F.col("pairs")).alias("pairs"),
        F.when(ok, "exact").otherwise("infeasible").alias("reason"),
    )


@carries_observables
def decode(syndromes: DataFrame, dist: DataFrame, boundary: int = -1) -> DataFrame:
    """Exact matching of every syndrome: few hits in one table, many by clusters. Both give the same answer."""
    small = _exact(_hit_costs(syndromes.filter(F.size("key").between(1, DENSE_HITS)), dist, boundary).mapInArrow(_solve, _SOLVED))
    large = cut(syndromes.filter(F.size("key") > DENSE_HITS).select("key"), "large")
    return small if large.isEmpty() else small.unionByName(decode_by_clusters(large, dist, boundary))


def matched_pairs(decoded: DataFrame) -> DataFrame:
    """Matched pairs of each solution, a NULL ``b`` being the boundary (DEC4)."""
    return decoded.select("key", F.explode("pairs").alias("_p")).select("key", "_p.*")


def mates(decoded: DataFrame) -> DataFrame:
    """The partner of every hit, -1 for the boundary (DEC4)."""
    p = matched_pairs(decoded)
    return p.select("key", F.col("a").alias("det"), F.coalesce("b", F.lit(-1)).alias("mate")).unionByName(
        p.filter("b IS NOT NULL").select("key", F.col("b").alias("det"), F.col("a").alias("mate"))
    )


def solution_edges(pairs: DataFrame, paths: DataFrame, boundary: int = -1) -> DataFrame:
    """Edges on the paths of the matched pairs; an edge used twice cancels (DEC5)."""
    ends = pairs.select("key", F.col("a").alias("src"), F.coalesce("b", F.lit(boundary)).alias("node"))
    steps = path_edges(paths, ends)
    return xor_reduce(ends.join(steps, ["src", "node"]), ["key", "u", "v"])


def predictions(shots: DataFrame, per_shot: DataFrame, decoded: DataFrame) -> DataFrame:
    """Predicted observables and weight of every shot, those without hits included (DEC6)."""
    zero = bits.Masks.of(decoded, "obs").zero()
    answer = per_shot.join(decoded.select("key", "w", "obs", "reason"), "key").select("shot_id", "w", "obs", "reason")
    return shots.select("shot_id").join(answer, "shot_id", "left").select(
        "shot_id",
        F.when(F.col("reason").isNull(), zero).otherwise(F.col("obs")).alias("pred_mask"),
        F.when(F.col("reason").isNull(), F.lit(0.0)).otherwise(F.col("w")).alias("w"),
        F.coalesce("reason", F.lit("empty")).alias("reason"),
    )


def decode_shots(shots: DataFrame, hits: DataFrame, dist: DataFrame, boundary: int = -1) -> DataFrame:
    """Hits to predictions in one call."""
    per_shot = cut(shot_syndromes(hits), "syndromes")
    return predictions(shots, per_shot, decode(distinct_syndromes(per_shot), dist, boundary))


def decode_vacuous(shots: DataFrame) -> DataFrame:
    """Predict no flip in any shot (DEC10)."""
    return shots.select("shot_id", F.lit(0).alias("pred_mask"))


def window_paths(edges: DataFrame, det_rounds: DataFrame, n_nodes: int, starts: list[int], window: int) -> DataFrame:
    """Shortest paths inside every window, all windows at once; nodes are numbered window * n_nodes + node.

    Edges with a NULL end go to the boundary, numbered -1 in every window.
    """
    rounds = det_rounds.select("det", "round_id")
    placed = edges.join(rounds.select(F.col("det").alias("u"), F.col("round_id").alias("_ru")), "u").join(
        rounds.select(F.col("det").alias("v"), F.col("round_id").alias("_rv")), "v", "left"
    )
    slots = F.array(*[F.struct(F.lit(i).alias("win"), F.lit(s).alias("lo"), F.lit(s + window).alias("hi")) for i, s in enumerate(starts)])
    inside = lambda r: (F.col(r) >= F.col("_s.lo")) & (F.col(r) < F.col("_s.hi"))
    each = placed.filter("v IS NULL OR _rv IS NOT NULL").withColumn("_s", F.explode(slots)).filter(inside("_ru") & (F.col("v").isNull() | inside("_rv")))
    off = F.col("_s.win") * n_nodes
    copies = each.select((off + F.col("u")).alias("u"), F.when(F.col("v").isNull(), F.lit(-1)).otherwise(off + F.col("v")).alias("v"), "w", "obs_mask")
    return matching_paths(copies, -1)


def decode_windowed(
    shots: DataFrame, hits: DataFrame, edges: DataFrame, det_rounds: DataFrame, n_nodes: int, n_rounds: int, commit: int, window: int,
    no_boundary_commit: bool = False, exempt: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Sliding-window decoding: decode a window, commit the edges touching its first ``commit`` rounds, XOR them
    back into the hits, advance (DEC7).

    Boundary edges of the detectors in ``exempt(det)``, or all with ``no_boundary_commit``, are never committed. The loop runs over windows, of
    which there are few; every step treats all shots. Hits are laid out once, one row for the hits that a window adds to a shot; a row is read when its window
    comes, and what is still open after the commit is handed on as the shot's row. So hits are never grouped again, and what a solution toggles is found once
    a syndrome. Returns the predicted observables per shot and the hits left over.
    """
    starts = list(range(0, n_rounds, commit))
    paths = window_paths(edges, det_rounds, n_nodes, starts, window)
    rounds = cut(det_rounds.select("det", "round_id"), "det-rounds")
    # Of parallel edges a shortest path takes the lightest, on ties the one with the smaller observables.
    weights = edges.select("u", F.coalesce("v", F.lit(-1)).alias("v"), "w", F.col("obs_mask").cast("bigint").alias("obs_mask")).groupBy(
        F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).agg(F.min_by("obs_mask", F.struct("w", "obs_mask")).alias("obs_mask"))
    weights = cut(weights, "window-edges")
    # A hit is one number, its round above its detector, which arrays compare and hash as they are.
    item = lambda det, r: F.shiftleft(F.col(r).cast("bigint"), 32) + F.col(det)
    det_of = lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    nothing = F.array().cast("array<bigint>")
    r = F.col("round_id")
    first = F.greatest(F.lit(0), F.ceil((r - window + 1) / commit)).cast("int")
    win = F.when((first <= F.floor(r / commit)) & (first < len(starts)), first).otherwise(-1)
    placed = hits.select("shot_id", "det").join(rounds, "det").select("shot_id", win.alias("win"), item("det", "round_id").alias("item"))
    # Dealt to their rows first: repeats cancel there, and no second shuffle gathers them.
    once = xor_reduce(placed.repartition("shot_id", "win"), ["shot_id", "win", "item"])
    laid = cut(once.groupBy("shot_id", "win").agg(F.collect_list("item").alias("hits")).sortWithinPartitions("win"), "hits-by-window")
    flips, left = [], [laid.filter("win < 0").select("shot_id", "hits")]
    carry = None
    for i, start in enumerate(starts):
        open_from = (start + commit) << 32
        off = i * n_nodes
        here = laid.filter(F.col("win") == i).select("shot_id", "hits")
        if carry is not None:
            here = here.unionByName(carry).groupBy("shot_id").agg(F.flatten(F.collect_list("hits")).alias("hits"))
        key = F.when(F.array_min("hits") < open_from, F.array_sort(F.transform("hits", lambda x: det_of(x) + off)))
        here = cut(here.select("shot_id", "hits", key.alias("key")), "window-hits")
        active, idle = here.filter("key IS NOT NULL"), here.filter("key IS NULL")
        keys = cut(distinct_syndromes(active), "window-syndromes")
        own = paths.filter((F.col("src") >= off) & (F.col("src") < off + n_nodes))
        solved = cut(decode(keys, own, -1), "window-solved")
        steps = solution_edges(matched_pairs(solved), own).select(
            "key", F.when(F.col("u") < 0, -1).otherwise(F.col("u") - off).alias("lo"), F.when(F.col("v") < 0, -1).otherwise(F.col("v") - off).alias("hi")
        )
        ends = steps.join(rounds.select(F.col("det").alias("lo"), F.col("round_id").alias("_r1")), "lo", "left").join(
            rounds.select(F.col("det").alias("hi"), F.col("round_id").alias("_r2")), "hi", "left"
        )
        ends = ends.filter(F.coalesce(F.col("_r1") < start + commit, F.lit(False)) | F.coalesce(F.col("_r2") < start + commit, F.lit(False)))
        if no_boundary_commit:
            ends = ends.filter("lo >= 0")
        elif exempt is not None:
            # The boundary is the lower end of its edges.
            ends = ends.join(exempt.select(F.col("det").alias("hi"), F.lit(-1).alias("lo")).distinct(), ["lo", "hi"], "left_anti")
        done = ends.join(weights, ["lo", "hi"], "left")
        # The observables of an edge go with one of its ends; the boundary is no hit.
        side = lambda det, at, obs: F.struct(F.when(F.col(det) >= 0, item(det, at)).alias("item"), obs.alias("obs"))
        zero = F.lit(0).cast("bigint")
        sides = done.select("key", F.explode(F.array(side("lo", "_r1", zero), side("hi", "_r2", F.coalesce("obs_mask", zero)))).alias("e"))
        each = sides.groupBy("key", "e.item").agg(F.bit_xor("e.obs").alias("obs"), F.count("*").alias("_n"))
        effects = each.groupBy("key").agg(F.bit_xor("obs").alias("obs"), F.collect_list(F.when(F.col("_n") % 2 == 1, F.col("item"))).alias("toggles"))
        t = F.coalesce("toggles", nothing)
        moved = active.join(effects, "key", "left").select(
            "shot_id", F.concat(F.array_except("hits", t), F.array_except(t, F.col("hits"))).alias("hits"), F.coalesce("obs", zero).alias("obs")
        )
        after = cut(moved.unionByName(idle.select("shot_id", "hits", zero.alias("obs"))), "window-after")
        flips.append(after.filter("obs <> 0").select("shot_id", "obs"))
        left.append(after.select("shot_id", F.filter("hits", lambda x: x < open_from).alias("hits")))
        carry = after.select("shot_id", F.filter("hits", lambda x: x >= open_from).alias("hits")).filter("size(hits) > 0")
        drop(here, keys, solved)
    every = lambda parts: reduce(DataFrame.unionByName, parts)
    shown = shots.select("shot_id")
    if carry is None:
        pred = shown.withColumn("pred_mask", F.lit(0).cast("bigint"))
    else:
        left.append(carry)
        total = every(flips).groupBy("shot_id").agg(F.bit_xor("obs").alias("_o"))
        pred = shown.join(total, "shot_id", "left").select("shot_id", F.coalesce("_o", F.lit(0).cast("bigint")).alias("pred_mask"))
    kind = hits.schema["det"].dataType
    return {"predictions": pred, "left": every(left).select("shot_id", F.explode("hits").alias("_x")).select("shot_id", det_of(F.col("_x")).cast(kind).alias("det"))}


def decode_two_level(
    shots: DataFrame, routed: DataFrame, inner_edges: DataFrame, inner_rounds: DataFrame, inner_nodes: int, n_rounds: int, commit: int, window: int,
    outer_dist: DataFrame, boundary: int = -1, exempt: DataFrame | None = None,
) -> DataFrame:
    """Inner windowed pass without boundary commits, unexplained hits to the outer pass, XOR of both (DEC8).

    ``routed(shot_id, stream, idx, outer_idx)`` carries each hit's number in its stream and in the outer code. With ``exempt(det)`` only the
    boundary edges of these inner detectors stay uncommitted.
    """
    inner_hits = xor_reduce(routed.filter("stream = 'inner'").select("shot_id", F.col("idx").alias("det")), ["shot_id", "det"])
    inner = decode_windowed(shots, inner_hits, inner_edges, inner_rounds, inner_nodes, n_rounds, commit, window, exempt is None, exempt)
    # Only hits that were recorded can move on; bits created by a partial commit stay in the inner code.
    left = inner["left"].withColumnRenamed("det", "idx")
    moved = routed.filter("stream = 'inner'").join(left, ["shot_id", "idx"], "left_semi").select("shot_id", F.col("outer_idx").alias("det"))
    direct = routed.filter("stream = 'outer'").select("shot_id", F.col("idx").alias("det"))
    outer_hits = cut(xor_reduce(direct.unionByName(moved), ["shot_id", "det"]), "outer-hits")
    outer = decode_shots(shots, outer_hits, outer_dist, boundary)
    return inner["predictions"].withColumnRenamed("pred_mask", "inner_mask").join(
        outer.select("shot_id", F.col("pred_mask").alias("outer_mask")), "shot_id"
    ).select("shot_id", F.col("inner_mask").bitwiseXOR(F.coalesce("outer_mask", F.lit(0).cast("bigint"))).alias("pred_mask"))


def overridden_paths(named: DataFrame, low: DataFrame, paths: DataFrame, boundary: int) -> DataFrame:
    """(kid, src, node, dist, obs): shortest paths from each syndrome's hits to its hits and the boundary when some edges get cheaper.

    ``named(kid, key)`` and ``low(kid, lo, hi, low_w, obs)`` describe one graph a syndrome, all kept in one table. Only paths through a cheaper edge can
    improve, so each round extends the labels improved in the last one by a cheaper edge and from its end by the unchanged path table, until none
    improves. Of equal lengths the smaller observables stay.
    """
    moves = low.select("kid", F.col("lo").alias("u"), F.col("hi").alias("v"), "low_w", F.col("obs").alias("move_obs"))
    moves = moves.unionByName(moves.select("kid", F.col("v").alias("u"), F.col("u").alias("v"), "low_w", "move_obs"))
    moves = cut(moves.filter(F.col("u") != boundary), "moves")
    hits = named.select("kid", F.explode("key").alias("src"))
    targets = hits.withColumnRenamed("src", "node").unionByName(moves.select("kid", F.col("u").alias("node"))).unionByName(moves.select("kid", F.col("v").alias("node")))
    targets = cut(targets.unionByName(named.select("kid", F.lit(boundary).alias("node"))).distinct(), "targets")
    known = paths.select("src", "node", F.col("dist").cast("double").alias("dist"), F.col("obs").cast("bigint").alias("obs"))
    inside = lambda df: df.join(targets, ["kid", "node"], "left_semi")
    # From the end of a cheaper edge onwards; the boundary leads nowhere else.
    onwards = known.select(F.col("src").alias("v"), "node", F.col("dist").alias("rest"), F.col("obs").alias("rest_obs"))
    hop = inside(moves.select("kid", "v").distinct().join(onwards, "v"))
    stop = named.select("kid", F.lit(boundary).alias("v"), F.lit(boundary).alias("node"), F.lit(0.0).alias("rest"), F.lit(0).cast("bigint").alias("rest_obs"))
    hop = cut(hop.select("kid", "v", "node", "rest", "rest_obs").unionByName(stop), "hops")
    labels = cut(inside(hits.join(known, "src")).select("kid", "src", "node", "dist", "obs", F.lit(1).alias("fresh")), "labels")
    while True:
        step = labels.filter("fresh = 1").join(moves, (labels["kid"] == moves["kid"]) & (labels["node"] == moves["u"])).select(
            labels["kid"], "src", "v", (F.col("dist") + F.col("low_w")).alias("dist"), F.col("obs").bitwiseXOR(F.col("move_obs")).alias("obs")
        ).groupBy("kid", "src", "v").agg(F.min(F.struct("dist", "obs")).alias("s"))
        found = step.join(hop, ["kid", "v"]).select(
            "kid", "src", "node", (F.col("s.dist") + F.col("rest")).alias("dist"), F.col("s.obs").bitwiseXOR(F.col("rest_obs")).alias("obs"), F.lit(1).alias("fresh")
        )
        best = labels.withColumn("fresh", F.lit(0)).unionByName(found).groupBy("kid", "src", "node").agg(F.min(F.struct("dist", "obs", "fresh")).alias("l"))
        before, labels = labels, cut(best.select("kid", "src", "node", "l.*"), "labels")
        drop(before)
        if labels.filter("fresh = 1").isEmpty():
            return labels.drop("fresh")


def _relaxed(base: np.ndarray, base_obs: np.ndarray, k: int, moves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Costs from each row's first ``k`` nodes to its nodes and, last, the boundary when ``moves`` (row, from, to, cost, obs) are added to base (B, t, t + 1).

    The rounds of ``overridden_paths`` for the rows of an Arrow batch, with the same sums in the same order and the same choice between equal lengths.
    """
    b, t, width = base.shape
    better = lambda d, o, than, than_obs: (d < than) | ((d == than) & (o < than_obs) & np.isfinite(d))
    dist, obs = base[:, :k].copy(), base_obs[:, :k].copy()
    fresh = np.isfinite(dist)
    row, u, v, cost, flip = moves
    # The n-th move of a row is taken with the n-th of the others, so that no row is written twice at once.
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    turns = [np.flatnonzero(nth == n) for n in range(int(nth.max(initial=-1)) + 1)]
    used = np.unique(v)
    while fresh.any():
        at, at_obs = np.full((b, k, width), np.inf), np.zeros((b, k, width), np.int64)
        for m in turns:
            r, f, to = row[m], u[m], v[m]
            d = np.where(fresh[r, :, f], dist[r, :, f] + cost[m][:, None], np.inf)
            o = obs[r, :, f] ^ flip[m][:, None]
            now, now_obs = at[r, :, to], at_obs[r, :, to]
            won = better(d, o, now, now_obs)
            at[r, :, to], at_obs[r, :, to] = np.where(won, d, now), np.where(won, o, now_obs)
        fresh = np.zeros_like(fresh)
        for to in used:
            if to == t:
                # The boundary leads nowhere else.
                d, o, part = at[:, :, t:], at_obs[:, :, t:], slice(t, None)
            else:
                d, o, part = at[:, :, to, None] + base[:, None, to], at_obs[:, :, to, None] ^ base_obs[:, None, to], slice(None)
            won = better(d, o, dist[:, :, part], obs[:, :, part])
            dist[:, :, part], obs[:, :, part] = np.where(won, d, dist[:, :, part]), np.where(won, o, obs[:, :, part])
            fresh[:, :, part] |= won
    return dist, obs


def _relax(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits, ends, known = (np.asarray(batch.column(c).value_lengths()) for c in ("key", "nodes", "known"))
        shapes = hits.astype(np.int64) << 32 | ends
        for shape in np.unique(shapes):
            k, t = int(shape >> 32), int(shape & 0xFFFFFFFF)
            every = np.flatnonzero(shapes == shape)
            size = max(1, _TABLE_CELLS // (t * (t + 1)))
            for at in range(0, len(every), size):
                rows = every[at : at + size]
                some = batch.take(pa.array(rows))
                flat = lambda c: some.column(c).flatten()  # noqa: B023, E731
                of = lambda part, name: part.field(name).to_numpy(zero_copy_only=False)
                base, base_obs = np.full((len(rows), t * (t + 1)), np.inf), np.zeros((len(rows), t * (t + 1)), np.int64)
                cells, owner = flat("known"), np.repeat(np.arange(len(rows)), known[rows])
                base[owner, of(cells, "pos")], base_obs[owner, of(cells, "pos")] = of(cells, "dist"), of(cells, "obs")
                steps, mover = flat("moves"), np.repeat(np.arange(len(rows)), np.asarray(some.column("moves").value_lengths()))
                d, o = _relaxed(
                    base.reshape(-1, t, t + 1), base_obs.reshape(-1, t, t + 1), k,
                    [mover, of(steps, "u"), of(steps, "v"), of(steps, "w"), of(steps, "obs")],
                )
                i, j = np.triu_indices(k, 1)
                costs = np.concatenate([d[:, :, t], d[:, i, j]], axis=1)
                flips = np.where(np.isfinite(costs), np.concatenate([o[:, :, t], o[:, i, j]], axis=1), 0)
                offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * costs.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("key"),
                        pa.ListArray.from_arrays(offsets, pa.array(costs.ravel(), mask=~np.isfinite(costs).ravel())),
                        pa.ListArray.from_arrays(offsets, pa.array(flips.ravel())),
                    ],
                    names=["key", "d", "o"],
                )


def _overridden_costs(cheaper: DataFrame, paths: DataFrame, boundary: int, widest: int) -> DataFrame:
    """(key, d, o): the cost lists of syndromes whose graphs get cheaper edges, cheaper(key, lo, hi, low_w, obs).

    A syndrome is one row with its hits, the ends of its edges and the known paths between them, relaxed in batches; those of more than
    ``widest`` nodes go through ``overridden_paths``.
    """
    edge = F.struct("lo", "hi", "low_w", "obs")
    rows = cheaper.groupBy("key").agg(F.collect_list(edge).alias("edges"))
    ends = F.concat(F.transform("edges", lambda e: e["lo"]), F.transform("edges", lambda e: e["hi"]))
    others = F.array_except(ends, F.concat("key", F.array(F.lit(boundary))))
    rows = cut(rows.withColumn("nodes", F.concat("key", others)).withColumn("kid", F.monotonically_increasing_id()), "cheaper-rows")
    few, many = rows.filter(F.size("nodes") <= widest), rows.filter(F.size("nodes") > widest)
    t = F.size("nodes")
    known = paths.select("src", "node", F.col("dist").cast("double").alias("dist"), F.col("obs").cast("bigint").alias("obs"))
    from_ = few.select("kid", "nodes", F.posexplode("nodes").alias("_i", "src"))
    pairs = from_.select("kid", "src", (F.col("_i") * (t + 1)).alias("_row"), F.posexplode(F.concat("nodes", F.array(F.lit(boundary)))).alias("_j", "node"))
    found = pairs.join(known, ["src", "node"]).select("kid", F.struct((F.col("_row") + F.col("_j")).alias("pos"), "dist", "obs").alias("c"))
    listed = found.groupBy("kid").agg(F.collect_list("c").alias("known"))
    place = lambda x: F.when(x == boundary, t).otherwise(F.array_position("nodes", x).cast("int") - 1)
    move = lambda a, b: F.transform("edges", lambda e: F.struct(place(e[a]).alias("u"), place(e[b]).alias("v"), e["low_w"].alias("w"), e["obs"].alias("obs")))
    moves = F.filter(F.concat(move("lo", "hi"), move("hi", "lo")), lambda m: m["u"] != t)
    none = F.array().cast("array<struct<pos:int,dist:double,obs:bigint>>")
    joined = few.select("kid", "key", "nodes", moves.alias("moves")).join(listed, "kid", "left").select("key", "nodes", "moves", F.coalesce("known", none).alias("known"))
    out = joined.mapInArrow(_relax, "key array<int>, d array<double>, o array<bigint>")
    if many.isEmpty():
        return out
    named = many.select("kid", "key")
    low = many.select("kid", F.explode("edges").alias("e")).select("kid", "e.*")
    asked = _asked(named.select("key", "kid"), boundary).join(overridden_paths(named, low, paths, boundary), ["kid", "src", "node"], "left")
    return out.unionByName(_listed(asked))


def decode_correlated(syndromes: DataFrame, paths: DataFrame, edges: DataFrame, implied: DataFrame, boundary: int = -1, widest: int = WIDEST_GRAPH) -> DataFrame:
    """Second pass with the weights implied by the first pass's edges (DEC9).

    ``implied(cu, cv, au, av, w)`` names nodes with ``boundary`` for the boundary. Each syndrome with a cheaper edge gets its own shortest paths, up
    to ``widest`` nodes in batches of rows and beyond that all in one keyed table (``overridden_paths``), and is matched again, few hits inside a task, more by rounds of joins. Syndromes without a
    cheaper edge keep the first pass's answer.
    """
    first = cut(decode(syndromes, paths, boundary), "first-pass")
    used = solution_edges(matched_pairs(first.filter("reason = 'exact'")), paths, boundary)
    order = lambda a, b: (F.least(a, b), F.greatest(a, b))
    c_lo, c_hi = order("cu", "cv")
    a_lo, a_hi = order("au", "av")
    rules = implied.select(c_lo.alias("u"), c_hi.alias("v"), a_lo.alias("lo"), a_hi.alias("hi"), F.col("w").cast("double").alias("low_w"))
    e_lo, e_hi = order("u", "v")
    known = edges.select(e_lo.alias("lo"), e_hi.alias("hi"), F.col("w").cast("double").alias("w"), F.col("obs_mask").cast("bigint").alias("obs"))
    # A cheaper edge can only matter where it beats the edge's own weight.
    low = used.join(rules, ["u", "v"]).groupBy("key", "lo", "hi").agg(F.min("low_w").alias("low_w")).join(known, ["lo", "hi"]).filter("low_w < w")
    low = cut(low.select("key", "lo", "hi", "low_w", "obs"), "cheaper")
    costs = cut(_overridden_costs(low, paths, boundary, widest), "second-costs")
    second = _exact(costs.filter(F.size("key") <= DENSE_HITS).mapInArrow(_solve, _SOLVED))
    many = costs.filter(F.size("key") > DENSE_HITS)
    if not many.isEmpty():
        second = second.unionByName(_exact(_by_rounds(many)))
    told = second.select("key", "w", "obs", F.lit("correlated").alias("reason"))
    rest = first.select("key", "w", "obs", "reason").join(costs.select("key"), "key", "left_anti")
    return rest.unionByName(told)


# ---- decoder plug-ins ---------------------------------------------------------------------------

_DECODERS: dict[str, Callable] = {}


def register_decoder(name: str, compile_model: Callable[[str], Callable[[pa.RecordBatch], tuple]]) -> None:
    """Make a decoder available to ``decode_with`` (UDF1).

    ``compile_model(path)`` runs once per task, reads the model table written at ``path`` and returns a
    function from an Arrow batch (shot_id, key) to (predicted masks, discard flags).
    """
    _DECODERS[name] = compile_model


def decode_with(per_shot: DataFrame, name: str, model: DataFrame) -> DataFrame:
    """Predictions of a registered decoder, with the shots it chose to discard (DEC11)."""
    compile_model = _DECODERS[name]
    written = cut(model, "decoder-model")
    path = written.inputFiles()[0].rsplit("/", 1)[0] if written.inputFiles() else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = compile_model(path)
        for batch in batches:
            masks, discard = decoder(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column("shot_id"), pa.array(masks, pa.int64()), pa.array(discard, pa.bool_())], names=["shot_id", "pred_mask", "discarded"]
            )

    return per_shot.select("shot_id", "key").mapInArrow(run, "shot_id bigint, pred_mask bigint, discarded boolean")
