"""Matching-graph tables: construction, properties, components, shortest paths, undetectable errors.

Iterative operators hand their frontier from round to round through written tables (see ``lineage``), run
one grouped reduction per round and stop at a fixpoint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from ..functions import numeric as num
from ..lineage import cut, drop, new_path
from .events import pair_hits_on_edges
from .model import component_edges, merge_parallel_edges, observable_count
from .parity import packs, words, xor_probability, xor_reduce, xor_words
from .parity_sets import ParitySets


# ---- construction -------------------------------------------------------------------------------


def read_check_matrix(checks: DataFrame, faults: DataFrame, n_obs: int | None = None) -> DataFrame:
    """One row per column of a check/fault matrix pair with its check count; column counts must agree (SRC10).

    ``n_obs`` is the number of rows of the fault matrix, looked up if not given; above 63 the masks are arrays of words.
    """
    n_obs = (faults.agg(F.max("fault")).first()[0] or 0) + 1 if n_obs is None else n_obs
    none = F.array_repeat(F.lit(0).cast("bigint"), bits.words_for(n_obs)) if bits.words_for(n_obs) else F.lit(0)
    h = checks.groupBy("col").agg(F.count("*").alias("n_checks"), F.min("row").alias("u"), F.max("row").alias("_hi"))
    f = faults.groupBy("col").agg(num.mask_pack(F.col("fault"), n_obs).alias("obs_mask"))
    n_h, n_f = (df.agg(F.max("col")).scalar() for df in (checks, faults))
    joined = h.join(f, "col", "full_outer")
    return joined.select(
        F.when((F.col("n_checks").isNull()) & (F.col("col") > n_h), F.raise_error(F.lit("fault matrix has more columns than check matrix")).cast("bigint"))
        .otherwise(F.col("col")).alias("col"),
        F.coalesce("n_checks", F.lit(0)).alias("n_checks"), "u", F.when(F.col("n_checks") >= 2, F.col("_hi")).alias("v"),
        F.coalesce("obs_mask", none).alias("obs_mask"), n_f.alias("last_fault_col"),
    )


def read_edge_list(edges: DataFrame, n_obs: int | None = None) -> DataFrame:
    """Edge attributes with their defaults: weight 1, no probability, no observables (SRC11).

    ``n_obs`` is the number of fault ids, looked up if not given; above 63 the masks are arrays of words.
    """
    has = set(edges.columns)
    pick = lambda c, default: F.coalesce(c, default) if c in has else default
    mask = F.lit(0).cast("bigint")
    if "fault_ids" in has:
        n_obs = (edges.agg(F.max(F.array_max("fault_ids"))).first()[0] or 0) + 1 if n_obs is None else n_obs
        kind = bits.Masks(bits.words_for(n_obs) > 0)
        mask = F.array_repeat(mask, bits.words_for(n_obs)) if kind.words else mask
        mask = F.coalesce(F.aggregate("fault_ids", mask, lambda m, i: kind.xor(m, num.mask_of(i, n_obs))), mask)
    return edges.select(
        "u", "v", pick("weight", F.lit(1.0)).cast("double").alias("w"),
        (F.col("error_probability") if "error_probability" in has else F.lit(None)).cast("double").alias("p"),
        mask.alias("obs_mask"), "seq",
    )


def edges_from_check_matrix(
    columns: DataFrame, weights: DataFrame, n_rows: int, n_cols: int, reps: int = 1, timelike: DataFrame | None = None,
    strategy: str = "smallest-weight", virtual_boundary: bool = False,
) -> DataFrame:
    """Edges from the columns of a check matrix, repeated in time and linked by timelike edges (MDL6).

    ``columns`` comes from read_check_matrix, ``weights(col, w, p)`` gives edge attributes and
    ``timelike(row, w, p)`` those of the links between consecutive copies.
    """
    too_many = F.raise_error(F.concat(F.lit("more than two ones in column "), F.col("col").cast("string"))).cast("bigint")
    base = columns.filter("n_checks > 0").withColumn("n_checks", F.when(F.col("n_checks") > 2, too_many).otherwise(F.col("n_checks")))
    copies = base.filter("n_checks IN (1, 2)").join(weights, "col").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    offset = F.col("rep") * n_rows
    end = F.lit(None).cast("bigint") if virtual_boundary else F.lit(n_rows * reps).cast("bigint")
    edges = copies.select(
        (F.col("u") + offset).cast("bigint").alias("u"), F.when(F.col("n_checks") == 2, (F.col("v") + offset).cast("bigint")).otherwise(end).alias("v"),
        "w", "p", "obs_mask", (F.col("rep").cast("bigint") * n_cols + F.col("col")).alias("seq"),
    )
    if reps > 1:
        if timelike is None:
            raise ValueError("repeated check matrices need timelike edges")
        link = timelike.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 2))))
        low = (F.col("row") + F.col("rep") * n_rows).cast("bigint")
        edges = edges.unionByName(link.select(
            low.alias("u"), (low + n_rows).alias("v"), "w", "p", bits.Masks.of(columns, "obs_mask").zero().alias("obs_mask"),
            (F.lit(reps).cast("bigint") * n_cols + F.col("rep") * n_rows + F.col("row")).alias("seq"),
        ))
    return merge_parallel_edges(edges, strategy)


def boundary_collapse(edges: DataFrame, boundary: DataFrame) -> DataFrame:
    """Turn edges into boundary nodes into boundary edges and keep the lightest per node (MDL7)."""
    mark = lambda c: boundary.select(F.col("node").alias(c), F.lit(True).alias(f"_{c}"))
    flagged = edges.join(mark("u"), "u", "left").join(mark("v"), "v", "left")
    u_out = F.col("_u").isNotNull()
    v_out = F.col("_v").isNotNull() | F.col("v").isNull()
    ends = flagged.filter(~(u_out & v_out)).select(
        F.when(u_out, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(u_out | v_out, F.lit(None)).otherwise(F.col("v")).alias("v"), "w", "p", "obs_mask", "seq"
    )
    outer = merge_parallel_edges(ends.filter("v IS NULL"), "smallest-weight")
    return ends.filter("v IS NOT NULL").select("u", "v", "w", "p", "obs_mask").unionByName(outer.select("u", "v", "w", "p", "obs_mask"))


def normalize_negative_edges(edges: DataFrame) -> dict[str, DataFrame]:
    """Flip the signs of negative edges (MDL8).

    Returns the edges with absolute weights, the nodes every shot must toggle, and the constant weight and
    observables to add to every solution.
    """
    neg = edges.filter("w < 0")
    ends = neg.select(F.explode(F.array("u", "v")).alias("det")).filter("det IS NOT NULL")
    m = bits.Masks.of(edges, "obs_mask")
    if m.words:
        obs = m.xor_over(neg, [], "obs_mask").scalar()
        base = neg.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("base_w")).select("base_w", F.coalesce(obs, m.zero()).alias("base_obs"))
    else:
        base = neg.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("base_w"), F.coalesce(F.bit_xor("obs_mask"), F.lit(0)).alias("base_obs"))
    return {"edges": edges.withColumn("w", F.abs("w")), "base_hits": xor_reduce(ends, ["det"]), "base": base}


def toggle_base_hits(shots: DataFrame, hits: DataFrame, base_hits: DataFrame) -> DataFrame:
    """XOR the toggled nodes into every shot, as rows; ``ParitySets`` counts and masks without them."""
    return ParitySets(shots.select("shot_id"), hits.select("shot_id", "det"), base_hits.select("det")).rows()


def to_graph_tables(edges: DataFrame, boundary_node: int) -> dict[str, DataFrame]:
    """Node and edge tables with the boundary as a node of its own (MDL12)."""
    full = edges.withColumn("v", F.coalesce("v", F.lit(boundary_node)))
    nodes = full.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return {"edges": full, "nodes": nodes.withColumn("is_boundary", F.col("node") == boundary_node)}


def set_boundary(nodes: DataFrame, boundary: DataFrame) -> DataFrame:
    """Replace the boundary set of a node table (MDL21)."""
    new = boundary.select("node", F.lit(True).alias("_b")).distinct()
    return nodes.drop("is_boundary").join(new, "node", "full_outer").select("node", F.coalesce("_b", F.lit(False)).alias("is_boundary"))


def graph_properties(edges: DataFrame, boundary: DataFrame | None = None, min_observables: int = 0) -> DataFrame:
    """Nodes, detectors, edges, fault ids, largest weight, and whether all probabilities are known (AGG17)."""
    top = F.greatest(F.max("u"), F.coalesce(F.max("v"), F.lit(0))) + 1
    if bits.Masks.of(edges, "obs_mask").words:
        faults = F.coalesce(F.max(F.array_max(bits.indices(F.col("obs_mask")))) + 1, F.lit(0))
    else:
        faults = F.when(F.bit_or("obs_mask") == 0, 0).otherwise(F.floor(F.log2(F.bit_or("obs_mask").cast("double"))).cast("int") + 1)
    out = edges.agg(
        top.cast("bigint").alias("nodes"), F.count("*").alias("edges"), F.greatest(faults, F.lit(min_observables)).cast("int").alias("fault_ids"),
        F.max(F.abs("w")).alias("max_abs_weight"), (F.count("p") == F.count("*")).alias("all_have_probability"),
    )
    n_boundary = boundary.agg(F.count_distinct("node")).scalar() if boundary is not None else F.lit(0)
    return out.withColumn("detectors", F.col("nodes") - n_boundary)


def missing_probability_edges(edges: DataFrame) -> DataFrame:
    """Edges that cannot be sampled because their probability is unknown (MDL19)."""
    return edges.filter("p IS NULL")


# ---- correlations -------------------------------------------------------------------------------


def joint_edge_probabilities(errors: DataFrame, targets: DataFrame) -> DataFrame:
    """XOR-probability of each pair of edges named together by a decomposed error, and each edge's own (AGG18).

    Errors with the same components are fused before pairs are formed: the pairs then follow the distinct
    decompositions of the model, however often each is repeated.
    """
    comps = component_edges(errors, targets, 1).filter("n_det IN (1, 2) AND p > 0")
    edge = F.struct("u", F.coalesce("v", F.lit(-1)).alias("v"))
    sets = comps.groupBy("err_id").agg(F.array_sort(F.collect_list(edge)).alias("parts"), F.first("p").alias("p"))
    fused = sets.groupBy("parts").agg(xor_probability(F.col("p")).alias("p"))
    pairs = fused.select("p", F.posexplode("parts").alias("i", "e0"), "parts").select(
        "p", "i", "e0", F.posexplode("parts").alias("j", "e1")
    )
    # A repeated edge meets itself once as its own entry and twice per pair, as in the pairwise definition.
    return pairs.groupBy(*[F.col(f"{e}.{n}").alias(f"{n}{k}") for k, e in ((0, "e0"), (1, "e1")) for n in ("u", "v")]).agg(
        xor_probability(F.col("p")).alias("p")
    )


def implied_weights(joint: DataFrame) -> DataFrame:
    """Weight an edge gets once another edge of a common error is in the solution (MDL9)."""
    own = joint.filter("u0 = u1 AND v0 = v1").select("u0", "v0", F.col("p").alias("own"))
    rest = joint.filter("NOT (u0 = u1 AND v0 = v1)").join(own, ["u0", "v0"]).filter("own > 0")
    q = F.least(F.lit(0.5), F.col("p") / F.col("own"))
    return rest.select(F.col("u0").alias("cu"), F.col("v0").alias("cv"), F.col("u1").alias("au"), F.col("v1").alias("av"), num.weight_from_p(q).alias("w"))


def explain_errors(wanted: DataFrame, locations: DataFrame, single: bool = False) -> DataFrame:
    """Candidate circuit locations of the wanted target sets; optionally only the simplest (JN7, SRT4)."""
    found = locations if not single else simplest_location(locations)
    return wanted.join(found, "targets_key", "left")


def simplest_location(locations: DataFrame) -> DataFrame:
    """Simplest location per target set: most measured terms, then fewest flipped terms, then the first (SRT4)."""
    rank = F.struct((-F.col("n_meas")).alias("a"), "n_pauli", "loc_id")
    row = F.struct("loc_id", "n_pauli", "n_meas", "tick")
    return locations.groupBy("targets_key").agg(F.min_by(row, rank).alias("_r")).select("targets_key", "_r.*")


# ---- components ---------------------------------------------------------------------------------


#: Groups of up to this many nodes and links together are settled by a fold over the group's own array.
FOLD_ROWS = 256


def connected_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest node of each node's component: nodes(grp, node), links(grp, u, v) in one direction.

    Rows are counted per group first. A group of up to FOLD_ROWS rows is gathered once and its links are
    united one after the other inside a column expression; larger groups go through rounds of joins.
    """
    rows = cut(nodes.select("grp", F.col("node").alias("u"), F.col("node").alias("v")).unionByName(links.select("grp", "u", "v").filter("u <> v")), "links")
    large = cut(rows.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > FOLD_ROWS).select("grp"), "large-groups")
    if large.isEmpty():
        return _fold_components(rows)
    small = _fold_components(rows.join(large, "grp", "left_anti"))
    return small.unionByName(_components_by_rounds(rows.join(large, "grp", "left_semi")))


def _fold_components(rows: DataFrame) -> DataFrame:
    """Components of small groups: every link gives the higher of its ends' labels, wherever it stands, the value of the lower."""
    ends = F.collect_set(F.struct("u", "v")).alias("ends")
    both = F.flatten(F.transform("ends", lambda e: F.array(e.u, e.v)))
    at = lambda node: F.array_position("nodes", node).cast("int")

    def unite(labels: Column, link: Column) -> Column:
        a, b = F.element_at(labels, link.i), F.element_at(labels, link.j)
        return F.when(a == b, labels).otherwise(F.transform(labels, lambda x: F.when(x == F.greatest(a, b), F.least(a, b)).otherwise(x)))

    grouped = rows.groupBy("grp").agg(ends).withColumn("nodes", F.array_sort(F.array_distinct(both)))
    placed = grouped.withColumn("links", F.transform(F.filter("ends", lambda e: e.u != e.v), lambda e: F.struct(at(e.u).alias("i"), at(e.v).alias("j"))))
    labelled = placed.select("grp", "nodes", F.aggregate("links", F.col("nodes"), unite).alias("labels"))
    return labelled.select("grp", F.explode(F.arrays_zip("nodes", "labels")).alias("_z")).select("grp", F.col("_z.nodes").alias("node"), F.col("_z.labels").alias("label"))


def _components_by_rounds(rows: DataFrame) -> DataFrame:
    """Components of large groups; (node, node) rows stand for the nodes themselves.

    Every round takes the smallest label of the neighbourhood and then that label's label, so chains of n
    nodes settle in about log n rounds. Groups in which no label moved are finished and leave the rounds.
    """
    both = cut(rows.unionByName(rows.filter("u <> v").select("grp", F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = both.filter("u = v").select("grp", F.col("u").alias("node"), F.col("u").alias("label"))
    done = []
    while True:
        near = both.join(labels.select("grp", F.col("node").alias("v"), "label"), ["grp", "v"])
        low = cut(
            near.groupBy("grp", F.col("u").alias("node")).agg(F.min("label").alias("label"), F.max(F.when(F.col("u") == F.col("v"), F.col("label"))).alias("old")), "low"
        )
        jump = low.select("grp", F.col("node").alias("label"), F.col("label").alias("_up"))
        moved = cut(low.join(jump, ["grp", "label"]).select("grp", "node", F.least("label", "_up").alias("label"), "old"), "labels")
        drop(low)
        active = moved.filter("label <> old").select("grp").distinct()
        if active.isEmpty():
            return reduce(DataFrame.unionByName, [*done, moved.select("grp", "node", "label")])
        done.append(moved.join(active, "grp", "left_anti").select("grp", "node", "label"))
        labels = moved.join(active, "grp", "left_semi").select("grp", "node", "label")


def hit_components(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected clusters of fired detectors per shot, with hit parity and boundary contact (MDL13)."""
    pairs = pair_hits_on_edges(hits, edges).select(F.col("shot_id").alias("grp"), "u", "v")
    labels = connected_components(hits.select(F.col("shot_id").alias("grp"), F.col("det").alias("node")), pairs)
    rim = edges.filter("v IS NULL").select(F.col("u").alias("node"), F.lit(True).alias("_rim")).distinct()
    return (
        labels.join(rim, "node", "left")
        .groupBy(F.col("grp").alias("shot_id"), F.col("label").alias("cluster"))
        .agg(F.count("*").alias("size"), (F.count("*") % 2 == 1).alias("odd"), (F.count("_rim") > 0).alias("touches_boundary"))
    )


def undecodable_shots(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Shots with an odd number of hits in a part of the graph that has no boundary (MDL14)."""
    flat = lambda c: F.col(c).alias("node")
    nodes = edges.select(flat("u")).unionByName(edges.filter("v IS NOT NULL").select(flat("v"))).distinct().withColumn("grp", F.lit(0))
    inner = edges.filter("v IS NOT NULL").select(F.lit(0).alias("grp"), "u", "v")
    parts = connected_components(nodes, inner).select("node", "label")
    rim = edges.filter("v IS NULL").select(F.col("u").alias("node")).join(parts, "node").select("label").distinct()
    # A hit on a node without edges is a closed part of its own.
    located = hits.select("shot_id", F.col("det").alias("node")).join(parts.select("node", F.col("label").alias("_part")), "node", "left").withColumn(
        "label", F.coalesce("_part", "node")
    )
    closed = located.join(rim, "label", "left_anti")
    if not packs(closed, "label"):
        odd = xor_reduce(closed, ["shot_id", "label"])
        return odd.groupBy("shot_id").agg(F.count("*").alias("odd_parts"))
    odd = xor_words(words(closed, ["shot_id"], "label"), ["shot_id"], dealt=True)
    return odd.groupBy("shot_id").agg(F.sum(F.bit_count("_bits").cast("bigint")).alias("odd_parts"))


# ---- shortest paths -----------------------------------------------------------------------------


def pair_distances(
    edges: DataFrame, boundary: int | None = None, sources: DataFrame | None = None, rims: DataFrame | None = None
) -> DataFrame:
    """Shortest paths between nodes: dist, hops, predecessor and observable parity (MDL15).

    Ties go to fewer hops, then to the smaller predecessor. Only labels improved in the last round are
    extended and only improved ones are written, one layer a round, until none improves; the layers are merged
    once at the end. A negative weight raises, as a cycle through it would never end (see
    ``normalize_negative_edges``). No path continues through the boundary node. With ``rims(node, rim)``, boundary distances,
    a label longer than both ends' rims together is dropped as soon as it appears (see ``matching_paths``).
    """
    checked = F.when(F.col("w") < 0, F.raise_error(F.lit("negative edge weight")).cast(edges.schema["w"].dataType)).otherwise(F.col("w")).alias("w")
    sym = cut(
        edges.filter("u <> v").select("u", "v", checked, "obs_mask").unionByName(
            edges.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), checked, "obs_mask")
        ),
        "adjacency",
    )
    start = sym.select(F.col("u").alias("src")).distinct() if sources is None else sources.select("src")
    if boundary is not None:
        start = start.filter(F.col("src") != boundary)
        sym = sym.filter(F.col("u") != boundary)
    if rims is not None:
        of = lambda c, name: rims.select(F.col("node").alias(c), F.col("rim").alias(name))
        sym = cut(sym.join(of("v", "rim_v"), "v", "left"), "adjacency")
        limits = cut(of("src", "rim_src"), "rims")
    m = bits.Masks.of(edges, "obs_mask")
    spark, home = edges.sparkSession, new_path(edges.sparkSession, "paths")
    kinds = sym.select(F.coalesce("u", "v").alias("node"), (F.lit(0).cast("bigint") + F.col("w")).alias("dist")).schema
    own = F.col("src").cast(kinds["node"].dataType)
    first = start.select(
        "src", own.alias("node"), F.lit(0).cast(kinds["dist"].dataType).alias("dist"), F.lit(0).alias("hops"), own.alias("prev"), m.zero().alias("obs")
    )
    at = lambda folder: spark.read.schema(first.schema).parquet(folder).select(*first.columns)
    label = F.struct("dist", "hops", "prev", "obs", "fresh")
    layer = 0
    first.write.parquet(f"{home}/layer=0")
    while True:
        front = at(f"{home}/layer={layer}")
        if front.isEmpty():
            break
        reached = front.join(sym, F.col("node") == F.col("u"))
        if rims is not None:
            useful = F.coalesce(F.col("dist") + F.col("w") <= F.col("rim_src") + F.col("rim_v"), F.lit(True))
            reached = reached.join(limits, "src", "left").filter(useful)
        step = reached.select(
            "src", F.col("v").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), (F.col("hops") + 1).alias("hops"), F.col("u").alias("prev"),
            m.xor(F.col("obs"), F.col("obs_mask").cast(m.type)).alias("obs"), F.lit(1).alias("fresh"),
        )
        best = at(home).withColumn("fresh", F.lit(0)).unionByName(step).groupBy("src", "node").agg(F.min(label).alias("_l"))
        layer += 1
        best.filter("_l.fresh = 1").select("src", "node", "_l.*").drop("fresh").write.parquet(f"{home}/layer={layer}")
    layers = at(home)
    merged = cut(layers.groupBy("src", "node").agg(F.min(F.struct("dist", "hops", "prev", "obs")).alias("_l")).select("src", "node", "_l.*"), "paths")
    drop(layers)
    return merged


def matching_paths(edges: DataFrame, boundary: int) -> DataFrame:
    """The shortest paths a minimum-weight matching can use.

    Matching a to b is never cheaper than sending both to the boundary unless dist(a, b) < rim(a) + rim(b),
    and if that fails at a node it fails at everything beyond it. The table therefore holds each node's
    neighbourhood out to about its own boundary distance instead of all pairs; nodes without a way to the
    boundary keep all their paths.
    """
    start = edges.sparkSession.range(1).select(F.lit(boundary).alias("src"))
    rims = pair_distances(edges, None, start).filter(F.col("node") != boundary).select("node", F.col("dist").alias("rim"))
    return pair_distances(edges, boundary, rims=rims)


def path_edges(paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges on the shortest path of each wanted (src, node), by walking predecessors (MDL16)."""
    link = cut(paths.filter("src <> node").select("src", F.col("node").alias("cur"), "prev"), "links")
    walk = cut(pairs.select("src", "node").distinct().filter("src <> node").withColumn("cur", F.col("node")), "walk")
    out = None
    while not walk.isEmpty():
        step = cut(walk.join(link, ["src", "cur"]), "walk")
        part = step.select("src", "node", F.least("prev", "cur").alias("u"), F.greatest("prev", "cur").alias("v"))
        out = part if out is None else out.unionByName(part)
        walk = step.filter("prev <> src").select("src", "node", F.col("prev").alias("cur"))
    return out if out is not None else pairs.select("src", "node", F.col("src").alias("u"), F.col("node").alias("v")).filter("false")


# ---- undetectable errors ------------------------------------------------------------------------


def hyperedges(targets: DataFrame, max_degree: int | None = None, n_obs: int | None = None) -> DataFrame:
    """Distinct detector sets and observable masks of the mechanisms (duplicates do not change any distance)."""
    n_obs = observable_count(targets) if n_obs is None else n_obs
    mask = num.mask_pack(F.when(F.col("kind") == "L", F.col("idx")), n_obs)
    net = xor_reduce(targets, ["err_id", "kind", "idx"])
    sets = net.groupBy("err_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "D", F.col("idx")))).alias("dets"),
        (mask if bits.words_for(n_obs) else F.coalesce(mask, F.lit(0)).cast("bigint")).alias("obs"),
    )
    out = sets.select("dets", "obs").distinct()
    return out if max_degree is None else out.filter(F.size("dets") <= max_degree)


def _set_xor(a: Column, b: Column) -> Column:
    return F.array_sort(F.concat(F.array_except(a, b), F.array_except(b, a)))


def undetectable_hyper(moves: DataFrame, max_set: int, max_degree: int, no_growth: bool = False) -> DataFrame:
    """Fewest mechanisms that together flip an observable and no detector, as rows (dets, obs) (MDL18).

    Breadth-first over symptom sets: each state's smallest detector is cancelled by any mechanism touching
    it. Limits on set size, mechanism degree and growth prune the search; with both sizes 2 it is exact for
    graph-like models (MDL17).
    """
    m = bits.Masks.of(moves, "obs")
    moves = cut(moves.filter(F.size("dets") <= max_degree), "moves")
    direct = moves.filter((F.size("dets") == 0) & m.any(F.col("obs"))).orderBy("obs").limit(1)
    if not direct.isEmpty():
        return direct
    touching = cut(moves.select(F.explode("dets").alias("det"), F.col("dets").alias("m_dets"), F.col("obs").alias("m_obs")), "touching")
    none = F.array().cast("array<int>")
    zero = m.zero()
    layer = cut(
        moves.filter(m.any(F.col("obs")) & (F.size("dets") <= max_set)).select("dets", "obs", none.alias("p_dets"), zero.alias("p_obs")), "layer"
    )
    layers, seen = [layer], layer.select("dets", "obs")
    while True:
        grown = layer.select("dets", "obs", F.get("dets", F.lit(0)).alias("det")).join(touching, "det").select(
            _set_xor(F.col("dets"), F.col("m_dets")).alias("n_dets"), m.xor(F.col("obs"), F.col("m_obs")).alias("n_obs"), "dets", "obs"
        )
        grown = grown.filter((F.size("n_dets") <= max_set) & ~((F.size("n_dets") == 0) & ~m.any(F.col("n_obs"))))
        if no_growth:
            grown = grown.filter(F.size("n_dets") <= F.size("dets"))
        new = grown.groupBy(F.col("n_dets").alias("dets"), F.col("n_obs").alias("obs")).agg(F.min(F.struct(F.col("dets").alias("p_dets"), F.col("obs").alias("p_obs"))).alias("_p"))
        layer = cut(new.select("dets", "obs", "_p.*").join(seen, ["dets", "obs"], "left_anti"), "layer")
        layers.append(layer)
        if layer.isEmpty():
            raise ValueError("no undetectable logical error within the limits")
        goal = layer.filter(F.size("dets") == 0).orderBy("obs").limit(1)
        if not goal.isEmpty():
            return _walk_back(layers, goal)
        seen = seen.unionByName(layer.select("dets", "obs"))


def _walk_back(layers: list[DataFrame], goal: DataFrame) -> DataFrame:
    """Mechanisms between consecutive states, from the goal to the start; a mechanism used twice cancels."""
    state, used = goal, None
    for earlier in [*reversed(layers[:-1]), None]:
        step = state.select(_set_xor(F.col("dets"), F.col("p_dets")).alias("dets"), bits.Masks.of(state, "obs").xor(F.col("obs"), F.col("p_obs")).alias("obs"))
        used = step if used is None else used.unionByName(step)
        if earlier is not None:
            before = state.select(F.col("p_dets").alias("dets"), F.col("p_obs").alias("obs"))
            state = cut(earlier.join(before, ["dets", "obs"], "left_semi"), "back")
    return xor_reduce(used, ["dets", "obs"])


def shortest_undetectable(edges: DataFrame) -> DataFrame:
    """Shortest graph-like undetectable logical error of edges(u, v, obs_mask) (MDL17)."""
    dets = F.when(F.col("v").isNull(), F.array("u")).otherwise(F.array(F.least("u", "v"), F.greatest("u", "v")))
    moves = edges.filter("v IS NULL OR u <> v").select(dets.cast("array<int>").alias("dets"), F.col("obs_mask").cast(bits.Masks.of(edges, "obs_mask").type).alias("obs")).distinct()
    return undetectable_hyper(moves, 2, 2)
