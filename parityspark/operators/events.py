"""From recorded bits to detection events, postselected shots and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from ..functions import numeric as num
from ..lineage import cut
from .parity import packs, toggles, unpacked, words, xor_items, xor_reduce, xor_words
from .parity_sets import ParitySets

# Joins in this module carry no broadcast hints: the planner broadcasts a side when its measured size is
# below spark.sql.autoBroadcastJoinThreshold and shuffles (with skew splitting) when it is not.


def measurements_to_events(
    shots: DataFrame, meas_hits: DataFrame, det_def: DataFrame, expected: DataFrame | None = None, out: str = "det"
) -> DataFrame:
    """Detection events: parity of the measurements in each definition, against the noiseless value (JN1).

    ``det_def(det, meas)`` lists each definition's measurements, ``expected(det, expect)`` the noiseless
    parities. A definition without measurements can only fire where its expectation is 1. Jobs that count or mask
    events take ``measured_events`` instead, which never unrolls the expected ones.
    """
    if expected is None:
        return _fired(meas_hits, det_def, out)
    as_det = lambda df: df.withColumnRenamed(out, "det")
    return measured_events(shots, meas_hits, as_det(det_def), as_det(expected)).rows().withColumnRenamed("det", out)


def measured_events(shots: DataFrame, meas_hits: DataFrame, det_def: DataFrame, expected: DataFrame) -> ParitySets:
    """Detection events as the detectors expected to fire and each shot's difference from them."""
    return ParitySets(shots.select("shot_id"), _fired(meas_hits, det_def, "det"), expected.filter(F.col("expect") == 1).select("det").distinct())


def _fired(meas_hits: DataFrame, det_def: DataFrame, out: str) -> DataFrame:
    """Definitions with an odd number of set measurements in a shot."""
    if not packs(det_def, out):
        return xor_reduce(meas_hits.join(det_def, "meas").select("shot_id", out), ["shot_id", out])
    flips = toggles(meas_hits, det_def.select("meas", out), "meas", [], out)
    return unpacked(xor_words(flips, ["shot_id"]), ["shot_id"], out, det_def.schema[out].dataType.simpleString())


def apply_sweep(events: DataFrame, sweep_hits: DataFrame, sweep_effect: DataFrame) -> DataFrame:
    """XOR the detectors controlled by each shot's sweep bits into its events (JN2)."""
    if not (packs(events, "det") and packs(sweep_effect, "det")):
        flips = sweep_hits.join(sweep_effect, "sweep").select("shot_id", "det")
        return xor_reduce(events.select("shot_id", "det").unionByName(flips), ["shot_id", "det"])
    # At most a row for each of a word's events and of a shot's sweep bits.
    both = words(events, ["shot_id"], "det").unionByName(toggles(sweep_hits, sweep_effect.select("sweep", "det"), "sweep", [], "det"))
    return unpacked(xor_words(both, ["shot_id"], dealt=True), ["shot_id"], "det", events.schema["det"].dataType.simpleString())


def align_records(a: DataFrame, b: DataFrame, strict: bool = False) -> DataFrame:
    """Pair the shots of two record sets; ``side`` says where a shot is missing (JN3)."""
    left = a.withColumn("_in_a", F.lit(True))
    right = b.withColumn("_in_b", F.lit(True))
    side = F.when(F.col("_in_a").isNull(), "left").when(F.col("_in_b").isNull(), "right")
    if strict:
        side = F.when(
            F.col("_in_a").isNull() | F.col("_in_b").isNull(),
            F.raise_error(F.concat(F.lit("records differ in length at shot "), F.col("shot_id").cast("string"))),
        ).cast("string")
    return left.join(right, "shot_id", "full_outer").withColumn("side", side).drop("_in_a", "_in_b")


def replay_errors(err_hits: DataFrame, targets: DataFrame) -> DataFrame:
    """Detectors and observables flipped by recorded mechanism firings (JN4)."""
    if not packs(targets, "idx"):
        return xor_reduce(err_hits.join(xor_reduce(targets, ["err_id", "kind", "idx"]), "err_id"), ["shot_id", "kind", "idx"])
    # A shot has a row for each of its firings and their words.
    flips = toggles(err_hits, targets.select("err_id", "kind", "idx"), "err_id", ["kind"], "idx")
    flipped = xor_words(flips, ["shot_id", "kind"], dealt=True)
    return unpacked(flipped, ["shot_id", "kind"], "idx", targets.schema["idx"].dataType.simpleString())


def syndrome_of(fault_hits: DataFrame, checks: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """Batch matrix-vector product over GF(2); boundary rows stay 0 (JN5). checks(row, col), faults(shot_id, col)."""
    rows = checks if boundary is None else checks.join(boundary.select(F.col("node").alias("row")), "row", "left_anti")
    return xor_items(fault_hits.join(rows, "col"), ["shot_id"], "row")


def score_predictions(pred: DataFrame, actual: DataFrame, obs_postmask: int = 0, discards: DataFrame | None = None) -> DataFrame:
    """Join predictions to the truth; flag discards, errors and the wrong observables (JN6).

    A shot is discarded when postselection dropped it or a postselected observable was mispredicted, and a
    discarded shot is never an error. A kept shot without a prediction, or with a NULL one, is an error whose
    mistake mask is NULL. Masks are BIGINT or arrays of words; ``obs_postmask`` is a Python number of any size.
    """
    pred, actual = bits.alike(pred, "pred_mask", actual, "obs_mask")
    return score_aligned(actual.join(pred, "shot_id", "left"), obs_postmask, discards)


def score_aligned(aligned: DataFrame, obs_postmask: int = 0, discards: DataFrame | None = None) -> DataFrame:
    """``score_predictions`` of rows that hold both masks, of one kind."""
    m = bits.Masks.of(aligned, "obs_mask")
    # A NULL prediction gives a NULL mistake, as it does between numbers.
    mistake = F.when(F.col("pred_mask").isNotNull(), m.xor(F.col("obs_mask"), F.col("pred_mask")))
    joined = aligned.withColumn("mistake_mask", mistake)
    discard: Column = F.coalesce(m.any(m.both(F.col("mistake_mask"), m.value(obs_postmask))), F.lit(False))
    if discards is not None:
        joined = joined.join(discards.select("shot_id", F.lit(True).alias("_d")).distinct(), "shot_id", "left")
        discard = discard | F.col("_d").isNotNull()
    return joined.withColumn("discarded", discard).select(
        "shot_id", "discarded", ((~F.col("discarded")) & F.coalesce(m.any(F.col("mistake_mask")), F.lit(True))).alias("is_error"), "mistake_mask"
    )


def count_mistakes(scored: DataFrame) -> DataFrame:
    """Shots, errors and discards (AGG6)."""
    return scored.agg(
        F.count("*").alias("shots"),
        F.count_if("is_error").alias("errors"),
        F.count_if("discarded").alias("discards"),
    )


def count_mistake_combos(scored: DataFrame, n_obs: int) -> DataFrame:
    """How often each combination of wrong observables occurs among kept shots (AGG8)."""
    label = mistake_label(F.col("mistake_mask"), n_obs, bits.Masks.of(scored, "mistake_mask"))
    return (
        scored.filter("is_error")
        .groupBy("mistake_mask")
        .agg(F.count("*").alias("n"))
        .select(label.alias("combo"), "n")
    )


def mistake_label(mask: Column, n_obs: int, masks: bits.Masks) -> Column:
    """Name of a combination of wrong observables: one letter an observable, E for wrong."""
    if masks.words:
        wrong = masks.indices(mask)
        letters = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n_obs - 1)), lambda i: F.when(F.array_contains(wrong, i), "E").otherwise("_")), "")
    else:
        letters = F.translate(F.reverse(F.lpad(F.bin(mask), n_obs, "0")), "01", "_E")
    return F.concat(F.lit("obs_mistake_mask="), F.when(mask.isNotNull(), letters))


def postselect_mask_from_coord(detectors: DataFrame, k: int = 3) -> DataFrame:
    """Detectors whose coordinate ``k`` exists and is not zero (FLT1)."""
    return detectors.filter((F.size("coords") > k) & (F.get("coords", F.lit(k)) != 0)).select("det")


def postselect_mask_from_predicate(detectors: DataFrame, tasks: DataFrame, expr: str) -> DataFrame:
    """Per task, the detectors of its model for which a SQL predicate over (det, coords, metadata) holds (FLT2)."""
    return tasks.join(detectors, "model_id").filter(F.expr(expr)).select("task_id", "det")


def postselect_obs_mask(tasks: DataFrame, n_obs: int, expr: str) -> DataFrame:
    """Per task, a mask of the observables for which a SQL predicate over (obs, metadata) holds (FLT3)."""
    chosen = tasks.withColumn("obs", F.explode(F.sequence(F.lit(0), F.lit(n_obs - 1))))
    mask = num.mask_pack(F.when(F.expr(expr), F.col("obs")), n_obs)
    return chosen.groupBy("task_id").agg((mask if bits.words_for(n_obs) else F.coalesce(mask, F.lit(0).cast("long"))).alias("obs_mask"))


def masked_shots(hits: DataFrame | ParitySets, mask: DataFrame) -> DataFrame:
    """Shots in which a masked detector fired."""
    return hits.within(mask).any() if isinstance(hits, ParitySets) else hits.join(mask, "det", "left_semi").select("shot_id").distinct()


def predict_discards(shots: DataFrame, hits: DataFrame | ParitySets, mask: DataFrame) -> DataFrame:
    """One boolean per shot: did any masked detector fire (FLT4)?"""
    bad = masked_shots(hits, mask).withColumn("_bad", F.lit(True))
    return shots.select("shot_id").join(bad, "shot_id", "left").select(
        "shot_id", F.coalesce("_bad", F.lit(False)).alias("discarded")
    )


def postselect_shots(shots: DataFrame, hits: DataFrame | ParitySets, mask: DataFrame) -> dict[str, DataFrame | ParitySets]:
    """Split shots and hits into kept and dropped (FLT5); parity sets stay parity sets."""
    if isinstance(hits, ParitySets):
        # Both halves read the sets and the dropped shots as written, not the work that made them.
        hits = ParitySets(hits.shots, cut(hits.diff, "differences"), cut(hits.base, "base"))
        bad = cut(masked_shots(hits, mask), "dropped")
        kept, dropped = shots.join(bad, "shot_id", "left_anti"), shots.join(bad, "shot_id", "left_semi")
        return {"kept_shots": kept, "dropped_shots": dropped, "kept_hits": hits.of(kept), "dropped_hits": hits.of(dropped)}
    # One row a shot, hashed; the hits pass by it unsorted.
    bad = masked_shots(hits, mask).hint("shuffle_hash")
    return {
        "kept_shots": shots.join(bad, "shot_id", "left_anti"),
        "dropped_shots": shots.join(bad, "shot_id", "left_semi"),
        "kept_hits": hits.join(bad, "shot_id", "left_anti"),
        "dropped_hits": hits.join(bad, "shot_id", "left_semi"),
    }


def split_kinds(hits: DataFrame, n_meas: int, n_det: int) -> DataFrame:
    """Flat bit positions to (kind, index), detectors and observables counted from 0 (FLT14)."""
    i = F.col("idx")
    kind = F.when(i < n_meas, "M").when(i < n_meas + n_det, "D").otherwise("L")
    base = F.when(i < n_meas, 0).when(i < n_meas + n_det, n_meas).otherwise(n_meas + n_det)
    return hits.select("shot_id", kind.alias("kind"), (i - base).cast("int").alias("idx"))


def validate_shots(hits: DataFrame, layout: dict[str, int]) -> DataFrame:
    """Hits whose index is outside the layout of their kind (FLT16)."""
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for k, n in layout.items()], F.lit(0))
    return hits.filter((F.col("idx") < 0) | (F.col("idx") >= limit)).select("shot_id", "kind", "idx", limit.alias("n_bits"))


def drop_boundary_hits(hits: DataFrame, boundary: DataFrame) -> DataFrame:
    """Hits on boundary nodes carry no information (FLT18)."""
    return hits.join(boundary, "det", "left_anti")


def first_round(detectors: DataFrame) -> DataFrame:
    """Detectors of round 0 with base, super-round and sub-round ids read from coordinates (FLT19)."""
    c = F.col("coords")
    return detectors.filter(F.get(c, F.lit(2)) == 0).select(
        "det",
        F.get(c, F.lit(0)).cast("int").alias("base_det"),
        F.get(c, F.lit(1)).cast("int").alias("super_round"),
        F.get(c, F.lit(2)).cast("int").alias("sub_round"),
    )


def lookup_detector(hits: DataFrame, detectors: DataFrame) -> DataFrame:
    """Attach a detector's attributes to its hits (JN10)."""
    return hits.join(detectors, "det", "left")


def route_two_level(hits: DataFrame, detectors: DataFrame, base_map: DataFrame, sub_rounds: int, n_inner: int, n_outer: int) -> DataFrame:
    """Send each hit to the inner or the outer stream and renumber it there (JN11).

    ``base_map(base_det, inner_id, outer_id)``: bases with an inner id belong to the inner code. A super
    round holds ``sub_rounds`` rounds and one closing round.
    """
    per_super = sub_rounds + 1
    r = F.col("round_id")
    joined = hits.join(detectors.select("det", "base_det", "round_id"), "det").join(base_map, "base_det", "left")
    return joined.select(
        "shot_id",
        "det",
        F.when(F.col("inner_id").isNotNull(), "inner").otherwise("outer").alias("stream"),
        F.when(F.col("inner_id").isNotNull(), r * n_inner + F.col("inner_id"))
        .otherwise(F.floor(r / per_super) * n_outer + F.col("outer_id"))
        .cast("int")
        .alias("idx"),
    )


def unmatched_bases(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Inner bases without an outer counterpart, and bases listed twice (JN12)."""
    lone = inner.join(outer, "base_det", "left_anti").select("base_det", F.lit("unmatched").alias("problem")).distinct()
    twice = inner.groupBy("base_det").count().filter("count > 1").select("base_det", F.lit("duplicate").alias("problem"))
    return lone.unionByName(twice)


def count_detection_events(hits: DataFrame | ParitySets, shots: DataFrame, n_det: int) -> DataFrame:
    """Detection events, detectors checked and their ratio, over all shots before discarding (AGG7)."""
    events = hits.total() if isinstance(hits, ParitySets) else hits.agg(F.count("*").alias("n"))
    return shots.agg(
        F.first(events.scalar()).alias("detection_events"), (F.count("*") * n_det).alias("detectors_checked")
    ).withColumn(
        "detection_fraction", F.expr("try_divide(detection_events, detectors_checked)").cast("double")
    )


def hits_per_shot(hits: DataFrame | ParitySets, shots: DataFrame) -> DataFrame:
    """Hamming weight of every shot, 0 included."""
    if isinstance(hits, ParitySets):
        return hits.sizes().withColumnRenamed("n", "hw")
    # Sum markers over the union instead of an outer join: one shuffle, combined map-side.
    return (
        hits.select("shot_id", F.lit(1).alias("_h"), F.lit(0).alias("_s"))
        .unionByName(shots.select("shot_id", F.lit(0).alias("_h"), F.lit(1).alias("_s")))
        .groupBy("shot_id")
        .agg(F.sum("_h").alias("hw"), F.max("_s").alias("_s"))
        .filter("_s = 1")
        .select("shot_id", "hw")
    )


def hamming_weight_histogram(log: DataFrame) -> DataFrame:
    """Trials and mean decode time per Hamming weight of a decode log(hw, us) (AGG9)."""
    return log.groupBy("hw").agg(F.count("*").alias("trials"), F.avg("us").alias("mean_us"))


def decoder_summary(log: DataFrame, score_trivial: bool = False) -> DataFrame:
    """Errors, trials, rate and mean times of a decode log; shots without hits are trials but not scored (AGG10)."""
    m = bits.Masks.of(log, "pred_mask")
    wrong = m.any(m.xor(F.col("pred_mask"), F.col("obs_mask"))) if m.words else F.col("pred_mask") != F.col("obs_mask")
    if not score_trivial:
        wrong = wrong & (F.col("hw") > 0)
    return log.agg(
        F.count_if(wrong).alias("errors"),
        F.count("*").alias("trials"),
        F.count_if(F.col("hw") == 0).alias("trivial"),
        F.avg("us").alias("mean_us"),
        F.avg(F.when(F.col("hw") > 0, F.col("us"))).alias("mean_us_nontrivial"),
    ).withColumn("rate", F.expr("try_divide(errors, trials)"))


def neighbors(edges: DataFrame) -> DataFrame:
    """Adjacency rows in both directions (JN13)."""
    fwd = edges.select(F.col("u").alias("node"), F.col("v").alias("neighbor"), "w", "obs_mask")
    back = edges.filter("v IS NOT NULL AND u <> v").select(
        F.col("v").alias("node"), F.col("u").alias("neighbor"), "w", "obs_mask"
    )
    return fwd.unionByName(back)


def edge_data(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Look up edges for (a, b) pairs in either direction; ``has_edge`` is false where there is none."""
    key = edges.select(
        F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), "w", "obs_mask", F.lit(True).alias("_e")
    )
    return (
        pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
        .join(key, ["lo", "hi"], "left")
        .select("a", "b", F.coalesce("_e", F.lit(False)).alias("has_edge"), "w", "obs_mask")
    )


def pair_hits_on_edges(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs of a shot's hits that share an edge (JN14).

    Each hit first meets its edges, and the far end is then looked up by (shot, node): the work follows the
    graph's degree, and a shot with very many hits is spread over its nodes.
    """
    near = hits.select("shot_id", F.col("det").alias("u")).join(edges.filter("v IS NOT NULL"), "u")
    far = hits.select("shot_id", F.col("det").alias("v"))
    return near.join(far, ["shot_id", "v"]).filter("u < v").select("shot_id", "u", "v", "w", "obs_mask")


def compare_decoders(log_a: DataFrame, log_b: DataFrame) -> DataFrame:
    """Shots on which two decoders disagree (DEC12)."""
    a = log_a.select("shot_id", F.col("pred_mask").alias("pred_a"))
    b = log_b.select("shot_id", F.col("pred_mask").alias("pred_b"))
    a, b = bits.alike(a, "pred_a", b, "pred_b")
    m = bits.Masks.of(a, "pred_a")
    return a.join(b, "shot_id").filter(m.any(m.xor(F.col("pred_a"), F.col("pred_b"))) if m.words else F.col("pred_a") != F.col("pred_b"))


def leftover_events(inner: DataFrame, committed: DataFrame, outer: DataFrame) -> DataFrame:
    """Inner events the inner pass did not explain, XORed into the outer set (SET6)."""
    keys = ["shot_id", "det"]
    left = inner.join(committed.select(*keys), keys, "left_anti").select(*keys)
    return xor_items(left.unionByName(outer.select(*keys)), ["shot_id"], "det")
