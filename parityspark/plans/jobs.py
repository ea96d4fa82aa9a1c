"""User-level jobs: predict, count mistakes, collect, combine, curves, evaluate."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits
from ..lineage import cut
from ..operators import decode as dc
from ..operators import events as ev
from ..operators import graph as gr
from ..operators import model as md
from ..operators import stats as st
from ..operators import windows as wn
from ..operators.parity_sets import ParitySets
from ..sources import shots as sh
from ..sources import stats_csv as sc
from ..sources import text_models as tm

BOUNDARY = -1
WEIGHT_LEVELS = 1 << 14


def model_tables(lines: DataFrame) -> dict[str, DataFrame]:
    """Errors, targets and detector coordinates of one model given as text lines(model_id, seq, line)."""
    flat = cut(md.flatten_model(tm.read_model_text(lines)), "flat-model")
    numbered = flat.filter("name = 'error'").select("path", F.get("args", F.lit(0)).alias("p"), "tag", "targets")
    errors = st.global_index(numbered, ["path"], "err_id")
    errors = cut(errors, "errors")
    coords = flat.filter("name = 'detector'").select("path", "args", F.explode("targets").alias("_t"))
    detectors = coords.groupBy(md.index_of(F.col("_t")).cast("int").alias("det")).agg(F.min_by("args", "path").alias("coords"))
    return {"errors": errors.select("err_id", "p", "tag"), "targets": md.split_components(errors), "detectors": detectors}


def model_paths(errors: DataFrame, targets: DataFrame, n_obs: int | None = None) -> dict[str, DataFrame]:
    """Matching edges with integer weights of one sign, the shortest paths between their nodes, and what the sign change adds.

    ``toggles`` are the detectors that every shot toggles; ``base`` has one row with the weight, observables and scale of every solution.
    """
    edges = cut(md.quantize_weights(md.edges_from_model(errors, targets, n_obs), WEIGHT_LEVELS).select("u", "v", F.col("q").alias("w"), "obs_mask", "scale"), "quantised")
    even = gr.normalize_negative_edges(edges)
    graph = cut(even["edges"].select("u", F.coalesce("v", F.lit(BOUNDARY)).alias("v"), "w", "obs_mask"), "edges")
    scale = edges.agg(F.coalesce(F.max("scale"), F.lit(1.0)))
    base = even["base"].select("base_w", "base_obs", scale.scalar().alias("scale"))
    return {"edges": graph, "toggles": cut(even["base_hits"].select(F.col("det").cast("int").alias("det")), "toggles"), "paths": gr.matching_paths(graph, BOUNDARY), "base": cut(base, "base")}


def predict(
    spark: SparkSession, path: str, fmt: str, layout: sh.Layout, model_lines: DataFrame, shots: DataFrame | None = None,
    postselect_coord: int | None = None,
) -> dict[str, DataFrame]:
    """Predicted observables and weights, in the model's units, of shot files, and the shots postselection dropped (PIPE1).

    A shot that no set of errors explains has a NULL prediction and the reason ``infeasible``. Predictions are BIGINT masks, or arrays of words
    where layout or model name more than 63 observables.
    """
    hits = sh.read_shots(spark, path, fmt, layout).filter("kind = 'D'").select("shot_id", F.col("idx").alias("det"))
    shots = sh.count_shots(spark, path, fmt, layout) if shots is None else shots
    tables = model_tables(model_lines)
    if postselect_coord is not None:
        # Dropping shots first keeps them out of the expensive stage.
        parts = ev.postselect_shots(shots, hits, ev.postselect_mask_from_coord(tables["detectors"], postselect_coord))
        shots, hits, dropped = parts["kept_shots"], parts["kept_hits"], parts["dropped_shots"]
    else:
        dropped = shots.limit(0)
    model = model_paths(tables["errors"], tables["targets"], max(layout.n_obs, md.observable_count(tables["targets"])))
    base_obs, base_w, scale = model["base"].select("base_obs", "base_w", "scale").first()
    per_shot = cut(dc.shot_syndromes(hits), "syndromes")
    if model["toggles"].isEmpty():
        solved = dc.predictions(shots, per_shot, dc.decode(dc.distinct_syndromes(per_shot), model["paths"], BOUNDARY))
    else:
        solved = _toggled_predictions(shots, per_shot, model["toggles"], model["paths"])
    m = bits.Masks.of(solved, "pred_mask")
    found = solved.select(
        "shot_id", F.when(F.col("pred_mask").isNotNull(), m.xor(F.col("pred_mask"), m.value(base_obs))).alias("pred_mask"), ((F.col("w") + base_w) / scale).alias("w"), "reason"
    )
    return {"predictions": found, "discards": dropped.select("shot_id")}


def predict_to_files(
    spark: SparkSession, path: str, fmt: str, layout: sh.Layout, model_lines: DataFrame, out: str, out_fmt: str, kept_out: str | None = None, kept_fmt: str | None = None,
    shots: DataFrame | None = None, postselect_coord: int | None = None,
) -> dict[str, DataFrame]:
    """PIPE1 with its results as shot files: one record of ``layout.n_obs`` predicted bits per kept shot, in shot order.

    With ``kept_out`` the kept shots themselves are written too, record by record beside their predictions. Records have no room for
    "no prediction": an infeasible shot is written without flips and listed in ``infeasible`` (shot_id, pos), pos being its record's number.
    """
    made = predict(spark, path, fmt, layout, model_lines, shots, postselect_coord)
    found = cut(made["predictions"], "predictions")
    # Kept shots are numbered anew, because encodings in groups of 64 have no gaps.
    placed = cut(st.global_index(found.select("shot_id", "pred_mask", "reason"), ["shot_id"], "pos"), "placed")
    records = placed.select(F.col("pos").alias("shot_id"))
    m = bits.Masks.of(placed, "pred_mask")
    flips = placed.select(F.col("pos").alias("shot_id"), F.lit("L").alias("kind"), F.explode(m.indices(F.col("pred_mask")).cast("array<int>")).alias("idx"))
    sh.write_shots(records, flips, out, out_fmt, sh.Layout(n_obs=layout.n_obs))
    if kept_out is not None:
        recorded = sh.read_shots(spark, path, fmt, layout).join(placed.select("shot_id", "pos"), "shot_id")
        sh.write_shots(records, recorded.select(F.col("pos").alias("shot_id"), "kind", "idx"), kept_out, kept_fmt or fmt, layout)
    return {"infeasible": placed.filter("reason = 'infeasible'").select("shot_id", "pos"), "discards": made["discards"]}


def _toggled_predictions(shots: DataFrame, per_shot: DataFrame, toggles: DataFrame, paths: DataFrame) -> DataFrame:
    """Predictions where every shot toggles the same detectors: only distinct syndromes are toggled, never shots."""
    nothing = F.array().cast("array<int>")
    known = dc.distinct_syndromes(per_shot).select("key").unionByName(shots.sparkSession.range(1).select(nothing.alias("key")))
    named = cut(known.withColumn("shot_id", F.monotonically_increasing_id()), "recorded-keys")
    sets = ParitySets(named.select("shot_id"), named.select("shot_id", F.explode("key").alias("det")), toggles)
    true_keys = cut(named.join(dc.shot_syndromes(sets.rows()).withColumnRenamed("key", "true_key"), "shot_id", "left").select("key", "true_key"), "true-keys")
    decoded = dc.decode(true_keys.filter("true_key IS NOT NULL").select(F.col("true_key").alias("key")), paths, BOUNDARY).withColumnRenamed("key", "true_key")
    zero = bits.Masks.of(decoded, "obs").zero()
    # A syndrome that the toggles cancel has nothing to match.
    whole = true_keys.join(decoded, "true_key", "left").select(
        "key", F.when(F.col("true_key").isNull(), F.lit(0.0)).otherwise(F.col("w")).alias("w"), F.when(F.col("true_key").isNull(), zero).otherwise(F.col("obs")).alias("obs"),
        F.when(F.col("true_key").isNull(), "empty").otherwise(F.col("reason")).alias("reason"),
    )
    every = shots.select("shot_id").join(per_shot, "shot_id", "left").select("shot_id", F.coalesce("key", nothing).alias("key"))
    return dc.predictions(shots, every, whole)


def count_mistakes(
    spark: SparkSession, path: str, fmt: str, layout: sh.Layout, actual: DataFrame, model_lines: DataFrame
) -> DataFrame:
    """Shots, errors and discards of decoding shot files against their recorded observables (PIPE2)."""
    pred = predict(spark, path, fmt, layout, model_lines, actual.select("shot_id"))["predictions"]
    pred, actual = bits.alike(pred.select("shot_id", "pred_mask"), "pred_mask", actual.select("shot_id", "obs_mask"), "obs_mask")
    # The filter reads ``side``, so that a shot on one side only is an error.
    aligned = ev.align_records(pred, actual, strict=True).filter("side IS NULL").drop("side")
    return ev.count_mistakes(ev.score_aligned(aligned))


def collect(
    tasks: DataFrame, existing: DataFrame, decoders: Sequence[str], recorded: Callable[[str], DataFrame], hits: DataFrame, mask: DataFrame, n_obs: int, n_det: int
) -> DataFrame:
    """Statistics of recorded shots for every unfinished task and decoder (PIPE3).

    ``tasks(strong_id, shot_id range lo..hi, decoder, max_shots, max_errors)`` name their recorded shots;
    ``recorded(decoder)`` gives predictions (shot_id, part, pred_mask, obs_mask, seconds). A NULL prediction of a kept
    shot is an error without a mistake pattern.
    """
    todo = st.expand_tasks(tasks.join(st.pending_tasks(tasks, existing).select("strong_id"), "strong_id", "left_semi"), decoders)
    bad = hits.join(mask, "det", "left_semi").select("shot_id").distinct().withColumn("_bad", F.lit(True))
    per_shot = hits.groupBy("shot_id").agg(F.count("*").alias("hw"))
    out = None
    for name in decoders:
        mine = todo.filter(F.col("decoder") == name).select("strong_id", "part", F.lit(name).alias("decoder"))
        rows = recorded(name).join(mine, "part").join(bad, "shot_id", "left").join(per_shot, "shot_id", "left")
        m = bits.Masks.of(rows, "pred_mask")
        mistake = m.xor(F.col("pred_mask"), F.col("obs_mask"))
        kept = F.col("_bad").isNull()
        wrong = F.coalesce(m.any(mistake), F.lit(True))
        # Statistics of one shot: totals plus the counts of fired detectors and of each mistake combination.
        one = rows.select(
            F.concat("strong_id", F.lit("/"), "decoder").alias("strong_id"), "decoder", F.lit(1).cast("bigint").alias("shots"),
            (kept & wrong).cast("bigint").alias("errors"), (~kept).cast("bigint").alias("discards"), "seconds",
            F.coalesce("hw", F.lit(0)).alias("detection_events"), F.when(kept & wrong, mistake).alias("mistake"),
        )
        out = one if out is None else out.unionByName(one)
    label = lambda m: ev.mistake_label(m, n_obs, bits.Masks.of(out, "mistake"))
    # Fold identical mistakes first, then one row per task.
    by_mistake = out.groupBy("strong_id", "decoder", "mistake").agg(*[F.sum(c).alias(c) for c in ("shots", "errors", "discards", "seconds", "detection_events")])
    combos = F.array_sort(F.collect_list(F.when(F.col("mistake").isNotNull(), F.struct(label(F.col("mistake")).alias("k"), F.col("errors").alias("n")))))
    folded = by_mistake.groupBy("strong_id", "decoder").agg(
        *[F.sum(c).alias(c) for c in ("shots", "errors", "discards", "seconds")], combos.alias("_c"), F.sum("detection_events").alias("_d")
    )
    basics = F.array(F.struct(F.lit("detection_events").alias("k"), F.col("_d").alias("n")), F.struct(F.lit("detectors_checked").alias("k"), (F.col("shots") * n_det).alias("n")))
    return folded.withColumn("custom_counts", F.map_from_entries(F.concat(basics, "_c"))).drop("_c", "_d")


def decode_tasks(shots: DataFrame, hits: DataFrame, models: DataFrame, decoder: Callable[[DataFrame, DataFrame, int], DataFrame] = dc.decode) -> DataFrame:
    """Predictions of the shots of many tasks, each under its own task's model, in one decoding.

    ``shots(shot_id, part)``, ``hits(shot_id, part, det)`` and ``models(part, u, v, w, obs_mask)`` name the task in ``part``; a NULL ``v``
    is the boundary. Nodes of all models get numbers of their own, so that the models lie side by side in one graph
    and no work is per task on the driver. A hit on a detector that its model does not know makes its shot infeasible.
    """
    named = models.select("part", F.col("u").alias("det")).unionByName(models.filter("v IS NOT NULL").select("part", F.col("v").alias("det")))
    numbered = st.global_index(named.unionByName(hits.select("part", "det")).distinct(), ["part", "det"], "node")
    nodes = cut(numbered.select("part", "det", F.col("node").cast("int").alias("node")), "task-nodes")
    end = lambda c: nodes.select("part", F.col("det").alias(c), F.col("node").alias(f"_{c}"))
    graph = models.join(end("u"), ["part", "u"]).join(end("v"), ["part", "v"], "left")
    edges = cut(graph.select(F.col("_u").alias("u"), F.coalesce("_v", F.lit(BOUNDARY)).alias("v"), "w", "obs_mask"), "task-edges")
    fired = hits.join(nodes, ["part", "det"]).select("shot_id", F.col("node").alias("det"))
    per_shot = cut(dc.shot_syndromes(fired), "syndromes")
    return dc.predictions(shots, per_shot, decoder(dc.distinct_syndromes(per_shot), gr.matching_paths(edges, BOUNDARY), BOUNDARY))


def collect_decoding(
    tasks: DataFrame, existing: DataFrame, decoders: Mapping[str, Callable[[DataFrame, DataFrame, int], DataFrame] | None], shots: DataFrame, hits: DataFrame,
    models: DataFrame, mask: DataFrame, n_obs: int, n_det: int,
) -> DataFrame:
    """Statistics of recorded shots, decoded here, for every unfinished task and decoder (PIPE3).

    ``shots(shot_id, part, obs_mask, seconds)``; tasks as in ``collect``, models as in ``decode_tasks``, with the detectors of postselection in ``mask``.
    ``decoders`` gives each name a function such as ``decode.decode``, or None to predict no flip (DEC10). Finished tasks and shots that postselection drops
    are never decoded.
    """
    left = tasks.join(st.pending_tasks(tasks, existing).select("strong_id"), "strong_id", "left_semi").select("part").distinct()
    wanted = cut(shots.join(left, "part", "left_semi").select("shot_id", "part", "obs_mask", "seconds"), "recorded-shots")
    part_hits = cut(hits.join(wanted.select("shot_id", "part"), "shot_id"), "recorded-hits")
    bad = part_hits.join(mask, "det", "left_semi").select("shot_id").distinct()
    kept, kept_hits = wanted.join(bad, "shot_id", "left_anti"), part_hits.join(bad, "shot_id", "left_anti")
    own_models = models.join(left, "part", "left_semi")
    m = bits.Masks.of(wanted, "obs_mask")

    def recorded(name: str) -> DataFrame:
        if decoders[name] is None:
            return wanted.withColumn("pred_mask", m.zero())
        found = decode_tasks(kept.select("shot_id", "part"), kept_hits, own_models, decoders[name])
        return wanted.join(found.select("shot_id", "pred_mask"), "shot_id", "left")

    return collect(tasks, existing, list(decoders), recorded, part_hits.select("shot_id", "det"), mask, n_obs, n_det)


def combine(spark: SparkSession, paths: Sequence[str], order: str = "metadata", strip: bool = False) -> DataFrame:
    """Folded statistics of several sources in a chosen order (PIPE4)."""
    total = sc.read_task_stats(spark, paths, strict=True)
    total = st.strip_custom_counts(total) if strip else total
    return total if order == "preserve" else st.order_stats(total, order)


def curves(
    spark: SparkSession, paths: Sequence[str], x: str, group: str, pieces: str = "1", keep: str = "true", keys: Sequence[str] = (),
    prepare: Callable[[DataFrame], DataFrame] | None = None, factor: float = 1000, scales: tuple[str, str] = ("linear", "log"),
) -> dict[str, DataFrame]:
    """Plot-ready points and fitted lines of the statistics in several sources (PIPE5): split, filter, prepare, fit."""
    total = sc.read_task_stats(spark, paths)
    if keys:
        total = st.split_custom_counts(total, keys)
    total = st.filter_stats(total, keep)
    if prepare is not None:
        total = st.preprocess(total, prepare)
    total = st.derive_columns(total, x=x, curve=group, pieces=pieces)
    points = st.curve_table(st.error_rate_points(total, factor, F.col("pieces").cast("double")), ["curve"], "x", "strong_id")
    return {
        "points": points, "lines": st.line_fit_curves(points, ["curve"], *scales), "range": st.axis_range(points, ["low", "best", "high"], (1e-4, 1.0), positive=True),
        "common": st.common_properties(total),
    }


def evaluate(log: DataFrame, max_errors: int) -> dict[str, DataFrame]:
    """Decoder summary and Hamming-weight histogram of a decode log, stopped after enough errors (PIPE6).

    ``log(task_id, shot_id, hw, us, pred_mask, obs_mask)``.
    """
    m = bits.Masks.of(log, "pred_mask")
    wrong = (F.col("hw") > 0) & (m.any(m.xor(F.col("pred_mask"), F.col("obs_mask"))) if m.words else F.col("pred_mask") != F.col("obs_mask"))
    seen = wn.truncate_at_k_errors(log.withColumn("is_error", wrong), max_errors)
    return {"summary": ev.decoder_summary(seen), "histogram": ev.hamming_weight_histogram(seen)}
