"""Error-model and circuit tables: flattening, counting, merging, validating, turning into graph edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits
from ..functions import numeric as num
from ..lineage import cut
from ..ordered import running_sums
from .blocks import Unrolled, unroll
from .parity import canonical_targets, merge_weights, xor_probability, xor_reduce

# Instruction names by class.
MEASUREMENTS = ["M", "MZ", "MX", "MY", "MR", "MRZ", "MRX", "MRY", "MPAD", "HERALDED_ERASE", "HERALDED_PAULI_CHANNEL_1", "MPP"]
PAIR_MEASUREMENTS = ["MXX", "MYY", "MZZ"]
HERALDED = ["HERALDED_ERASE", "HERALDED_PAULI_CHANNEL_1"]
PURE_NOISE = [
    "DEPOLARIZE1", "DEPOLARIZE2", "X_ERROR", "Y_ERROR", "Z_ERROR", "I_ERROR", "II_ERROR", "PAULI_CHANNEL_1", "PAULI_CHANNEL_2",
    "E", "CORRELATED_ERROR", "ELSE_CORRELATED_ERROR",
]


def index_of(target: Column) -> Column:
    return F.substring(target, F.lit(2), F.length(target)).cast("bigint")


def _axes(instr: DataFrame, name: str) -> int:
    """Longest argument list of an instruction: the number of coordinate axes, a property of the format's use."""
    return int(instr.filter(F.col("name") == name).agg(F.max(F.size("args"))).first()[0] or 0)


def shift_counters(axes: int, shift: str) -> dict[str, Column]:
    is_shift = F.col("name") == shift
    out = {"det": F.when(is_shift & (F.size("targets") > 0), F.get("targets", F.lit(0)).try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))}
    for a in range(axes):
        out[f"x{a}"] = F.coalesce(F.when(is_shift, F.get("args", F.lit(a))), F.lit(0.0))
    return out


def unroll_model(instr: DataFrame) -> tuple[Unrolled, int]:
    instr = cut(instr, "instructions")  # parsed once for the passes below
    axes = _axes(instr, "shift_detectors")
    return unroll(instr, "model_id", shift_counters(axes, "shift_detectors")), axes


def shifted_coords(axes: int, value) -> Column:
    """Coordinates plus the running shift, only on the axes the declaration has."""
    if not axes:
        return F.col("args")
    shift = F.array(*[value(f"x{a}") for a in range(axes)])
    return F.transform("args", lambda c, i: c + F.coalesce(F.get(shift, i), F.lit(0.0)))


def flatten_model(instr: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Expand repeats and fold shifts into absolute detector ids and coordinates (MDL1, WIN2, WIN3).

    ``path`` orders the result. ``max_rows`` refuses models whose expansion would be larger; counting
    operators use the closed forms and never expand.
    """
    u, axes = unroll_model(instr)
    if max_rows is not None:
        total = u.rows.agg(F.sum("mult")).first()[0] or 0
        if total > max_rows:
            raise ValueError(f"flattening gives {total} rows, above the limit of {max_rows}")
    body = Unrolled(u.rows.filter("name NOT IN ('shift_detectors', '}') AND reps IS NULL"), u.depth, u.counters)
    rows = body.expanded()
    value = lambda c: body.value(c, lambda level: F.col(f"i{level}"))
    det_shift = value("det")
    return rows.select(
        "model_id", "path", "name", "tag",
        F.when(F.col("name") == "detector", shifted_coords(axes, value)).otherwise(F.col("args")).alias("args"),
        F.transform("targets", lambda t: F.when(t.startswith("D"), F.concat(F.lit("D"), (index_of(t) + det_shift).cast("string"))).otherwise(t)).alias("targets"),
    )


def total_shift(instr: DataFrame) -> DataFrame:
    """Final detector and coordinate shift per model, repeat multiplicities included (MDL2)."""
    u, axes = unroll_model(instr)
    is_shift = F.when(F.col("name") == "shift_detectors", F.col("mult")).otherwise(0)
    det = F.when(F.size("targets") > 0, F.get("targets", F.lit(0)).try_cast("bigint")).otherwise(0)
    coords = [F.sum(is_shift * F.coalesce(F.get("args", F.lit(a)), F.lit(0.0))) for a in range(axes)]
    return u.rows.groupBy("model_id").agg(
        F.sum(is_shift * F.coalesce(det, F.lit(0))).alias("det_shift"), F.array(*coords).alias("coord_shift")
    )


def model_counts(instr: DataFrame) -> DataFrame:
    """Detectors, observables (largest index + 1) and errors of each model, without expanding repeats (AGG15)."""
    u, _ = unroll_model(instr)
    at_end = u.value("det", u.last)
    named = u.rows.withColumn("_end", at_end)
    reach = F.array_max(F.transform(F.filter("targets", lambda t: t.startswith("D")), lambda t: index_of(t) + F.col("_end")))
    obs = F.array_max(F.transform(F.filter("targets", lambda t: t.startswith("L")), index_of))
    return named.groupBy("model_id").agg(
        F.coalesce(F.max(reach) + 1, F.lit(0)).alias("detectors"),
        F.coalesce(F.max(obs) + 1, F.lit(0)).alias("observables"),
        F.sum(F.when(F.col("name") == "error", F.col("mult")).otherwise(0)).alias("errors"),
    )


def detector_coordinates(instr: DataFrame, wanted: DataFrame, strict: bool = False) -> DataFrame:
    """Coordinates of the wanted (model_id, det); undeclared ones are empty, impossible ones raise (MDL3).

    The first declaration wins; only detector rows are expanded.
    """
    flat = flatten_model(instr.filter("name <> 'error' AND name <> 'logical_observable'"))
    declared = (
        flat.filter("name = 'detector'")
        .select("model_id", "path", "args", F.explode("targets").alias("_t"))
        .groupBy("model_id", index_of(F.col("_t")).alias("det"))
        .agg(F.min_by("args", "path").alias("coords"))
    )
    out = wanted.join(declared, ["model_id", "det"], "left")
    if strict:
        out = out.join(model_counts(instr).select("model_id", "detectors"), "model_id", "left")
        message = F.concat(F.lit("no such detector: "), F.col("det").cast("string"))
        missing = F.coalesce(F.col("det") >= F.col("detectors"), F.lit(True))
        out = out.withColumn("coords", F.when(missing, F.raise_error(message).cast("array<double>")).otherwise(F.col("coords"))).drop("detectors")
    return out.withColumn("coords", F.coalesce("coords", F.array().cast("array<double>")))


def split_components(errors: DataFrame, key: str = "err_id") -> DataFrame:
    """Target words with ``^`` separators to rows (key, comp, kind, idx) (MDL4)."""
    comps = F.posexplode(F.split(F.array_join("targets", " "), r"\^")).alias("comp", "_part")
    words = errors.select(key, comps).select(key, "comp", F.explode(F.split(F.trim("_part"), r"\s+")).alias("_t"))
    return words.filter("_t <> ''").select(key, "comp", F.substring("_t", 1, 1).alias("kind"), index_of(F.col("_t")).cast("int").alias("idx"))


def observable_count(targets: DataFrame) -> int:
    """Observables that a model's targets name: the highest index plus one."""
    return (targets.filter("kind = 'L'").agg(F.max("idx")).first()[0] or 0) + 1


def component_edges(errors: DataFrame, targets: DataFrame, n_obs: int | None = None) -> DataFrame:
    """One row per error component: its one or two detectors, observables mask, and how many detectors it has.

    The mask is a BIGINT for up to 63 observables and an array of words for more (see ``functions.bits``). ``n_obs`` saves
    a look at the targets for the highest index.
    """
    n_obs = observable_count(targets) if n_obs is None else n_obs
    net = xor_reduce(targets, ["err_id", "comp", "kind", "idx"])
    det = F.when(F.col("kind") == "D", F.col("idx"))
    mask = num.mask_pack(F.when(F.col("kind") == "L", F.col("idx")), n_obs)
    mask = mask if bits.words_for(n_obs) else F.coalesce(mask, F.lit(0).cast("bigint"))
    shape = net.groupBy("err_id", "comp").agg(
        F.count(det).alias("n_det"), F.min(det).alias("u"), F.max(det).alias("_hi"), mask.alias("obs_mask")
    )
    return shape.join(errors.select("err_id", "p"), "err_id").select(
        "err_id", "comp", "n_det", "u", F.when(F.col("n_det") == 2, F.col("_hi")).alias("v"), "obs_mask", "p"
    )


def edges_from_model(errors: DataFrame, targets: DataFrame, n_obs: int | None = None) -> DataFrame:
    """Weighted edges of the graph-like components; parallel ones merged as independent (MDL5).

    Components with no or more than two detectors are left out, as the plain loader does, and so are errors that
    never happen.
    """
    comps = component_edges(errors, targets, n_obs).filter("n_det IN (1, 2) AND p > 0")
    edges = comps.withColumns({"w": num.weight_from_p(F.col("p")), "seq": F.struct("err_id", "comp")})
    return merge_parallel_edges(edges, "independent")


def merge_parallel_edges(edges: DataFrame, strategy: str) -> DataFrame:
    """Reduce edges(u, v, w, p, obs_mask, seq) to one per node pair (AGG5). A NULL ``v`` is the boundary.

    disallow raises on a repeat; independent combines probabilities and keeps the first edge's observables;
    smallest-weight keeps the lightest, the earlier on ties; keep-original and replace keep the first / last.
    """
    pair = edges.withColumns({"_u": F.least("u", "v"), "_v": F.when(F.col("v").isNotNull(), F.greatest("u", "v"))})
    grouped = pair.groupBy(F.col("_u").alias("u"), F.col("_v").alias("v"))
    row = F.struct("w", "p", "obs_mask")
    if strategy == "independent":
        known = F.count("*") == F.count("p")
        return grouped.agg(
            merge_weights(F.col("w")).alias("w"),
            F.when(known, xor_probability(F.col("p"))).alias("p"),
            F.min_by("obs_mask", "seq").alias("obs_mask"),
        )
    if strategy == "disallow":
        message = F.concat(F.lit("parallel edge at node "), F.first("_u").cast("string"))
        picked = F.when(F.count("*") > 1, F.raise_error(message).cast(f"struct<w:double,p:double,obs_mask:{edges.schema['obs_mask'].dataType.simpleString()}>")).otherwise(F.first(row))
    elif strategy == "smallest-weight":
        picked = F.min_by(row, F.struct("w", "seq"))
    elif strategy == "keep-original":
        picked = F.min_by(row, F.col("seq"))
    elif strategy == "replace":
        picked = F.max_by(row, F.col("seq"))
    else:
        raise ValueError(f"unknown merge strategy {strategy!r}")
    return grouped.agg(picked.alias("_r")).select("u", "v", "_r.*")


def parallel_edges(edges: DataFrame) -> DataFrame:
    """Node pairs with more than one edge."""
    lo, hi = F.least("u", "v"), F.when(F.col("v").isNotNull(), F.greatest("u", "v"))
    return edges.groupBy(lo.alias("u"), hi.alias("v")).agg(F.count("*").alias("n")).filter("n > 1")


def merge_duplicate_errors(errors: DataFrame, targets: DataFrame) -> DataFrame:
    """Fuse mechanisms with equal net targets and tag; their probabilities combine by XOR (AGG3)."""
    canon = canonical_targets(targets, "err_id")
    keyed = errors.join(canon, "err_id", "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<struct<kind:string,idx:int>>")))
    return keyed.groupBy("targets", "tag").agg(
        F.min("err_id").alias("err_id"), F.count("*").alias("n_merged"), xor_probability(F.col("p")).alias("p")
    )


def circuit_stats(instr: DataFrame) -> DataFrame:
    """Qubits, measurements, detectors, observables, ticks, sweep bits and longest look-back per circuit (AGG16)."""
    u = unroll(instr, "circuit_id", {})
    name, t = F.col("name"), F.col("targets")
    n_targets = F.size(F.filter(t, lambda w: ~w.isin("*")))
    measured = F.when(name.isin(MEASUREMENTS), n_targets).when(name.isin(PAIR_MEASUREMENTS), F.floor(n_targets / 2)).otherwise(0)
    words = F.flatten(F.transform(t, lambda w: F.split(w, r"\*")))
    qubit = lambda w: F.regexp_extract(w, r"^!?[XYZ]?([0-9]+)$", 1).try_cast("bigint")
    bracket = lambda w, kind: F.regexp_extract(w, rf"^!?{kind}\[-?([0-9]+)\]$", 1).try_cast("bigint")
    top = lambda f: F.array_max(F.transform(words, f))
    times = lambda c: F.sum(F.when(c, F.col("mult")).otherwise(0))
    return u.rows.groupBy("circuit_id").agg(
        F.coalesce(F.max(F.when(~name.isin("MPAD", "SHIFT_COORDS"), top(qubit))) + 1, F.lit(0)).alias("qubits"),
        F.sum(measured * F.col("mult")).cast("bigint").alias("measurements"),
        times(name == "DETECTOR").alias("detectors"),
        F.coalesce(F.max(F.when(name == "OBSERVABLE_INCLUDE", F.get("args", F.lit(0)))).cast("bigint") + 1, F.lit(0)).alias("observables"),
        times(name == "TICK").alias("ticks"),
        F.coalesce(F.max(top(lambda w: bracket(w, "sweep"))) + 1, F.lit(0)).alias("sweep_bits"),
        F.coalesce(F.max(top(lambda w: bracket(w, "rec"))), F.lit(0)).alias("max_lookback"),
    )


def qubit_coordinates(instr: DataFrame) -> DataFrame:
    """Final coordinates per qubit: running shifts applied, the last declaration wins (MDL20)."""
    instr = cut(instr, "instructions")
    axes = _axes(instr, "SHIFT_COORDS")
    is_shift = F.col("name") == "SHIFT_COORDS"
    u = unroll(instr, "circuit_id", {f"x{a}": F.coalesce(F.when(is_shift, F.get("args", F.lit(a))), F.lit(0.0)) for a in range(axes)})
    coords = shifted_coords(axes, lambda c: u.value(c, u.last))
    declared = u.rows.filter("name = 'QUBIT_COORDS'").select("circuit_id", "seq", coords.alias("coords"), F.explode("targets").alias("_t"))
    return declared.groupBy("circuit_id", F.col("_t").cast("bigint").alias("qubit")).agg(F.max_by("coords", "seq").alias("coords"))


def resolve_record_index(instr: DataFrame) -> DataFrame:
    """Measurements of each record reference: instr(circuit_id, seq, n_meas, lookbacks) to absolute indices (WIN1)."""
    work = running_sums(instr, ["circuit_id"], ["seq"], {"before": F.col("n_meas")})
    return work.select("circuit_id", "seq", F.explode("lookbacks").alias("lookback"), "before").select(
        "circuit_id", "seq", "lookback", (F.col("before") - F.col("lookback")).alias("meas")
    )


def resolve_detector_index(instr: DataFrame) -> DataFrame:
    """Running detector number: one per declaration, plus explicit shifts (WIN2)."""
    return running_sums(instr, ["circuit_id"], ["seq"], {"det": F.col("n_det") + F.col("shift")})


def drop_tags(instr: DataFrame) -> DataFrame:
    """Blank every tag (FLT9)."""
    return instr.withColumn("tag", F.lit(""))


def round_model(instr: DataFrame, digits: int) -> DataFrame:
    """Round the probabilities of error rows (FLT10)."""
    return instr.withColumn(
        "args", F.when(F.col("name") == "error", F.transform("args", lambda a: F.round(a, digits))).otherwise(F.col("args"))
    )


def without_noise(instr: DataFrame) -> DataFrame:
    """Drop noise instructions, strip flip probabilities of measurements, pad heralded outcomes (FLT11)."""
    heralded = F.col("name").isin(HERALDED)
    measures = F.col("name").isin(MEASUREMENTS + PAIR_MEASUREMENTS)
    kept = instr.filter(~F.col("name").isin(PURE_NOISE))
    return kept.withColumns({
        "targets": F.when(heralded, F.transform("targets", lambda t: F.lit("0"))).otherwise(F.col("targets")),
        "args": F.when(measures, F.array().cast("array<double>")).otherwise(F.col("args")),
        "name": F.when(heralded, "MPAD").otherwise(F.col("name")),
    })


def find_silent_errors(targets: DataFrame) -> DataFrame:
    """Mechanisms that flip an observable and no detector (FLT12)."""
    net = xor_reduce(targets, ["err_id", "kind", "idx"])
    return net.groupBy("err_id").agg(F.count_if(F.col("kind") == "D").alias("_d"), F.count_if(F.col("kind") == "L").alias("n_obs")).filter(
        "_d = 0 AND n_obs > 0"
    ).drop("_d")


def slice_instructions(instr: DataFrame, key: str, start: int, step: int, n: int) -> DataFrame:
    """Every ``step``-th instruction from position ``start``, ``n`` of them, per model (FLT17)."""
    placed = running_sums(instr, [key], ["seq"], {"_pos": F.lit(1)})
    off = F.col("_pos") - start
    return placed.filter((off >= 0) & (off % step == 0) & (off / step < n)).drop("_pos")


def concat_models(a: DataFrame, b: DataFrame) -> DataFrame:
    """Instructions of ``a`` followed by those of ``b``, model by model (SET4)."""
    end = a.groupBy("model_id").agg((F.max("seq") + 1).alias("_end"))
    shifted = b.join(end, "model_id", "left").withColumn("seq", F.col("seq") + F.coalesce("_end", F.lit(0))).drop("_end")
    return a.unionByName(shifted)


def repeat_model(instr: DataFrame, n: int) -> DataFrame:
    """The model executed ``n`` times, as one enclosing repeat block (SET4)."""
    if n <= 1:
        return instr.filter(F.lit(n == 1))
    ends = instr.groupBy("model_id").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    none, words = F.array().cast("array<double>"), F.array().cast("array<string>")
    frame = ends.select("model_id", F.explode(F.array(
        F.struct((F.col("lo") - 1).alias("seq"), F.lit("repeat").alias("name"), F.lit(n).cast("bigint").alias("reps")),
        F.struct((F.col("hi") + 1).alias("seq"), F.lit("}").alias("name"), F.lit(None).cast("bigint").alias("reps")),
    )).alias("r")).select("model_id", "r.*", F.lit("").alias("tag"), none.alias("args"), words.alias("targets"))
    return instr.unionByName(frame)


def model_diff(a: DataFrame, b: DataFrame, atol: float) -> DataFrame:
    """Instructions that differ in name, tag or targets, or by more than ``atol`` in an argument (SET5)."""
    body = lambda df, s: df.select("model_id", "seq", F.struct("name", "tag", "targets", "reps", "args").alias(s))
    both = body(a, "a").join(body(b, "b"), ["model_id", "seq"], "full_outer")
    same = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    close = (F.size("a.args") == F.size("b.args")) & F.forall(F.arrays_zip(F.col("a.args").alias("x"), F.col("b.args").alias("y")), lambda z: F.abs(z["x"] - z["y"]) <= atol)
    equal = same("name") & same("tag") & same("targets") & same("reps") & F.coalesce(close, F.lit(False))
    return both.filter(~equal).select(
        "model_id", "seq", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change")
    )


def validate_for_correlations(errors: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows that the correlated loader refuses, with the reason (MDL10)."""
    comps = component_edges(errors, targets, 1)
    parts = targets.groupBy("err_id").agg((F.max("comp") + 1).alias("n_comp"))
    too_likely = errors.filter("p > 0.5").select("err_id", F.lit("probability above one half").alias("reason"))
    wide = comps.filter("n_det > 2 AND p > 0").select("err_id", F.lit("three or more detectors").alias("reason")).distinct()
    blind = comps.filter("n_det = 0 AND p > 0").join(parts.filter("n_comp > 1"), "err_id", "left_semi").select(
        "err_id", F.lit("undetectable component").alias("reason")).distinct()
    return too_likely.unionByName(wide).unionByName(blind)


def detectors_per_round(detectors: DataFrame, strict: bool = False) -> DataFrame:
    """Detector count per round and whether all rounds agree (AGG22)."""
    per = detectors.groupBy("round_id").agg(F.count("*").alias("n"))
    out = per.agg(F.count("*").alias("rounds"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    value = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    if strict:
        value = F.coalesce(value, F.raise_error(F.lit("rounds hold different numbers of detectors")).cast("bigint"))
    return out.select("rounds", value.alias("per_round"), (F.col("lo") == F.col("hi")).alias("uniform"))


def quantize_weights(edges: DataFrame, levels: int, max_weight: float = 2.0**24) -> DataFrame:
    """Even-integer weights on a common scale; refuses weights beyond the largest allowed (FN13)."""
    stats = edges.agg(F.max(F.abs("w")).alias("m"), F.bool_and(F.col("w") == F.rint("w")).alias("i"))
    m = stats.select("m").scalar()
    limited = F.when(F.abs("w") > max_weight, F.raise_error(F.lit("edge weight too large")).cast("double")).otherwise(F.col("w"))
    integer = stats.select("i").scalar()
    return edges.withColumns({"q": num.quantize_weight(limited, m, integer, levels), "scale": num.weight_scale(m, integer, levels)})
