"""Task statistics: folding, editing, fitting and preparing curves."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as num
from ..functions import text as txt
from ..ordered import global_index

COUNTS = "map<string,bigint>"


METRICS = ("shots", "errors", "discards", "seconds")


def _by_identity(stats: DataFrame, extra: Sequence[str] = (), sums: Sequence[str] = METRICS) -> DataFrame:
    """Sums per id and identity columns.

    With the strings among the keys the big aggregation is a plain hash aggregate; what is left for the
    checks and picks below is about one row per id.
    """
    keys = ["strong_id", *[c for c in ("decoder", "json_metadata") if c in stats.columns], *extra]
    return stats.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def _canonical(c: str) -> Column:
    return F.col(c) if c == "decoder" else F.coalesce(txt.canonical_json(F.col(c)), F.lit("null"))


def combine_stats(stats: DataFrame, strict: bool = False) -> DataFrame:
    """Sum shots, errors, discards and seconds per strong id (AGG11); strict mode refuses conflicting identities."""
    aggs = [F.sum(c).alias(c) for c in METRICS]
    for c in ("decoder", "json_metadata"):
        if c not in stats.columns:
            continue
        value = F.min(c)
        if strict:
            clash = F.raise_error(F.concat(F.lit(f"conflicting {c} under "), F.col("strong_id"))).cast("string")
            value = F.when(F.min(_canonical(c)) != F.max(_canonical(c)), clash).otherwise(value)
        aggs.append(value.alias(c))
    return _by_identity(stats).groupBy("strong_id").agg(*aggs)


def count_rows(stats: DataFrame) -> DataFrame:
    """One row per statistic and count name."""
    return stats.select("strong_id", F.explode("custom_counts").alias("name", "n"))


def merge_custom_counts(stats: DataFrame) -> DataFrame:
    """Per-name sums of the custom counts, folded back to a map; sums of 0 or less are dropped (AGG12)."""
    sums = count_rows(stats).groupBy("strong_id", "name").agg(F.sum("n").alias("n")).filter("n > 0")
    folded = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n"))))
    return sums.groupBy("strong_id").agg(folded.alias("custom_counts"))


def fold_stats(stats: DataFrame, strict: bool = False) -> DataFrame:
    """AGG11 and AGG12 in one pass.

    Each statistic becomes one row of totals (name NULL) plus one row per count; rows are summed per
    (id, identity, name) with map-side combine, and only those sums are gathered per id.
    """
    total = F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("bigint").alias("n"))
    counts = F.transform(
        F.map_entries(F.coalesce("custom_counts", F.create_map().cast(COUNTS))),
        lambda e: F.struct(e["key"].alias("name"), e["value"].cast("bigint").alias("n")),
    )
    own = F.col("_c.name").isNull()
    long = stats.select("strong_id", "decoder", "json_metadata", *METRICS, F.explode(F.concat(F.array(total), counts)).alias("_c")).select(
        "strong_id", "decoder", "json_metadata", "_c.name", "_c.n", *[F.when(own, F.col(m)).alias(m) for m in METRICS]
    )
    sums = _by_identity(long, ["name"], [*METRICS, "n"])
    per_name = sums.groupBy("strong_id", "name").agg(
        *[F.sum(m).alias(m) for m in (*METRICS, "n")],
        F.min("decoder").alias("decoder"), F.max("decoder").alias("_dec2"), F.min("json_metadata").alias("json_metadata"),
        F.min(_canonical("json_metadata")).alias("_c1"), F.max(_canonical("json_metadata")).alias("_c2"),
    )
    kept = F.when(F.col("name").isNotNull() & (F.col("n") > 0), F.struct("name", "n"))
    folded = per_name.groupBy("strong_id").agg(
        *[F.sum(m).alias(m) for m in METRICS],
        F.min("decoder").alias("decoder"), F.max("_dec2").alias("_dec2"),
        F.min("json_metadata").alias("json_metadata"), F.min("_c1").alias("_c1"), F.max("_c2").alias("_c2"),
        F.map_from_entries(F.array_sort(F.collect_list(kept))).alias("custom_counts"),
    )
    if strict:
        clash = (F.col("decoder") != F.col("_dec2")) | (F.col("_c1") != F.col("_c2"))
        message = F.concat(F.lit("conflicting identity under "), F.col("strong_id"))
        folded = folded.withColumn("decoder", F.when(clash, F.raise_error(message).cast("string")).otherwise(F.col("decoder")))
    return folded.select("strong_id", "decoder", "json_metadata", *METRICS, "custom_counts")


def stat_conflicts(stats: DataFrame) -> DataFrame:
    """Ids recorded with more than one decoder or metadata document (AGG13)."""
    differs = lambda c: F.min(_canonical(c)) != F.max(_canonical(c))
    return (
        stats.select("strong_id", "decoder", "json_metadata").distinct()
        .groupBy("strong_id")
        .agg(differs("decoder").alias("decoder_conflict"), differs("json_metadata").alias("metadata_conflict"))
        .filter("decoder_conflict OR metadata_conflict")
    )


def common_properties(stats: DataFrame) -> DataFrame:
    """Metadata keys holding one value in every statistic; a missing key counts as its own value (AGG14)."""
    total = stats.agg(F.count("*").alias("n")).scalar()
    pairs = stats.select(F.explode(F.from_json("json_metadata", "map<string,string>")).alias("key", "value"))
    own = pairs.groupBy("key").agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    common = own.filter((F.col("n") == total) & (F.col("lo") == F.col("hi"))).select("key", F.col("lo").alias("value"))
    decoder = stats.agg(F.min("decoder").alias("lo"), F.max("decoder").alias("hi")).filter("lo = hi")
    return common.filter("key <> 'decoder'").unionByName(decoder.select(F.lit("decoder").alias("key"), F.col("lo").alias("value")))


def filter_stats(stats: DataFrame, expr: str) -> DataFrame:
    """Keep statistics for which a SQL expression over decoder, strong_id and metadata ``m`` holds (FLT6)."""
    return stats.withColumn("m", F.parse_json("json_metadata")).filter(F.expr(expr)).drop("m")


def derive_columns(stats: DataFrame, **exprs: str) -> DataFrame:
    """Add x / group / failure-unit columns from SQL expressions over the statistic and ``m`` (FLT7, UDF3)."""
    return stats.withColumn("m", F.parse_json("json_metadata")).withColumns({k: F.expr(e) for k, e in exprs.items()}).drop("m")


def edit_stats(stats: DataFrame, **cols: Column | None) -> DataFrame:
    """Replace the given columns, keeping the old value where the new one is NULL (FLT8)."""
    return stats.withColumns({k: F.coalesce(c, F.col(k)) for k, c in cols.items() if c is not None})


def strip_custom_counts(stats: DataFrame) -> DataFrame:
    """Empty the custom counts (FLT13)."""
    return stats.withColumn("custom_counts", F.create_map().cast(COUNTS))


def validate_task_stats(stats: DataFrame) -> DataFrame:
    """One row per broken rule of a statistic (FLT15)."""
    rules = {
        "negative shots": F.col("shots") < 0,
        "negative errors": F.col("errors") < 0,
        "negative discards": F.col("discards") < 0,
        "negative seconds": F.col("seconds") < 0,
        "errors and discards exceed shots": F.col("shots") < F.col("errors") + F.col("discards"),
    }
    broken = F.filter(F.array(*[F.when(c, F.lit(r)) for r, c in rules.items()]), lambda r: r.isNotNull())
    return stats.select("strong_id", "seq", F.explode(broken).alias("rule"))


def append_stats(a: DataFrame, b: DataFrame, strict: bool = False) -> DataFrame:
    """Union of two sources, older ones possibly without counts, then folded (SET1)."""
    both = a.unionByName(b, allowMissingColumns=True)
    if "custom_counts" not in both.columns:
        both = strip_custom_counts(both)
    return fold_stats(both, strict)


def order_columns(by: str) -> dict[str, Column]:
    """Sort columns for combined statistics (SRT2)."""
    if by == "metadata":
        return {"_k0": txt.natural_sort_key(txt.canonical_json(F.col("json_metadata")))}
    if by == "preserve":
        return {"_k0": F.col("seq")}
    if by == "error":
        kept = F.col("shots") - F.col("discards")
        return {
            "_k0": F.when(kept == 0, F.lit(0.0)).otherwise(F.col("errors") / F.nullif(kept, F.lit(0))),
            "_k1": F.when(F.col("shots") == 0, F.lit(0.0)).otherwise(F.col("discards") / F.nullif(F.col("shots"), F.lit(0))),
        }
    raise ValueError(f"unknown order {by!r}")


def order_stats(stats: DataFrame, by: str, tie: Sequence[str] = ("strong_id",)) -> DataFrame:
    keys = order_columns(by)
    return stats.withColumns(keys).orderBy(*keys, *tie).drop(*keys)


def position_stats(stats: DataFrame, by: str, tie: Sequence[str] = ("strong_id",)) -> DataFrame:
    """The position each statistic takes under an order, as a column."""
    keys = order_columns(by)
    return global_index(stats.withColumns(keys), [*keys, *tie], "position").drop(*keys)


def split_custom_counts(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One statistic per count name: its errors become that count, its id and metadata say so (FN17)."""
    k = F.explode(F.array(*[F.lit(x) for x in keys]))
    doc = F.col("json_metadata")

    def added(name: str, value: Column) -> Column:
        absent = F.expr(f"variant_get(parse_json(json_metadata), '$.{name}') IS NULL")
        return F.when(absent, F.concat(F.lit(f',"{name}":'), value)).otherwise("")

    inner = F.regexp_replace(F.trim(doc), r"\}$", "")
    tail = F.concat(added("custom_error_count_key", txt.json_string(F.col("_key"))), added("original_error_count", F.col("errors").cast("string")))
    tail = F.when(F.trim(inner) == "{", F.regexp_replace(tail, "^,", "")).otherwise(tail)
    meta = F.when(F.trim(doc).startswith("{"), F.concat(inner, tail, F.lit("}"))).otherwise(doc)
    return stats.withColumn("_key", k).select(
        *[c for c in stats.columns if c not in ("strong_id", "json_metadata", "errors")],
        F.concat("strong_id", F.lit(":"), "_key").alias("strong_id"),
        meta.alias("json_metadata"),
        F.coalesce(F.try_element_at("custom_counts", F.col("_key")), F.lit(0)).cast("bigint").alias("errors"),
    )


def error_rate_points(stats: DataFrame, factor: float, pieces: Column | float = 1, values: Column | float = 1) -> DataFrame:
    """Likelihood interval of the error rate per piece; no best value where no error was seen (FN18)."""
    fit = num.fit_binomial(F.col("shots") - F.col("discards"), F.col("errors"), factor)
    return _rate_columns(stats.withColumn("_fit", fit), pieces, values).withColumn(
        "best", F.when(F.col("errors") > 0, F.col("best"))
    )


def discard_rate_points(stats: DataFrame, factor: float, pieces: Column | float = 1, values: Column | float = 1) -> DataFrame:
    """Likelihood interval of the discard rate per piece (FN18)."""
    fit = num.fit_binomial(F.col("shots"), F.col("discards"), factor)
    return _rate_columns(stats.withColumn("_fit", fit), pieces, values)


def _rate_columns(stats: DataFrame, pieces, values) -> DataFrame:
    ends = {e: num.piece_rate(F.col(f"_fit.{e}"), pieces, values) for e in ("low", "best", "high")}
    return stats.withColumns(ends).drop("_fit")


def group_stats(stats: DataFrame, key: Sequence[str], x: str) -> DataFrame:
    """Curves: how many points each group holds, and the ends of its x range (AGG19)."""
    return stats.groupBy(*key).agg(F.count("*").alias("n_points"), F.min(x).alias("x_min"), F.max(x).alias("x_max"))


def axis_range(
    points: DataFrame, cols: Sequence[str], default: tuple[float, float],
    forced_min: float | None = None, forced_max: float | None = None, positive: bool = False,
) -> DataFrame:
    """Smallest and largest plotted value with defaults and forced bounds (AGG20)."""
    def usable(c: str) -> Column:
        ok = F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        return F.when(ok & (F.col(c) > 0) if positive else ok, F.col(c).cast("double"))

    vs = [usable(c) for c in cols]
    lo = F.min(F.least(*vs) if len(vs) > 1 else vs[0])
    hi = F.max(F.greatest(*vs) if len(vs) > 1 else vs[0])
    low, high = F.coalesce(lo, F.lit(float(default[0]))), F.coalesce(hi, F.lit(float(default[1])))
    if forced_min is not None:
        low, high = F.lit(float(forced_min)), F.greatest(F.lit(float(forced_min)), high)
    if forced_max is not None:
        low, high = F.least(low, F.lit(float(forced_max))), F.lit(float(forced_max))
    return points.agg(low.alias("min_v"), high.alias("max_v"))


def rank_curves(groups: DataFrame, col: str, n_markers: int, n_styles: int) -> DataFrame:
    """Color, marker and line-style numbers of the curves in natural order (WIN9)."""
    keyed = groups.select(col).distinct().withColumn("_k", txt.natural_sort_key(F.col(col)))
    return global_index(keyed, ["_k", col], "color").select(
        col, F.col("color"), (F.col("color") % n_markers).alias("marker"), (F.col("color") % n_styles).alias("linestyle")
    )


def curve_table(points: DataFrame, group: Sequence[str], x: str, label: str | None = None) -> DataFrame:
    """Plot-ready points: x, low / best / high, and where the point's label goes (FN19)."""
    band = F.col("low").isNotNull() & F.col("high").isNotNull()
    out = points.select(
        *group, F.col(x).alias("x"), "best",
        F.when(band, F.col("low")).alias("low"), F.when(band, F.col("high")).alias("high"),
        *( [F.col(label).alias("label"), F.coalesce("best", "high", "low").alias("label_y")] if label else [] ),
    )
    return out


def line_fit_curves(points: DataFrame, group: Sequence[str], x_scale: str, y_scale: str, n: int = 1000) -> DataFrame:
    """Least-squares line per curve on rescaled axes, extended tenfold both ways and sampled at ``n`` points (FN20)."""
    usable = points.filter("best IS NOT NULL AND NOT isnan(best)")
    # What has no place on the axis, such as 0 on a logarithmic one, takes no part in the fit.
    xs, ys = (F.when(F.abs(c) < float("inf"), c) for c in (num.rescale(F.col("x"), x_scale), num.rescale(F.col("best"), y_scale)))
    fits = (
        usable.withColumns({"_x": xs, "_y": ys})
        .groupBy(*group)
        .agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.min("_x").alias("a"), F.max("_x").alias("b"))
        .filter("a < b")
    )
    start = F.col("a") - 10 * (F.col("b") - F.col("a"))
    if x_scale == "sqrt":
        start = F.when((start < 0) & (F.col("a") >= 0), F.lit(0.0)).otherwise(start)
    stop = F.col("b") + 10 * (F.col("b") - F.col("a"))
    at = F.col("start") + F.col("i") * ((F.col("stop") - F.col("start")) / (n - 1))
    line = (
        fits.withColumns({"start": start, "stop": stop})
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .withColumn("_x", at)
        .withColumn("_y", F.col("_x") * F.col("slope") + F.col("intercept"))
    )
    return line.select(*group, "i", num.rescale(F.col("_x"), x_scale, True).alias("x"), num.rescale(F.col("_y"), y_scale, True).alias("y"))


def preprocess(stats: DataFrame, fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """User hook over the whole statistics table, folded again afterwards (UDF4)."""
    return fold_stats(stats.transform(fn))


def pending_tasks(tasks: DataFrame, existing: DataFrame, error_key: str | None = None) -> DataFrame:
    """Shots and errors still to collect per task; finished tasks are dropped (JN8).

    With ``error_key`` that custom count stands for the errors; a task without it has none.
    """
    errors = F.col("errors") if error_key is None else F.coalesce(F.try_element_at("custom_counts", F.lit(error_key)), F.lit(0))
    have = existing.select("strong_id", F.col("shots").alias("_s"), errors.alias("_e"))
    twice = F.count("*") > 1
    one = tasks.groupBy("strong_id").agg(
        F.when(twice, F.raise_error(F.concat(F.lit("task given twice: "), F.col("strong_id"))).cast("bigint"))
        .otherwise(F.first("max_shots")).alias("max_shots"),
        F.first("max_errors").alias("max_errors"),
    )
    left = one.join(have, "strong_id", "left").select(
        "strong_id",
        (F.col("max_shots") - F.coalesce("_s", F.lit(0))).alias("shots_left"),
        (F.least(F.coalesce("max_errors", "max_shots"), "max_shots") - F.coalesce("_e", F.lit(0))).alias("errors_left"),
    )
    return left.filter("shots_left > 0 AND errors_left > 0")


def expand_tasks(tasks: DataFrame, decoders: Sequence[str]) -> DataFrame:
    """One task per requested decoder, unless the task names its own (JN9)."""
    wanted = F.array(*[F.lit(d) for d in decoders])
    return tasks.withColumn("decoder", F.explode(F.when(F.col("decoder").isNull(), wanted).otherwise(F.array("decoder"))))


def progress_eta(tasks: DataFrame, totals: DataFrame, workers: int = 1) -> DataFrame:
    """Remaining shots and errors and the minutes left by the quicker of the two projections (WIN10)."""
    joined = tasks.join(totals.select("strong_id", "shots", "errors", "seconds"), "strong_id", "left").fillna(
        0, ["shots", "errors", "seconds"]
    )
    by_shots = F.when((F.col("shots") > 0) & (F.col("seconds") > 0), (F.col("max_shots") - F.col("shots")) * F.col("seconds") / F.nullif("shots", F.lit(0)))
    by_errors = F.when((F.col("errors") > 0) & (F.col("seconds") > 0), (F.col("max_errors") - F.col("errors")) * F.col("seconds") / F.nullif("errors", F.lit(0)))
    return joined.select(
        "strong_id",
        F.coalesce(F.col("max_shots") - F.col("shots"), F.col("shots")).alias("shots_left"),
        F.coalesce(F.col("max_errors") - F.col("errors"), F.col("errors")).alias("errors_left"),
        (F.least(by_shots, by_errors) / 60 / workers).alias("minutes_left"),
    )


def first_rows(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The first row of every key in the given order (WIN8), kept by a combinable minimum instead of a sort."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*key, "_r.*")
