"""Task statistics as CSV files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import fixed_text
from ..functions.text import canonical_json
from ..operators.stats import COUNTS, fold_stats

# The file's column order and the widths of its right-aligned columns.
COLUMNS = ["shots", "errors", "discards", "seconds", "decoder", "strong_id", "json_metadata", "custom_counts"]
WIDTHS = {"shots": 10, "errors": 10, "discards": 10, "seconds": 8}


def parse_counts(c: Column) -> Column:
    """Counts column text (empty, or a JSON object of integers) to a map."""
    return F.coalesce(F.from_json(F.nullif(F.trim(c), F.lit("")), COUNTS, {"mode": "FAILFAST"}), F.create_map().cast(COUNTS))


def _typed(raw: DataFrame) -> DataFrame:
    named = raw.toDF(*[c.strip() for c in raw.columns])
    missing = set(COLUMNS[:-1]) - set(named.columns)
    if missing:
        raise ValueError(f"statistics file lacks the columns {sorted(missing)}; it has {sorted(named.columns)}")
    counts = parse_counts(F.col("custom_counts")) if "custom_counts" in named.columns else F.create_map().cast(COUNTS)
    return named.select(
        *[F.trim(c).cast("bigint").alias(c) for c in ("shots", "errors", "discards")],
        F.trim("seconds").cast("double").alias("seconds"),
        F.coalesce("decoder", F.lit("")).alias("decoder"),
        F.coalesce("strong_id", F.lit("")).alias("strong_id"),
        "json_metadata",
        counts.alias("custom_counts"),
    )


def read_stat_rows(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Unfolded rows of statistics files; each path has its own header, so old files may lack the counts column."""
    out = None
    for path in paths:
        raw = spark.read.csv(
            path, header=True, quote='"', escape='"', multiLine=False,
            ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=False, inferSchema=False,
        )
        typed = _typed(raw)
        out = typed if out is None else out.unionByName(typed)
    return out


def read_task_stats(spark: SparkSession, paths: Sequence[str], strict: bool = False) -> DataFrame:
    """Statistics of all files, folded per strong id (SRC9)."""
    return fold_stats(read_stat_rows(spark, paths), strict)


def seconds_text(s: Column) -> Column:
    return F.when(s < 1, fixed_text(s, 3)).when(s < 10, fixed_text(s, 2)).otherwise(fixed_text(s, 1))


def _text_columns(stats: DataFrame) -> dict[str, Column]:
    counts = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("custom_counts"))))
    out = {c: F.lpad(F.col(c).cast("string"), F.greatest(F.lit(WIDTHS[c]), F.length(F.col(c).cast("string"))), F.lit(" ")) for c in ("shots", "errors", "discards")}
    sec = seconds_text(F.col("seconds"))
    out["seconds"] = F.lpad(sec, F.greatest(F.lit(WIDTHS["seconds"]), F.length(sec)), F.lit(" "))
    out["decoder"], out["strong_id"] = F.col("decoder"), F.col("strong_id")
    out["json_metadata"] = canonical_json(F.col("json_metadata"))
    out["custom_counts"] = F.when(F.size("custom_counts") > 0, counts).otherwise("")
    return out


def stat_lines(stats: DataFrame) -> DataFrame:
    """The text line of each statistic."""
    def quoted(c: Column) -> Column:
        return F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    cols = _text_columns(stats)
    return stats.select(F.concat_ws(",", *[cols[c] if c in WIDTHS else quoted(cols[c]) for c in COLUMNS]).alias("line"))


def write_task_stats(stats: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write statistics files: fixed column order, aligned numbers, sorted JSON keys (SNK4)."""
    cols = _text_columns(stats)
    named = stats.select(*[cols[c].alias(c.rjust(WIDTHS.get(c, 0))) for c in COLUMNS])
    named.write.mode(mode).csv(
        path, header=True, quote='"', escape='"', emptyValue="", nullValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def append_or_create_stats(path: str, stats: DataFrame) -> DataFrame:
    """Append to a statistics folder, or start one; returns its folded content (SNK6)."""
    write_task_stats(stats, path, mode="append")
    return read_task_stats(stats.sparkSession, [path])
