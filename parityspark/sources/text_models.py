"""Error-model and circuit text as instruction rows, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# name, optional [tag], optional (arguments), targets up to a comment; or a closing brace.
_LINE = r"^\s*([A-Za-z][A-Za-z0-9_]*|\})\s*(?:\[([^\]]*)\])?\s*(?:\(([^)]*)\))?\s*([^#]*)"
# Tag escapes and what they stand for; the backslash is undone last.
_TAG_ESCAPES = [("\\n", "\n"), ("\\r", "\r"), ("\\C", "]"), ("\\B", "\\")]


def unescape_tag(tag: Column) -> Column:
    for mark, char in _TAG_ESCAPES:
        tag = F.replace(tag, F.lit(mark), F.lit(char))
    return tag


def escape_tag(tag: Column) -> Column:
    for mark, char in reversed(_TAG_ESCAPES):
        tag = F.replace(tag, F.lit(char), F.lit(mark))
    return tag


def _numbers(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ","), lambda a: F.trim(a) != ""), lambda a: F.trim(a).cast("double"))


def _parse(lines: DataFrame, key: str, upper: bool) -> DataFrame:
    part = lambda i: F.regexp_extract("line", _LINE, i).alias(f"_p{i}")
    blank = F.trim(F.regexp_replace("line", "#.*$", "")) == ""
    # Each part is cut out once, however often the columns below name it.
    parts = lines.filter(~blank).select(key, "seq", "line", *[part(i) for i in range(1, 5)])
    part = lambda i: F.col(f"_p{i}")
    name = F.upper(part(1)) if upper else F.lower(part(1))
    words = F.filter(F.split(F.trim(part(4)), r"\s+"), lambda t: t != "")
    repeat = F.lower(part(1)) == "repeat"
    known = F.when(part(1) == "", F.raise_error(F.concat(F.lit("cannot read line: "), "line")).cast("string")).otherwise(name)
    return parts.select(
        key,
        "seq",
        known.alias("name"),
        unescape_tag(part(2)).alias("tag"),
        _numbers(part(3)).alias("args"),
        F.when(repeat, F.array().cast("array<string>")).otherwise(words).alias("targets"),
        F.when(repeat, F.get(words, F.lit(0)).cast("bigint")).alias("reps"),
    )


def read_model_text(lines: DataFrame) -> DataFrame:
    """Instruction rows of error-model text lines(model_id, seq, line) (SRC7). Names are case-insensitive."""
    return _parse(lines, "model_id", upper=False)


def read_circuit_text(lines: DataFrame) -> DataFrame:
    """Instruction rows of circuit text lines(circuit_id, seq, line) (SRC8)."""
    return _parse(lines, "circuit_id", upper=True)


def number_text(x: Column) -> Column:
    """Shortest decimal text, whole numbers without a point."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def instruction_lines(instr: DataFrame) -> DataFrame:
    """Text line of every instruction row."""
    tag = F.when(F.col("tag") != "", F.concat(F.lit("["), escape_tag(F.col("tag")), F.lit("]"))).otherwise("")
    args = F.when(F.size("args") > 0, F.concat(F.lit("("), F.array_join(F.transform("args", number_text), ", "), F.lit(")"))).otherwise("")
    tail = F.when(F.col("reps").isNotNull(), F.concat(F.lit(" "), F.col("reps").cast("string"), F.lit(" {"))).when(
        F.size("targets") > 0, F.concat(F.lit(" "), F.array_join("targets", " "))
    ).otherwise("")
    return instr.withColumn("line", F.concat("name", tag, args, tail))


def model_text(errors: DataFrame, targets: DataFrame, detectors: DataFrame | None = None) -> DataFrame:
    """Flattened model tables as text lines: errors first, then detector declarations (SNK5).

    Components of an error are separated by ``^`` in the order of their numbers.
    """
    sign = F.array_join(F.transform(F.array_sort("_t"), lambda t: F.concat(t["kind"], t["idx"].cast("string"))), " ")
    comps = targets.groupBy("err_id", "comp").agg(F.collect_list(F.struct("kind", "idx")).alias("_t")).withColumn("_s", sign)
    whole = comps.groupBy("err_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("comp", "_s"))), lambda c: c["_s"]), " ^ ").alias("_s")
    )
    tag = F.when(F.col("tag") != "", F.concat(F.lit("["), escape_tag(F.col("tag")), F.lit("]"))).otherwise("")
    out = errors.join(whole, "err_id", "left").select(
        F.lit(0).alias("section"), F.col("err_id").alias("seq"),
        F.concat(F.lit("error"), tag, F.lit("("), number_text(F.col("p")), F.lit(")"), F.coalesce(F.concat(F.lit(" "), "_s"), F.lit(""))).alias("line"),
    )
    if detectors is not None:
        coords = F.concat(F.lit("("), F.array_join(F.transform("coords", number_text), ", "), F.lit(")"))
        out = out.unionByName(detectors.select(
            F.lit(1).alias("section"), F.col("det").cast("bigint").alias("seq"),
            F.concat(F.lit("detector"), F.when(F.size("coords") > 0, coords).otherwise(""), F.lit(" D"), F.col("det").cast("string")).alias("line"),
        ))
    return out
