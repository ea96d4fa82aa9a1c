"""String and JSON column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def natural_sort_key(s: Column) -> Column:
    """Sort key under which digit runs compare as numbers and dotted runs as lists of numbers (SRT1)."""
    terms = F.regexp_extract_all(F.coalesce(s, F.lit("None")), F.lit("([0-9.]+|[^0-9.]+)"), F.lit(1))

    def term(t: Column) -> Column:
        number = t.try_cast("double")
        parts = F.transform(F.split(t, r"\."), lambda e: e.try_cast("double"))
        dotted = number.isNull() & t.rlike(r"^[0-9]+(\.[0-9]+)+$")
        return F.struct(
            F.when(number.isNotNull(), 0).when(dotted, 1).otherwise(2).alias("rank"),
            F.coalesce(number, F.lit(0.0)).alias("number"),
            F.when(dotted, parts).otherwise(F.array().cast("array<double>")).alias("parts"),
            F.when(number.isNull() & ~dotted, t).otherwise("").alias("text"),
        )

    return F.transform(terms, term)


def json_string(s: Column) -> Column:
    """JSON literal of a string with non-ASCII characters as \\u escapes."""
    arr = F.to_json(F.array(s))
    quoted = F.substring(arr, F.lit(2), F.length(arr) - 2)

    def hex4(n: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escape(c: Column) -> Column:
        code = F.ascii(c).cast("long")
        over = code - 65536
        pair = F.concat(hex4(F.lit(55296) + F.shiftright(over, 10)), hex4(F.lit(56320) + over.bitwiseAND(F.lit(1023).cast("long"))))
        return F.when(code < 128, c).when(code < 65536, hex4(code)).otherwise(pair)

    plain = F.array_join(F.transform(F.split(quoted, ""), escape), "")
    return F.when(s.isNull(), "null").when(quoted.rlike("[^\\x00-\\x7F]"), plain).otherwise(quoted)


def json_spaced(doc: Column) -> Column:
    """Compact JSON text with a blank after every comma and colon outside strings."""
    tokens = F.regexp_extract_all(doc, F.lit(r'("(?:[^"\\]|\\.)*"|[,:]|[^",:]+)'), F.lit(1))
    return F.array_join(
        F.transform(tokens, lambda t: F.when(t == ",", ", ").when(t == ":", ": ").otherwise(F.when(t.startswith('"'), t).otherwise(F.trim(t)))), ""
    )


def canonical_json(doc: Column) -> Column:
    """JSON text with sorted keys, no blanks and normalised numbers: equal documents give equal text."""
    return F.to_json(F.parse_json(doc))


def json_equal(a: Column, b: Column) -> Column:
    """Structural equality of two JSON texts (FN16)."""
    return canonical_json(a).eqNullSafe(canonical_json(b))


def key_values_from_path(path: Column, strict: bool = True) -> Column:
    """Typed JSON metadata from a file name such as ``runs/size=7,rate=0.25,kind=memory.txt`` (FN9).

    Malformed names raise, or give NULL when not strict.
    """
    file = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    terms = F.split(stem, ",")
    ok = F.forall(terms, lambda t: F.size(F.split(t, "=")) == 2)

    def value(v: Column) -> Column:
        as_int, as_num = v.try_cast("bigint"), v.try_cast("double")
        return F.when(as_int.isNotNull() & v.rlike(r"^\s*[+-]?[0-9]+\s*$"), as_int.cast("string")).when(
            as_num.isNotNull() & v.rlike(r"^\s*[+-]?[0-9.]+([eE][+-]?[0-9]+)?\s*$"), as_num.cast("string")
        ).otherwise(json_string(v))

    body = F.array_join(
        F.transform(terms, lambda t: F.concat(json_string(F.split(t, "=")[0]), F.lit(":"), value(F.get(F.split(t, "="), F.lit(1))))), ","
    )
    bad = F.raise_error(F.concat(F.lit("expected comma-separated key=value terms in "), path)) if strict else F.lit(None)
    return F.when(ok, F.concat(F.lit("{"), body, F.lit("}"))).otherwise(bad.cast("string"))


def strong_id(
    circuit: Column, decoder: Column, model: Column, mask: Column, json_metadata: Column, obs_mask: Column | None = None
) -> Column:
    """sha256 of the task's identity document (FN10). Masks are arrays of bytes, metadata is JSON text."""

    def number_list(a: Column) -> Column:
        items = F.array_join(F.transform(a, lambda e: e.cast("string")), ", ")
        return F.when(a.isNull(), "null").otherwise(F.concat(F.lit("["), items, F.lit("]")))

    fields = [
        ("circuit", json_string(circuit)),
        ("decoder", json_string(decoder)),
        ("decoder_error_model", json_string(model)),
        ("postselection_mask", number_list(mask)),
        ("json_metadata", F.coalesce(json_spaced(json_metadata), F.lit("null"))),
    ]
    parts = []
    for i, (name, text) in enumerate(fields):
        parts += [F.lit(("{" if i == 0 else ", ") + f'"{name}": '), text]
    if obs_mask is not None:
        tail = F.concat(F.lit(', "postselected_observables_mask": '), number_list(obs_mask))
        parts.append(F.when(obs_mask.isNotNull(), tail).otherwise(""))
    return F.sha2(F.concat(*parts, F.lit("}")), 256)
