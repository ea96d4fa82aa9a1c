"""Chat formatting by quotation linking, in DataFrame functions only.

A line's quote level is the number of ``>`` among the marks it begins with; lines of one level in a row form a passage.
Quoted passages are normalised (marks off, lower case, blanks run together), hashed and joined, within their conversation, to the
first message whose own words, taken whole, by paragraph or by line, have that hash and that stands before them. Passages of several
lines that match none of these go to the first message before them whose own words hold the same lines one after another: hashes
of all its runs of as many lines are joined, for the lengths that its conversation lacks. Empty lines and quotes between a message's
own lines do not count; a line that was wrapped anew or trimmed within is another line. A message answers the latest such original of its shallowest quotes. Conversations come out message by message in reply order: threads by
their first turn, and inside a thread by turn, so each answer follows what it answers; quotes are gone from the text.

One row comes out for each row in. Null text counts as empty. Rows without conv_id or turn answer nothing and are not quoted;
the former are numbered together. Of rows that repeat (conv_id, turn), each is linked for itself and an answer names the turn.
Quotes that match nothing stay out of the text all the same. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..ordered import global_index


def _marks(line: Column) -> Column:
    return F.regexp_extract(line, r"^[> \t]*", 0)


def level(line: Column) -> Column:
    marks = _marks(line)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def bare(line: Column) -> Column:
    return F.when(level(line) > 0, F.substr(line, F.length(_marks(line)) + 1)).otherwise(line)


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n\f]+", " "))


def lines(text: Column) -> Column:
    """(level, bare text) of each line."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.struct(level(x).alias("level"), bare(x).alias("line")))


def passages(parsed: Column) -> Column:
    """(level, text) of each run of lines of one level."""
    n = F.size(parsed)
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get(parsed, i)["level"] != F.get(parsed, i - 1)["level"]))
    return F.transform(
        starts,
        lambda s, j: F.struct(
            F.get(parsed, s)["level"].alias("level"),
            F.array_join(F.slice(parsed["line"], s + 1, F.coalesce(F.get(starts, j + 1), n) - s), "\n").alias("text"),
        ),
    )


def said(text: Column) -> Column:
    """The normalised lines that are not empty."""
    return F.filter(F.transform(F.split(text, "\n", -1), normal), lambda x: x != "")


def windows(hashes: Column, n: Column) -> Column:
    """One hash for every run of ``n`` (2 or more) of these hashes, from those of the two longest powers of two that cover it."""
    span = lambda w: F.size(hashes) - F.size(w) + 1
    pairs = lambda w, step, last: F.transform(F.sequence(F.lit(0), last), lambda i: F.md5(F.concat(F.get(w, i), F.get(w, i + step))))
    return F.aggregate(
        F.sequence(F.lit(1), F.length(F.bin(n)) - 1), hashes,
        lambda w, _: pairs(w, span(w), F.size(w) - span(w) - 1), lambda w: pairs(w, n - span(w), F.size(hashes) - n),
    )


def own_text(parsed: Column) -> Column:
    """The lines that quote nothing, without empty lines at either end."""
    kept = F.array_join(F.filter(parsed, lambda x: x["level"] == 0)["line"], "\n")
    return F.regexp_replace(kept, r"^[\r\n]+|[\r\n]+$", "")


def _by_lines(messages: DataFrame, missed: DataFrame) -> DataFrame:
    """(row, conv_id, turn, level, origin) of passages whose lines an earlier message holds one after another.

    Rows are a conversation's lines times the lengths missed in it; equal runs collapse before they move, so a hot line makes no pairs.
    """
    lengths = missed.groupBy("conv_id").agg(F.collect_set("n").alias("lengths"))
    bodies = messages.select("conv_id", "turn", F.transform(said(F.col("text")), F.md5).alias("lines")).join(lengths, "conv_id")
    runs = bodies.select("conv_id", "turn", "lines", F.explode("lengths").alias("n")).filter("size(lines) >= n")
    held = runs.select("conv_id", "turn", "n", F.explode(windows(F.col("lines"), F.col("n"))).alias("w")).groupBy("conv_id", "n", "w").agg(F.min("turn").alias("origin"))
    return missed.join(held, ["conv_id", "n", "w"]).filter("origin < turn").select("row", "conv_id", "turn", "level", "origin")


def _roots(answers: DataFrame) -> DataFrame:
    """(conv_id, turn, root, depth) of turns that answer another, by doubling the steps towards the first turn."""
    state = cut(answers.select("conv_id", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth")), "roots")
    while True:
        up = state.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"))
        after = cut(state.join(up, ["conv_id", "root"], "left"), "roots")
        state = after.select("conv_id", "turn", F.coalesce("further", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if after.filter("further IS NOT NULL").isEmpty():
            return state


def link(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, parent_turn, root_turn, depth, position, n_quotes, n_linked) of every message."""
    parsed = conversations.select("conv_id", "turn", "role", F.monotonically_increasing_id().alias("row"), lines(F.col("text")).alias("lines"))
    runs = F.transform(F.filter(passages(F.col("lines")), lambda p: p["level"] > 0), lambda p: F.struct(p["level"].alias("level"), said(p["text"]).alias("lines")))
    messages = cut(parsed.select("conv_id", "turn", "role", "row", own_text(F.col("lines")).alias("text"), F.filter(runs, lambda p: F.size(p["lines"]) > 0).alias("quotes")), "messages")
    quotes = messages.select("row", "conv_id", "turn", F.explode("quotes").alias("q")).select(
        "row", "conv_id", "turn", "q.level", F.md5(F.array_join("q.lines", " ")).alias("h"), F.size("q.lines").alias("n"), F.transform("q.lines", F.md5).alias("lines")
    )
    quotes = quotes.select("row", "conv_id", "turn", "level", "h", "n", F.when(F.col("n") > 1, F.get(windows(F.col("lines"), F.col("n")), F.lit(0))).alias("w"))
    parts = F.concat(F.array("text"), F.split("text", r"\n[ \t\r]*\n", -1), F.split("text", "\n", -1))
    hashes = F.array_distinct(F.transform(F.filter(F.transform(parts, normal), lambda x: x != ""), lambda x: F.md5(x)))
    quoting = quotes.select("conv_id").distinct()
    origins = messages.join(quoting, "conv_id", "left_semi").select("conv_id", "turn", F.explode(hashes).alias("h")).groupBy("conv_id", "h").agg(F.min("turn").alias("origin"))
    found = quotes.join(origins, ["conv_id", "h"], "left").select("row", "conv_id", "turn", "level", "n", "w", F.expr("CASE WHEN origin < turn THEN origin END").alias("origin"))
    found = cut(found, "quotes")
    linked = found.filter("origin IS NOT NULL").drop("n", "w").unionByName(_by_lines(messages, found.filter("origin IS NULL AND n > 1").drop("origin")))
    answers = cut(
        linked.groupBy("row", "conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "origin"))["origin"].alias("parent"), F.count("*").alias("n_linked")), "answers"
    )
    up = _roots(answers.groupBy("conv_id", "turn").agg(F.max("parent").alias("parent")))
    placed = messages.join(answers.select("row", "parent", "n_linked"), "row", "left").join(up, ["conv_id", "turn"], "left")
    placed = placed.select(
        "conv_id", "turn", "role", "text", "row", F.col("parent").alias("parent_turn"), F.coalesce("root", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.size("quotes").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
    )
    numbered = global_index(placed, ["conv_id", "root_turn", "turn", "row"], "place")
    first = numbered.groupBy(F.col("conv_id").alias("c")).agg(F.min("place").alias("first"))
    return numbered.join(first, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", "turn", "role", "text", "parent_turn", "root_turn", "depth", (F.col("place") - F.col("first")).alias("position"), "n_quotes", F.col("n_linked").cast("long").alias("n_linked")
    )
