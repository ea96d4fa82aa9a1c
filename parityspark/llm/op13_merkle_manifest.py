"""Merkle manifest of a data set: a leaf per document, a binary tree per group of documents, a tree over the groups.

Leaf coordinates come from bitmap ranks, not from sorting the leaves. Every task turns its doc_ids into 64-bit words of a bitmap and keeps the
words that are not zero; partial bitmaps of a group are merged by OR. A popcount directory holds, for every word, the number of
leaves before it (only this directory is put in order). A leaf's slot is its word's entry plus the popcount of the word's bits
below its own. Words that hold a doc_id twice, or rows without doc_id, have more rows than bits; their rows alone are
ordered, by doc_id (null first) and leaf, by range partitions, so that no id's rows meet in one task.

Slots are dealt in arrays of 2 ** LEVELS by slot; one task reduces an array by LEVELS levels at once, so that a tree of any size takes a few rounds,
each on a table that is 2 ** LEVELS times smaller. On the way back every array receives the path above its root and hands out the
paths of its members.

Nulls in any column have an encoding of their own. Rows with null or repeated doc_id are leaves of their own. A long text is hashed whole. Extra columns are
not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..ordered import global_index, running_sums
from ..shipping import ship

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 10
#: Word number of rows without doc_id, below that of every 64-bit doc_id.
NO_ID = -(2**57) - 1


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[encoded(columns[c]) for c in FIELDS]).cast("binary"), 256))


def group_key(value: Column) -> Column:
    """Order of groups: null first, then by bytes."""
    return F.coalesce(F.concat(F.lit("="), value), F.lit(""))


# --- coordinates ----------------------------------------------------------------------------------------------------


def word_of(doc_id: Column) -> Column:
    return F.coalesce(F.shiftright(doc_id, 6), F.lit(NO_ID))


def shifted(value: int, doc_id: Column) -> Column:
    """``value`` shifted by the id's place in its word; negative ids have theirs modulo 64 too."""
    return F.call_function("shiftleft", F.lit(value).cast("long"), doc_id.bitwiseAND(F.lit(63)).cast("int"))


def directory(rows: DataFrame) -> DataFrame:
    """(tree, word, bits, n, before): merged bitmap words of each tree, their rows, and the rows in words before."""
    words = rows.groupBy("tree", word_of(F.col("doc_id")).alias("word")).agg(F.coalesce(F.bit_or(shifted(1, F.col("doc_id"))), F.lit(0)).alias("bits"), F.count("*").alias("n"))
    return running_sums(cut(words, "words"), ["tree"], ["word"], {"before": F.col("n")}, fits=False)


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (tree, doc_id, leaf, ...) with ``slot``, their place among the leaves of their tree."""
    index = cut(directory(rows), "directory")
    found = rows.withColumn("word", word_of(F.col("doc_id"))).join(index, ["tree", "word"])
    single = F.bit_count("bits") == F.col("n")
    below = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(shifted(-1, F.col("doc_id")))))
    plain = found.filter(single).select(*rows.columns, (F.col("before") + below).alias("slot"))
    # Positions in the order of all tied rows; a word's first one stands at the word's entry.
    tied = cut(global_index(found.filter(~single), ["tree", "word", "doc_id", "leaf", "row"], "place"), "tied")
    first = tied.groupBy("tree", "word").agg(F.min("place").alias("start"))
    tied = tied.join(first, ["tree", "word"]).select(*rows.columns, (F.col("before") + F.col("place") - F.col("start")).alias("slot"))
    return plain.unionByName(tied)


# --- levels ---------------------------------------------------------------------------------------------------------


def height(n: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    return max(n - 1, 0).bit_length()


def parent(run: list[bytes]) -> bytes:
    return hashlib.sha256("".join(x.hex() for x in run).encode()).digest()


def tower(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """``nodes`` and the levels above them."""
    out = [nodes]
    for _ in range(levels):
        out.append([parent(out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(levels: list[list[bytes]], slot: int) -> list[bytes]:
    """For each level below the top: one byte for the side (0 none, 1 before, 2 after), then the sibling if there is one."""
    out = []
    for nodes in levels[:-1]:
        other = slot ^ 1
        out.append(b"\0" if other >= len(nodes) else bytes([1 if other < slot else 2]) + nodes[other])
        slot >>= 1
    return out


def path_steps(path: bytes):
    i = 0
    while i < len(path):
        side = path[i]
        yield side, path[i + 1 : i + 33] if side else b""
        i += 33 if side else 1


def fold(node: bytes, path: bytes) -> bytes:
    for side, other in path_steps(path):
        node = parent([node] if not side else [other, node] if side == 1 else [node, other])
    return node


def proof(path: bytes) -> str:
    return hashlib.sha256("".join(other.hex() for _, other in path_steps(path)).encode()).hexdigest()


def _levels(frame: pd.DataFrame, levels: int) -> list[list[bytes]]:
    n = int(frame["n"].iloc[0])
    return tower([bytes(x) for x in frame["node"]], min(levels, height(n)))


def array_of(levels: int) -> Column:
    return F.shiftright("slot", levels).alias("array")


def climb(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Written tables (tree, slot, node, n) of every ``levels``-th level, from (tree, slot, node, n = nodes of the tree) up to one node a tree."""
    ship(nodes.sparkSession)

    def reduce(frame):
        frame = frame.sort_values("slot")
        top = _levels(frame, levels)[-1]
        n, array = int(frame["n"].iloc[0]), int(frame["slot"].iloc[0]) >> levels
        return pd.DataFrame({"tree": [frame["tree"].iloc[0]], "slot": [array], "node": [top[0]], "n": [-(-n >> levels) if n > 1 << levels else 1]})

    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        above = out[-1].select("tree", "slot", "node", "n").groupBy("tree", array_of(levels)).applyInPandas(lambda f: reduce(f), "tree string, slot long, node binary, n long")
        out.append(cut(above, "level"))
    return out


def descend(levels_up: list[DataFrame], tops: DataFrame, schema: str, last, levels: int = LEVELS) -> DataFrame:
    """Hand the paths ``tops`` (tree, slot, path) down through the tables of ``climb``; ``last(frame, paths)`` makes the rows of the lowest."""

    def members(frame, above):
        frame = frame.sort_values("slot")
        tower_, rest = _levels(frame, levels), bytes(above["path"].iloc[0])
        start = int(frame["slot"].iloc[0]) >> levels << levels
        return frame, [b"".join(siblings(tower_, int(s) - start)) + rest for s in frame["slot"]]

    def step(frame, above):
        frame, paths = members(frame, above)
        return pd.DataFrame({"tree": frame["tree"], "slot": frame["slot"], "path": paths})

    def final(frame, above):
        return last(*members(frame, above))

    paths = tops
    for nodes in reversed(levels_up[1:-1]):
        paths = cut(_beside(nodes.select("tree", "slot", "node", "n"), paths, levels).applyInPandas(step, "tree string, slot long, path binary"), "paths")
    return _beside(levels_up[0], paths, levels).applyInPandas(final, schema)


def _beside(nodes: DataFrame, paths: DataFrame, levels: int):
    return nodes.groupBy("tree", array_of(levels)).cogroup(paths.groupBy("tree", F.col("slot").alias("array")))


# --- manifest -------------------------------------------------------------------------------------------------------


def leaves(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """(tree, doc_id, leaf, tampered): ``changed`` takes the place of n_chars in the tampered leaf, null where it is null."""
    columns = {c: F.col(c) for c in FIELDS}
    changed = F.lit(None).cast("long") if changed is None else changed
    tampered = F.when(changed.isNotNull(), leaf(columns | {"n_chars": changed}))
    return docs.select(group_key(F.col("lang")).alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(columns).alias("leaf"), tampered.alias("tampered"))


def manifest(docs: DataFrame, changed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, folded_root, verified, proof_sha256) of every row; digests are binary.

    ``path`` is the leaf's audit path (see ``siblings``); it is folded with the tampered leaf where there is one.
    """
    rows = cut(leaves(docs, changed).withColumn("row", F.monotonically_increasing_id()), "leaves")
    sizes = cut(rows.groupBy("tree").agg(F.count("*").alias("n")), "sizes")
    nodes = cut(placed(rows).join(sizes, "tree").withColumnRenamed("leaf", "node"), "nodes")
    up = climb(nodes, levels)
    subroots = cut(global_index(up[-1].select(F.col("tree").alias("group"), F.col("node")), ["group"], "slot"), "subroots")
    groups = cut(subroots.select(F.lit("").alias("tree"), "slot", "node", F.lit(subroots.count()).cast("long").alias("n"), "group"), "groups")
    over = climb(groups, levels)
    top = over[-1].select("tree", "slot", F.lit(b"").alias("path"))

    def of_group(frame, paths):
        roots = [fold(bytes(x), p) for x, p in zip(frame["node"], paths, strict=True)]
        return pd.DataFrame({"tree": frame["group"], "slot": 0, "path": paths, "subroot": frame["node"], "root": roots})

    known = cut(descend(over if len(over) > 1 else [*over, over[0]], top, "tree string, slot long, path binary, subroot binary, root binary", of_group, levels), "group_paths")

    def of_leaf(frame, paths):
        kept = [bytes(t) if t is not None else bytes(x) for t, x in zip(frame["tampered"], frame["node"], strict=True)]
        return pd.DataFrame({
            "tree": frame["tree"], "doc_id": frame["doc_id"].astype("Int64"), "leaf": frame["node"], "path": paths,
            "folded_root": [fold(x, p) for x, p in zip(kept, paths, strict=True)], "proof_sha256": [proof(p) for p in paths],
        })

    out = descend(up if len(up) > 1 else [*up, up[0]], known.select("tree", "slot", "path"), "tree string, doc_id long, leaf binary, path binary, folded_root binary, proof_sha256 string", of_leaf, levels)
    joined = out.join(known.select("tree", "subroot", "root"), "tree")
    return joined.select("doc_id", "leaf", "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "proof_sha256")
