"""Jaccard self-join of documents on word n-grams, by vertical partitioning.

Equal shingle sets become one class first, so copies cost one row each. A global order of shingles, rare buckets
first, is cut into FRAGMENTS; a class's set is cut likewise, overlaps are counted fragment by fragment, and the partial
counts of a pair are summed and compared with the threshold.

Pairs to count come from the heads of the sets: their first shingles, so many that similar sets must share at least one in SHARE of
them, and one more, within their heads. A class with fewer shared shingles in its head has no links. Where up to LIGHT classes
share a head shingle, they are paired, if enough of these meet and lengths and positions allow. Where more do, nothing is paired as rows: the classes
tied by such shingles form a dense cluster, clusters are cut into blocks of at most BLOCK_WORK shingles, and each pair of
blocks that lengths allow is one bounded task, which counts its overlaps fragment by fragment as matrix products and returns
only which classes its links connect. Work inside one cluster is quadratic in its *different* sets, never in rows moved to one task.

Links are exact up to collisions of 64-bit shingle hashes. Null text, or text without words, has no shingles and no links. Rows without
doc_id are linked only through an equal set. Repeated rows are copies like others; rows with one doc_id but different texts are one
document, linked with what either is linked with. Extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..ordered import running_sums
from ..shipping import ship
from .common import map_rows, mix, slices, utf8, word_hashes
from .graphs import components

SIZE, NUMERATOR, DENOMINATOR = 5, 80, 100
BITS, CHUNK_BITS = 22, 16  # bucket table of the global order: 2 ** BITS counters, dealt in chunks of 2 ** CHUNK_BITS
FRAGMENTS = 8
SHARE = 20
LIGHT = 64
BLOCK_WORK, DOC_WORK = 250_000, 400
COLUMNS = 4096  # shingles multiplied at once
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_LOWER).split() if text else []


def shingles(text: bytes | None, size: int, hashes) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; fewer words count as one shingle."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.array([hashes[x] for x in w], np.uint64)
    k = min(size, len(w))
    n = len(w) - k + 1
    total = np.full(n, k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            total = mix(total) + h[j : j + n]
    return np.unique(mix(total))


def signature(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = mix(s + np.uint64(0x9E3779B97F4A7C15)), mix(s ^ np.uint64(0x5851F42D4C957F2D))
        return int(a.sum().astype(np.uint64).view(np.int64)), int(b.sum().astype(np.uint64).view(np.int64))


class Order:
    """The global order: by the count of a shingle's bucket, then by hash; and its cuts into fragments."""

    def __init__(self, counts: np.ndarray, fragments: int):
        self.level = np.round(np.log2(np.maximum(counts, 1)) * 256).astype(np.uint64)
        by = np.lexsort((np.arange(len(counts)), self.level))
        mass = np.cumsum(counts[by])
        at = np.searchsorted(mass, mass[-1] * np.arange(1, fragments) / fragments) if mass[-1] else np.empty(0, int)
        starts = by[at].astype(np.uint64)
        self.pivots = np.unique((self.level[by[at]] << np.uint64(50)) | ((starts << np.uint64(64 - BITS)) >> np.uint64(14)))

    def key(self, s: np.ndarray) -> np.ndarray:
        return (self.level[(s >> np.uint64(64 - BITS)).astype(np.int64)] << np.uint64(50)) | (s >> np.uint64(14))

    def head(self, s: np.ndarray, num: int, den: int) -> np.ndarray:
        """The first shingles: any similar set y has at least ``common(min(len(s), len(y)))`` of them in its own head."""
        n = len(s) - -(-len(s) * num // den) + 1 + len(s) // SHARE
        return s[np.argsort(self.key(s), kind="stable")[:n]]

    def cut(self, s: np.ndarray) -> list[tuple[int, np.ndarray]]:
        place = np.searchsorted(self.pivots, self.key(s), side="right")
        return [(int(f), s[place == f]) for f in np.unique(place)]


def bucket_counts(rows: DataFrame, make) -> np.ndarray:
    """How often each of 2 ** BITS buckets occurs; ``make()`` gives a function from a batch to its bucket numbers.

    A task packs its counters into compressed chunks, and each chunk's are summed one after the other, so the driver gets the
    same few megabytes whatever the corpus.
    """
    ship(rows.sparkSession)
    chunk = 1 << CHUNK_BITS

    def count(batches):
        buckets, total = make(), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            for part in slices(batch):
                np.add.at(total, buckets(part), 1)
        yield from _packed({i: part for i, part in enumerate(total.reshape(-1, chunk)) if part.any()})

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(zlib.decompress(blob), np.int64)
                total[i] = total[i] + part if i in total else part
        yield from _packed(total)

    kind = "chunk int, counts binary"
    counts = np.zeros((1 << (BITS - CHUNK_BITS), chunk), np.int64)
    for r in rows.mapInArrow(count, kind).repartition("chunk").mapInArrow(add, kind).collect():
        counts[r.chunk] = np.frombuffer(zlib.decompress(bytes(r.counts)), np.int64)
    return counts.ravel()


def global_order(docs: DataFrame, size: int, fragments: int = FRAGMENTS) -> Order:
    """The order of all shingles of all documents."""

    def make():
        hashes = word_hashes()

        def buckets(batch):
            found = [shingles(t, size, hashes) >> np.uint64(64 - BITS) for t in utf8(batch, "text")]
            return np.concatenate(found).astype(np.int64)

        return buckets

    return Order(bucket_counts(docs.select("text"), make), fragments)


def _packed(parts: dict[int, np.ndarray]):
    for i, part in parts.items():
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([i], pa.int32()), "counts": [zlib.compress(part.tobytes(), 1)]})


def common(n: Column) -> Column:
    """How many head shingles similar sets share, the smaller one having ``n``."""
    return 1 + F.floor(n / SHARE)


def _signed(s: np.ndarray) -> np.ndarray:
    return s.view(np.int64)


def sets(docs: DataFrame, order, size: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, s1, s2, head): size, signature and head of every document's set."""

    def make():
        hashes, o = word_hashes(), order.value

        def step(rows):
            found = [shingles(t, size, hashes) for t in utf8(rows, "text")]
            marks = [signature(s) for s in found]
            return {
                "doc_id": rows.column("doc_id"), "n": [len(s) for s in found], "s1": [m[0] for m in marks], "s2": [m[1] for m in marks],
                "head": [_signed(o.head(s, num, den)) if len(s) else [] for s in found],
            }

        return step

    return map_rows(docs.select("doc_id", "text"), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, s1 long, s2 long, head array<long>", make)


def segments(docs: DataFrame, nodes: DataFrame, order, size: int) -> DataFrame:
    """(node, frag, tokens): the cut sets of some classes (node, s1, s2, rep, twice), made from the text of one document each.

    A bitmap of the wanted ids, of fixed size, tells tasks which texts to take apart; texts themselves are not moved. Where
    ``twice`` says that several rows carry a doc_id, only one of them counts.
    """
    mask = (1 << BITS) - 1
    wanted = bucket_counts(nodes.select(F.xxhash64("rep").alias("h")), lambda: lambda batch: batch.column("h").to_numpy() & mask)
    bitmap = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted > 0))

    def make():
        hashes, o, held = word_hashes(), order.value, np.unpackbits(bitmap.value).astype(bool)

        def step(rows):
            rows = rows.filter(pa.array(held[rows.column("h").to_numpy() & mask]))
            out = {"doc_id": [], "s1": [], "s2": [], "frag": [], "tokens": []}
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), utf8(rows, "text")):
                s = shingles(text, size, hashes)
                s1, s2 = signature(s)
                for f, part in o.cut(s):
                    for name, value in zip(out, (doc_id, s1, s2, f, _signed(part))):
                        out[name].append(value)
            return out

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    made = map_rows(texts, f"doc_id {kind}, s1 long, s2 long, frag int, tokens array<long>", make)
    # Another text may carry the same doc_id, so the signature is part of the key; dealt by key at every size.
    keyed = nodes.select("node", "s1", "s2", "twice", F.col("rep").alias("doc_id")).hint("merge")
    parts = cut(made.join(keyed, ["doc_id", "s1", "s2"]).select("node", "frag", "tokens", "twice"), "segments")
    again = parts.filter("twice").groupBy("node", "frag").agg(F.any_value("tokens").alias("tokens"))
    return parts.filter("NOT twice").drop("twice").unionByName(again)


def _similar(overlap, na, nb, num: int, den: int):
    return overlap * (den + num) >= (na + nb) * num


def light_pairs(shared: DataFrame, light: int, num: int, den: int) -> DataFrame:
    """(a, na, b, nb): classes that share head shingles held by few, if their number, lengths and positions let them be similar.

    Shingles held by many are not paired here; a class with ``many`` of them may share up to so many more.
    """
    few = shared.filter(F.col("m") <= light)
    a = few.select("token", *[F.col(c).alias(f"{c}a") for c in ("node", "n", "pos", "many")])
    b = few.select("token", *[F.col(c).alias(f"{c}b") for c in ("node", "n", "pos", "many")])
    met = a.join(b, "token").filter((F.col("nodea") < F.col("nodeb")) & (F.least("na", "nb") * den >= F.greatest("na", "nb") * num))
    pairs = met.groupBy("nodea", "na", "manya", "nodeb", "nb", "manyb").agg(
        F.count("*").alias("k"), F.max(F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb"))).alias("most")
    )
    more = F.least("manya", "manyb")
    likely = (F.col("k") + more >= common(F.least("na", "nb"))) & _similar(F.least(F.col("most") + more, F.least("na", "nb")), F.col("na"), F.col("nb"), num, den)
    return pairs.filter(likely).select(F.col("nodea").alias("a"), "na", F.col("nodeb").alias("b"), "nb")


def count_pairs(pairs: DataFrame, segs: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) among the pairs: partial overlaps by fragment, summed."""
    left = segs.select(F.col("node").alias("a"), "frag", F.col("tokens").alias("ta"))
    right = segs.select(F.col("node").alias("b"), "frag", F.col("tokens").alias("tb"))
    partial = pairs.join(left, "a").join(right, ["b", "frag"]).select("a", "na", "b", "nb", F.size(F.array_intersect("ta", "tb")).cast("long").alias("o"))
    return partial.groupBy("a", "na", "b", "nb").agg(F.sum("o").alias("o")).filter(_similar(F.col("o"), F.col("na"), F.col("nb"), num, den)).select("a", "b")


def block_links(rows: pd.DataFrame, num: int, den: int) -> list[tuple[int, int]]:
    """What the links between two blocks (or inside one) connect, as (node, smallest node): rows (side, node, cluster, n, frag, tokens)."""
    heads = rows.drop_duplicates(["side", "node"]).sort_values(["side", "node"])
    left, right = heads[heads.side == 0], heads[heads.side == 1]
    inside = right.empty
    right = left if inside else right
    overlap = np.zeros((len(left), len(right)), np.float32)
    place = [{x: i for i, x in enumerate(h.node)} for h in (left, right)]
    for _, part in rows.groupby("frag"):
        tokens, sizes = np.concatenate(part.tokens.to_list()), part.tokens.map(len).to_numpy()
        _, number, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        shared = counts > 1
        number = np.where(shared, np.cumsum(shared) - 1, -1)[number]
        side, row = np.repeat(part.side.to_numpy(), sizes), np.repeat([place[s][x] for s, x in zip(part.side, part.node)], sizes)
        for start in range(0, int(shared.sum()), COLUMNS):
            here = (number >= start) & (number < start + COLUMNS)
            each = []
            for s, h in ((0, left), (1, right)):
                at = here & (side == (0 if inside else s))
                m = np.zeros((len(h), COLUMNS), np.float32)
                m[row[at], number[at] - start] = 1
                each.append(m)
            overlap += each[0] @ each[1].T
    o = np.rint(overlap).astype(np.int64)
    na, nb = left.n.to_numpy(np.int64)[:, None], right.n.to_numpy(np.int64)[None, :]
    link = _similar(o, na, nb, num, den) & (left.cluster.to_numpy()[:, None] == right.cluster.to_numpy()[None, :])
    a, b = left.node.to_numpy(), right.node.to_numpy()
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in np.argwhere(link).tolist():
        x, y = sorted((find(int(a[i])), find(int(b[j]))))
        root[y] = x
    return [(x, find(x)) for x in root if find(x) != x]


def dense_links(nodes: DataFrame, segs: DataFrame, num: int, den: int, block_work: int) -> DataFrame:
    """Links (a, b) that connect what is similar inside dense clusters, for nodes (node, cluster, n)."""
    ordered = running_sums(nodes.withColumn("work", F.col("n").cast("long") + DOC_WORK), [], ["cluster", "n", "node"], {"before": F.col("work")}, fits=False)
    members = cut(ordered.select("node", "cluster", "n", (F.col("before") / block_work).cast("long").alias("block")), "blocks")
    extent = members.groupBy("cluster", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    one = extent.select("cluster", F.col("block").alias("b1"), F.col("high").alias("h1"))
    two = extent.select("cluster", F.col("block").alias("b2"), F.col("low").alias("l2"))
    pairs = one.join(two, "cluster").filter((F.col("b1") <= F.col("b2")) & (F.col("h1").cast("long") * den >= F.col("l2") * num)).select("b1", "b2").distinct()
    pairs = cut(pairs, "block_pairs")
    body = segs.join(members, "node")
    sides = [body.withColumn("side", F.lit(s)).join(p.withColumn("block", F.col(b)), "block") for s, b, p in ((0, "b1", pairs), (1, "b2", pairs.filter("b1 != b2")))]

    def run(rows):
        return pd.DataFrame(block_links(rows, num, den), columns=["a", "b"], dtype="int64")

    return sides[0].unionByName(sides[1]).select("b1", "b2", "side", "node", "cluster", "n", "frag", "tokens").groupBy("b1", "b2").applyInPandas(run, "a long, b long")


def repeated_ids(every: DataFrame) -> DataFrame:
    """(doc_id, differ): ids of several rows with shingles, and whether their sets differ."""
    mark = F.struct("s1", "s2", "n")
    found = every.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("k"), F.min(mark).alias("low"), F.max(mark).alias("high"))
    return cut(found.filter("k > 1").select("doc_id", (F.col("low") != F.col("high")).alias("differ")), "repeated")


def same_document(every: DataFrame, classes: DataFrame, repeated: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that repeat a doc_id with different sets."""
    rows = every.join(repeated.filter("differ").select("doc_id"), "doc_id")
    nodes = rows.join(classes.select("s1", "s2", "n", "node"), ["s1", "s2", "n"]).select("doc_id", "node")
    return nodes.join(nodes.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b")


def join(docs: DataFrame, size: int = SIZE, num: int = NUMERATOR, den: int = DENOMINATOR, light: int = LIGHT, block_work: int = BLOCK_WORK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: the smallest doc_id that links of similarity num/den reach."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    order = spark.sparkContext.broadcast(global_order(docs, size))
    every = cut(sets(docs, order, size, num, den), "sets")
    classes = every.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.any_value("head").alias("head"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    held = classes.select("node", "n", F.posexplode("head").alias("pos", "token"))
    several = held.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1")
    shared = cut(held.join(several, "token"), "heads")
    # A similar set may be smaller than this one, but not by more than the threshold.
    least = common(F.ceil(F.first("n") * num / den))
    able = shared.groupBy("node").agg(F.count("*").alias("k"), F.count_if(F.col("m") > light).alias("many"), least.alias("least")).filter("k >= least")
    shared = cut(shared.join(able.select("node", "many"), "node"), "shared")
    pairs = cut(light_pairs(shared, light, num, den), "pairs")
    many = shared.filter(F.col("m") > light)
    star = many.join(many.groupBy("token").agg(F.min("node").alias("b")), "token").select(F.col("node").alias("a"), "b")
    clusters = cut(components(star), "clusters")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(clusters.select("node")).distinct()
    repeated = repeated_ids(every)
    wanted = classes.drop("head").join(wanted, "node").join(repeated.select(F.col("doc_id").alias("rep"), F.lit(True).alias("twice")), "rep", "left")
    segs = segments(docs, cut(wanted.withColumn("twice", F.coalesce("twice", F.lit(False))), "wanted"), order, size)
    links = count_pairs(pairs, segs, num, den)
    if not clusters.isEmpty():
        inside = clusters.withColumnRenamed("label", "cluster").join(classes.select("node", "n"), "node")
        links = links.unionByName(dense_links(inside, segs, num, den, block_work))
    labels = cut(components(links.unionByName(same_document(every, classes, repeated))), "labels")
    first = labels.join(classes.select("node", "rep"), "node").groupBy("label").agg(F.min("rep").alias("least"))
    named = classes.drop("head").join(labels, "node", "left").join(first, "label", "left").select("s1", "s2", "n", F.coalesce("least", "rep").alias("component"))
    out = every.drop("head").join(named, ["s1", "s2", "n"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def representatives(docs: DataFrame, **how) -> DataFrame:
    """One document of each component: the one with the smallest doc_id; of rows that repeat it, one with its smallest text.

    Rows without doc_id or without shingles are in no component and stay. All columns are untouched.
    """
    found = cut(join(docs, **how), "found")
    gone = cut(found.filter((F.col("doc_id") != F.col("component_id")) & (F.col("n_shingles") > 0)).select("doc_id").distinct(), "gone")
    again = cut(found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "again")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return kept
    single = kept.join(again, "doc_id", "left_anti").select(*docs.columns)
    repeated = kept.join(again, "doc_id", "left_semi")
    body = F.struct(*[F.col(c) for c in docs.columns])
    one = repeated.groupBy("doc_id").agg(F.min_by(body, F.struct(F.coalesce("text", F.lit("")), F.xxhash64(body))).alias("_row")).select("_row.*")
    return single.unionByName(one)
