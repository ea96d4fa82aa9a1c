"""Connected components of a table of links, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut, drop


LINKS_PER_FILE = 200_000


def components(links: DataFrame) -> DataFrame:
    """(node, label) for rows (a, b): label is the smallest node that links reach; loops and repeats are harmless.

    Alternates two rewirings until nothing changes: every node ties its larger neighbours to its smallest one, then
    its smaller ones. Each keeps components and at most as many links; the number of rounds grows with the logarithm of a
    component's size. A node's smallest neighbour is a partial aggregate joined back, so a hub is never one task's group. Links
    only become fewer, so their number in one round says into how many files of LINKS_PER_FILE the next one is written.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
    edges = cut(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        files = 1 + now[0] // LINKS_PER_FILE
        around = both(edges)
        least = around.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = around.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        middle = cut(large.coalesce(files), "links")
        least = middle.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        down = middle.withColumnRenamed("a", "u").join(least, "u")
        small = down.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).filter("a != b").distinct()
        after = cut(small.coalesce(files), "links")
        drop(edges, middle)
        edges = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select("b", "b")).distinct()
