"""URL filter: hand-made rules first, then a cascade of Bloom filters that is exact over the corpus's own hosts.

The key universe is every distinct host of the pages. Keys are dealt to shards by hash; each shard builds its levels
alone: level 0 encodes the listed keys, level 1 the unlisted keys that level 0 lets through, level 2 the listed keys that
level 1 lets through, and so on until nothing passes wrongly. Within the universe, the first level that rejects a key decides
whether it is listed, so membership is exact although no level stores a key, and pages are never joined with a list.

The levels are broadcast while they take at most BROADCAST_BYTES, which is checked. Beyond that, rows and levels are
dealt by (shard, salt) and sorted so that a shard's levels come just before its rows; a task streams through them.

A null url, or one without ``://``, has an empty host and path, fits no rule and is in no list. Repeated rows are judged each
for itself; extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..shipping import ship
from .common import map_rows, mix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (action, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Words that, as a part of a host name between dots or hyphens, put the host on the default list.
LISTED_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")
KEYS_PER_SHARD = 200_000
BROADCAST_BYTES = 8_000_000
ROWS_PER_SALT = 2_000_000


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    out = None
    for action, name, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(action).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def listed_by_words(host: Column, words: Sequence[str] = LISTED_WORDS) -> Column:
    return host.rlike(rf"(^|[.-])({'|'.join(words)})([.-]|$)")


# --- one shard's levels -----------------------------------------------------------------------------------------


def _slots(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        a, b = mix(h1 + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)), mix(h2 ^ np.uint64(level + 1)) | np.uint64(1)
        return (a[:, None] + np.arange(hashes, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


def build_levels(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(bits, hashes, packed bits) of each level for keys given by two 64-bit hashes."""
    pairs, where = np.unique(np.stack([h1, h2]), axis=1, return_inverse=True)
    both = np.zeros((2, pairs.shape[1]), bool)
    both[listed.astype(int), where.reshape(-1)] = True
    if both.all(0).any():
        raise ValueError("a listed and an unlisted key share 128 bits of hash")
    wanted, others = listed, ~listed
    levels = []
    while wanted.any():
        n, m = int(wanted.sum()), int(others.sum())
        # The first level lets through about as many others as there are keys; deeper levels half of theirs.
        rate = min(0.5, max(n / m / 2, 1e-4)) if m else 0.5
        bits, hashes = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2)), max(1, round(-math.log2(rate)))
        table = np.zeros(bits, bool)
        table[_slots(h1[wanted], h2[wanted], len(levels), bits, hashes).ravel()] = True
        levels.append((bits, hashes, np.packbits(table).tobytes()))
        passed = np.zeros(len(h1), bool)
        passed[others] = table[_slots(h1[others], h2[others], len(levels) - 1, bits, hashes)].all(1)
        wanted, others = passed, wanted
    return levels


def member(levels: list[tuple[int, int, bytes]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    answer, left = np.zeros(len(h1), bool), np.arange(len(h1))
    for k, (bits, hashes, packed) in enumerate(levels):
        table = np.unpackbits(np.frombuffer(packed, np.uint8), count=bits).astype(bool)
        passed = table[_slots(h1[left], h2[left], k, bits, hashes)].all(1)
        answer[left[~passed]] = k % 2 == 1
        left = left[passed]
    answer[left] = len(levels) % 2 == 1
    return answer


# --- over Spark -------------------------------------------------------------------------------------------------


def _hashed(key: Column, shards: int) -> list[Column]:
    return [
        F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"),
        F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards)).cast("int").alias("shard"),
    ]


def cascade(universe: DataFrame, keys_per_shard: int = KEYS_PER_SHARD) -> tuple[DataFrame, int]:
    """(shard, levels binary) over rows (key, listed) with distinct keys, and the number of shards."""
    ship(universe.sparkSession)
    universe = cut(universe.select("key", "listed"), "universe")
    shards = max(1, math.ceil(universe.count() / keys_per_shard))

    def build(rows):
        h = [rows[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2")]
        return rows.head(1)[["shard"]].assign(levels=pickle.dumps(build_levels(*h, rows["listed"].to_numpy().astype(bool))))

    keyed = universe.select(*_hashed(F.col("key"), shards), "listed")
    return cut(keyed.groupBy("shard").applyInPandas(build, "shard int, levels binary"), "cascade"), shards


def _answers(batch: pa.RecordBatch, levels_of: dict) -> np.ndarray:
    h1, h2, shard = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "shard"))
    out = np.zeros(batch.num_rows, bool)
    for s in np.unique(shard):
        at = np.flatnonzero(shard == s)
        out[at] = member(levels_of.get(int(s), []), h1[at].view(np.uint64), h2[at].view(np.uint64))
    return out


def _type(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def judge(rows: DataFrame, key: str, levels: DataFrame, shards: int, broadcast_bytes: int = BROADCAST_BYTES, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """``rows`` with a boolean column ``in_list``; exact for keys of the cascade's universe."""
    columns = rows.columns
    hashed = rows.select("*", *_hashed(F.col(key), shards))
    schema = f"{_type(rows)}, in_list boolean"
    if (levels.agg(F.sum(F.length("levels"))).first()[0] or 0) <= broadcast_bytes:
        shared = rows.sparkSession.sparkContext.broadcast({r.shard: bytes(r.levels) for r in levels.collect()})

        def make():
            levels_of = {s: pickle.loads(x) for s, x in shared.value.items()}
            return lambda batch: {c: batch.column(c) for c in columns} | {"in_list": _answers(batch, levels_of)}

        return map_rows(hashed, schema, make)
    salts = max(1, math.ceil(rows.count() / rows_per_salt / shards))
    body = F.struct(*columns)
    empty = F.lit(None).cast(hashed.select(body.alias("x")).schema["x"].dataType)
    data = hashed.select("shard", F.pmod(F.xxhash64("h1", *[c for c in columns if c != key]), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "h1", "h2", F.lit(None).cast("binary").alias("levels"), body.alias("body"))
    heads = levels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select(
        "shard", "salt", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), "levels", empty.alias("body")
    )
    together = data.unionByName(heads).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    ship(rows.sparkSession)

    def run(batches):
        now: dict = {}
        for batch in batches:
            kinds, shard, blobs = batch.column("kind").to_numpy(), batch.column("shard").to_numpy(), batch.column("levels")
            heads_at = [*np.flatnonzero(kinds == 0).tolist(), batch.num_rows]
            start = 0
            for at in heads_at:
                part = batch.slice(start, at - start)
                if part.num_rows:
                    fields = part.column("body").flatten()
                    yield pa.RecordBatch.from_arrays([*fields, pa.array(_answers(part, now), pa.bool_())], names=[*columns, "in_list"])
                if at < batch.num_rows:
                    now = {int(shard[at]): pickle.loads(blobs[at].as_py())}
                start = at + 1

    return together.mapInArrow(run, schema)


def filter_urls(pages: DataFrame, rules=RULES, words=LISTED_WORDS, **limits) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page: the longest fitting rule, else block what is listed."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hosts = parsed.select(F.col("host").alias("key")).distinct().withColumn("listed", listed_by_words(F.col("key"), words))
    levels, shards = cascade(hosts)
    seen = judge(parsed, "host", levels, shards, **limits)
    by_rule = seen.withColumn("_fit", ruled(F.col("host"), F.col("path"), rules))
    return by_rule.select(
        "page_id", "host", "path", F.col("_fit.rule").alias("rule"),
        F.coalesce("_fit.verdict", F.when(F.col("in_list"), "block").otherwise("allow")).alias("verdict"),
    )
