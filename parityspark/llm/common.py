"""Arrow batch plumbing and hashing shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..shipping import ship

#: Rows looked at together inside a task; bounds what a Python worker holds besides the batch itself.
ROWS = 256


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, ROWS):
        yield batch.slice(start, ROWS)


def map_rows(df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """Rows of ``df`` through ``make()``, which runs once per task and turns a few rows into columns of the result."""
    ship(df.sparkSession)
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(schema)

    def run(batches):
        step = make()
        for batch in batches:
            for rows in slices(batch):
                yield pa.RecordBatch.from_pydict(step(rows), schema=target)

    return df.mapInArrow(run, schema)


def filter_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], np.ndarray]]) -> DataFrame:
    """Rows of ``df`` for which the mask is true, all columns untouched."""
    ship(df.sparkSession)

    def run(batches):
        keep = make()
        for batch in batches:
            for rows in slices(batch):
                yield rows.filter(pa.array(keep(rows), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % n


class Memo(dict):
    """Values computed once per key and forgotten together when there are too many."""

    def __init__(self, make: Callable, most: int = 500_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


def word_hashes(most: int = 500_000) -> Memo:
    return Memo(xxhash.xxh3_64_intdigest, most)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (finaliser of a public hash function)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x
