"""Registered queries, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from .fixtures import Fixtures, cte_prefix


@dataclass(frozen=True)
class Entry:
    build: Callable[[Fixtures], DataFrame]
    oracle: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, oracle: str | None = None):
    """Register a builder taking the fixture views; ``oracle`` is None for rows-only checks."""

    def register(fn: Callable[[Fixtures], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        ENTRIES[name] = Entry(fn, oracle)
        return fn

    return register


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(entry: Entry):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return entry.build(Fixtures(spark, sf_dir))

        return run

    return {name: bind(e) for name, e in ENTRIES.items()}


def oracles() -> dict[str, str]:
    return {name: cte_prefix(e.oracle) for name, e in ENTRIES.items() if e.oracle}
