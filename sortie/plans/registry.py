"""One entry per query: the Spark callable, the inventory ids it covers, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import pin

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    ids: tuple[str, ...]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(ids: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(pin(spark), sf_dir)

        if fn.__name__ in ENTRIES:
            raise ValueError(f"query {fn.__name__} is registered twice")
        ENTRIES[fn.__name__] = Entry(run, tuple(ids.split()), sql)
        return fn

    return add
