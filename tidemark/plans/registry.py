"""The query registry: each query with its independent SQL form."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.columns import to_output
from tidemark.plans.oracle import sql, wrap
from tidemark.plans.views import Views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Views], DataFrame]
    oracle: str | None
    floats: str
    ints: str
    digits: int

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return to_output(self.build(Views(spark, folder)), self.floats, self.ints, self.digits)


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None, *, floats: str = "", ints: str = "", digits: int = 6,
          views: dict[str, str] | None = None):
    """Register a builder ``Views -> DataFrame`` under a name.

    ``floats`` are rounded and ``ints`` cast to long on both sides.
    """
    def add(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is already registered")
        text = None if oracle is None else wrap(sql(oracle, views), floats, ints, digits)
        QUERIES[name] = Query(name, build, text, floats, ints, digits)
        return build
    return add
