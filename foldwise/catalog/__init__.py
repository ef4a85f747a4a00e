"""The registered queries: one Spark callable per operator and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under a name, with the SQL that must give the same rows."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from . import (  # noqa: F401
        composed,
        features,
        joins,
        metrics,
        rows,
        scans,
        search,
        splits,
    )

    return QUERIES, ORACLES
