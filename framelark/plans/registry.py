"""Every query of the engine, by name, with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register `f(spark, sf_dir)` as query `name`."""

    def put(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return put


def load() -> None:
    """Import the modules that register queries."""
    from framelark.plans import artifacts, contracts, ensemble, features, notes, selection, signal, windows  # noqa: F401


load()
