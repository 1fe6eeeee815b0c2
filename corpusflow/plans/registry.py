"""The catalogue of queries: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusflow.plans.oracle_views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, same_as: str | None = None):
    """Register ``fn(spark, sf_dir)``.

    ``oracle`` may use the shared SQL views by name; ``same_as`` names the batch
    query whose oracle a streaming form must meet too.
    """

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if same_as is not None:
            ORACLES[name] = ORACLES[same_as]
        elif oracle is not None:
            ORACLES[name] = with_views(oracle)
        return fn

    return add
