"""Registered queries: a Spark job per operator and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from facetloom.session import broadcast_measured
from facetloom.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, raw: bool = False):
    """Register ``fn(tables) -> DataFrame`` under ``name``.

    ``raw`` queries start from the source tables, e.g. those that build an index.
    """

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            broadcast_measured(spark)
            return fn(Tables(spark, folder, stored=not raw))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
