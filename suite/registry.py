"""Registry of the named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from suite.model import Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(model)`` under ``name``."""

    def register(build: Callable[[Model], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Model(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
