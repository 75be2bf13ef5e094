"""Registered queries and, where SQL can state them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..binding import Inputs
from .sql import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``fn(inputs) -> DataFrame`` under ``name``."""

    def add(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql:
            ORACLE[name] = oracle(sql)
        return fn

    return add


def load() -> None:
    from . import aggregates, columns, joins, modelling, sources, windows  # noqa: F401
