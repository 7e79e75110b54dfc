"""Queries by name, with the operators that each covers and SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(covers: str, sql: str | None):
    """Registers a function of a table reader ``t`` (name -> DataFrame) under its own name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        COVERS[f.__name__] = covers
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
