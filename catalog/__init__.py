"""Named queries over the test tables, each with its independent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fixtures import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def load() -> None:
    from . import (  # noqa: F401
        cleaning,
        consensus,
        evaluation,
        fares,
        geometry,
        lifecycle,
        listings,
        nightly,
        overlap,
        routing,
        schedules,
        sources,
        strategies,
        streams,
        votes,
    )
