"""One registered check per operator: the Spark form next to its SQL form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citespark.adapter import Corpus, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(corpus) -> DataFrame`` under ``name``, with its SQL if there is one."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Corpus(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        if sql:
            ORACLES[name] = with_views(sql)
        return fn

    return wrap


def load() -> None:
    from citespark.queries import (  # noqa: F401
        cleaning, community, corpus, diversity, indicators, linkage, network, series, sources, text, twomode,
    )
