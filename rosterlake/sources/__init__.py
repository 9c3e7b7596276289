"""Scans. SOURCES names them; build() makes one or says which exist."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SOURCES: dict[str, Callable[..., DataFrame]] = {}


def source(name: str):
    """Decorator for a plug-in: f(spark, **options) -> DataFrame."""

    def add(f):
        SOURCES[name] = f
        return f

    return add


def build(name: str, spark: SparkSession, **options) -> DataFrame:
    from rosterlake.sources import files, members  # noqa: F401  they register themselves

    if name not in SOURCES:
        raise ValueError(f"no source {name}; there are {', '.join(sorted(SOURCES))}")
    return SOURCES[name](spark, **options)
