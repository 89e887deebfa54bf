"""The query registry shared by all catalogue modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberlog.plans.adapters import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] | list[str] = ()):
    """Registers ``f(spark, sf_dir) -> DataFrame`` and, where one exists, its comparison SQL."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(sql, *views) if views else sql.strip()
        return fn

    return add
