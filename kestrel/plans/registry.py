"""Named queries (one per operator of the inventory) and their SQL oracles."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.plans.context import Context

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLE: dict[str, str] = {}

_MODULES = [
    "kestrel.plans.q_kpis",
    "kestrel.plans.q_relational",
    "kestrel.plans.q_views",
    "kestrel.plans.q_scoring",
    "kestrel.plans.q_quality",
    "kestrel.plans.q_stats",
    "kestrel.plans.q_workspace",
    "kestrel.plans.q_ml",
    "kestrel.plans.q_stream",
    "kestrel.plans.q_scalars",
]


def register(name: str, sql: str | None = None):
    """Register ``fn(ctx) -> DataFrame`` under ``name`` with optional oracle SQL."""
    def deco(fn: Callable[[Context], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = lambda spark, sf_dir, _fn=fn: _run(_fn, spark, sf_dir)
        if sql is not None:
            _ORACLE[name] = sql
        return fn
    return deco


def _run(fn, spark: SparkSession, sf_dir: str) -> DataFrame:
    return for_check(fn(Context(spark, sf_dir)))


def for_check(df: DataFrame) -> DataFrame:
    """Portable output types for the cross-engine compare: dates and
    timestamps as ISO text, decimals as double, integers as bigint."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        dt = f.dataType
        if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(dt, T.DecimalType):
            c = c.cast("double")
        elif isinstance(dt, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


@lru_cache(maxsize=1)
def _load() -> None:
    for m in _MODULES:
        importlib.import_module(m)


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
