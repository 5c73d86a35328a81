"""Registration of queries, the models on their tables, and SQL fragments for where a key lives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shardloom.plans.query import ShardedQuery
from shardloom.registry import MODELS
from shardloom.sources.placement import CATALOG, SOURCES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def on(spark: SparkSession, sf_dir: str, name: str, frame: DataFrame | None = None, **how) -> ShardedQuery:
    """A query on a model's table, on the current shard."""
    return ShardedQuery.of(MODELS[name], SOURCES[name](spark, sf_dir) if frame is None else frame, CATALOG, **how)


def sh(k: str) -> str:
    return f"(1 + {k} % 4)"


def loc(k: str) -> str:
    return f"({k} + 1)"


def gid(k: str) -> str:
    return f"((1 + {k} % 4) * 10000000000000 + {k} + 1)"


def rel(k: str, c: str | int) -> str:
    return f"(CASE WHEN (1 + {k} % 4) = {c} THEN {k} + 1 ELSE (1 + {k} % 4) * 10000000000000 + {k} + 1 END)"


def key(k: int) -> int:
    """The global id of a key, for literals."""
    return (1 + k % 4) * 10_000_000_000_000 + k + 1
