"""Registry of named queries: each key maps to a builder ``(spark, sf_dir) -> DataFrame`` and, where plain SQL
can express it, the equivalent DuckDB SQL over the same tables (the correctness oracle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str | Callable[[], str]] = {}
BENCH: list[str] = []


def oracle_texts() -> dict[str, str]:
    """The DuckDB text per key; texts given as functions are built here, never while a module is imported."""
    return {k: v() if callable(v) else v for k, v in ORACLES.items()}


def query(name: str, oracle: str | Callable[[], str] | None = None, bench: bool = False):
    """Register a query builder; ``oracle`` is the DuckDB SQL text or a function that builds it, ``bench`` marks
    headline queries."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        if bench:
            BENCH.append(name)
        return fn
    return deco
