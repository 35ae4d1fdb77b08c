"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under an operator id, with equivalent SQL where there is one."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is already registered")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Round computed doubles, so that summation order does not show.

    Half away from zero on the scaled double, as the checking engine rounds:
    prices with few decimals hit exact ties.
    """
    scale = float(10**digits)
    return df.withColumns({c: F.signum(F.col(c)) * F.floor(F.abs(F.col(c)) * scale + 0.5) / scale for c in names})
