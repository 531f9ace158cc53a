"""The query register: one entry per operator, each with the SQL that must give the same rows."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from loftline.plans.data import Data, oracle

QUERIES: dict[str, Callable[[Data], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: tuple = ()):
    """Register ``fn(data) -> DataFrame`` under ``name``; ``needs`` are the views its SQL reads."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql, needs)
        return fn
    return deco


def runners() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Data(spark, folder))
        run.__doc__ = fn.__doc__
        return run
    return {k: bind(v) for k, v in QUERIES.items()}


def HU(expr: str, digits: int) -> str:
    """Oracle text for the half-up rounding used everywhere."""
    k = f"1{'0' * digits}.0"
    return f"(floor(CAST({expr} AS DOUBLE)*{k}::DOUBLE + 0.5::DOUBLE)/{k}::DOUBLE)"
