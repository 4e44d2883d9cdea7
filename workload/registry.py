"""The query registry behind ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from diurna.functions.numeric import r6
from diurna.session import tune
from diurna.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without an oracle only its rows are checked."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        @wraps(fn)
        def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        QUERIES[name] = tuned
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def long(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


def longs(*names: str) -> list[Column]:
    return [long(n) for n in names]


def rounded(*names: str) -> list[Column]:
    return [r6(F.col(n)).alias(n) for n in names]
