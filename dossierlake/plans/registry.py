"""Registry of the queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions.text import col
from dossierlake.plans import adapters
from dossierlake.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, uses: str = "", sql: str | None = None):
    """Register a query over ``Tables``; ``sql`` is its DuckDB equivalent over the views."""

    def wrap(build: Callable[[adapters.Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(adapters.Tables(tune(spark), folder))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = adapters.oracle(uses, sql)
        return build

    return wrap


def r4(c) -> Column:
    """Four decimals as a double, so that two engines agree on the last bit."""
    return col(c).cast("decimal(18,4)").cast("double")


def r8(c) -> Column:
    """Eight decimals, for averages of small numbers, where four would meet ties."""
    return col(c).cast("decimal(18,8)").cast("double")
