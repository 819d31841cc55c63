"""Query registration: a Spark callable and, where SQL can express it, its independent check."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.schemas import PIXEL, RGBA
from framelake.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r9(c: str | Column, digits: int = 9) -> Column:
    name = c if isinstance(c, str) else None
    col = F.round(F.col(c) if isinstance(c, str) else c, digits)
    return col.alias(name) if name else col


def pixels(df: DataFrame, cols=RGBA, digits: int = 9) -> DataFrame:
    """Pixel output with rounded values."""
    return df.select(*PIXEL, *[r9(c, digits) for c in cols])
