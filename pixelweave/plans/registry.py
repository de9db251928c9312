"""The registry behind ``__spark_entry__``: a Spark query and, where SQL can say it, its twin."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf)`` under ``name`` with the SQL that must give the same rows."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = re.sub(r'(?<![\w".])by(?![\w"])', '"by"', sql)  # a mesh column that is a keyword
        return fn

    return deco
