"""Registry of named queries and their independent SQL checks."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) under ``name``; ``sql`` is the check over the same tables."""
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round double columns so that summation order cannot show."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import DoubleType
    return df.select(*[(F.round(F.col(f"`{f.name}`"), places) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, DoubleType)
                       else F.col(f"`{f.name}`") for f in df.schema.fields])
