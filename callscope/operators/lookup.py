"""Joins on keys that are mostly null, or that a large part of the rows share."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_lookup(df: DataFrame, found: DataFrame, key: str, spread: str) -> DataFrame:
    """Left join on a string key; rows without one are dealt out by ``spread`` instead of meeting in one task.

    A null key becomes a value of its own that no key of ``found`` has, so such rows match nothing, as nulls do.
    """
    alone = F.concat(F.lit("\u0000null:"), F.col(spread).cast("string"))
    dealt = df.withColumn("_key", F.coalesce(F.col(key), alone))
    return dealt.join(found.where(F.col(key).isNotNull()).withColumnRenamed(key, "_key"), "_key", "left").drop("_key")


def salted_join(large: DataFrame, small: DataFrame, on: list[str], spread: str, salts: int = 8) -> DataFrame:
    """Inner join in which a key with a third of the large side's rows goes to ``salts`` tasks, dealt by ``spread``."""
    each = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return large.withColumn("_salt", F.pmod(F.hash(spread), F.lit(salts))).join(each, [*on, "_salt"]).drop("_salt")


def dealt_lookup(df: DataFrame, found: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """Left join on a key of few values, of which each goes to ``salts`` tasks; rows are dealt by a hash of their plain columns.

    A handful of tools would otherwise leave all but a handful of tasks without rows, however many machines there are.
    """
    plain = [F.col(f"`{c}`") for c, t in df.dtypes if t in ("string", "boolean", "int", "bigint", "double")]
    each = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("_salt", F.pmod(F.hash(*plain), F.lit(salts))).join(each, [key, "_salt"], "left").drop("_salt")
