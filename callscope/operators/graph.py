"""Connected components by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.session import cut_lineage


def _digest(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label) with label = smallest id of the component. edges: a, b.

    Every step is a minimum per vertex and a join back, so a hub vertex is combined map-side and
    never collected. Rounds grow with the logarithm of the component size.
    """
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _digest(e)
    while state[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        e = cut_lineage(small)
        new = _digest(e)
        if new == state:
            break
        state = new
    root = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("label"))
    return nodes.select("id").join(root, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
