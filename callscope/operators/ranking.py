"""Global order without a single-task window: range partitions plus per-partition offsets."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.session import cut_lineage


def running_totals(df: DataFrame, group: list[str], order: list, sums: dict[str, str],
                   parts: int | None = None, maxima: dict[str, str] | None = None) -> DataFrame:
    """Running sums (and running maxima) in (group, order) with no task holding a whole group.

    Rows are range-partitioned on (group, order) and fixed in a checkpoint, so the partition
    number is stable when a task is rerun; each range adds the totals of the ranges before it.
    ``sums`` and ``maxima`` map output name -> SQL expression over one row.
    """
    maxima = maxima or {}
    agg = {**{n: F.sum for n in sums}, **{n: F.max for n in maxima}}
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    keys = [F.col(g) for g in group]
    base = df.repartitionByRange(parts, *keys, *order).withColumn("_pid", F.spark_partition_id())
    for name, expr in {**sums, **maxima}.items():
        base = base.withColumn(f"_x_{name}", F.expr(expr))
    base = cut_lineage(base)
    tot = base.groupBy(*group, "_pid").agg(*[f(f"_x_{n}").alias(f"_t_{n}") for n, f in agg.items()])
    # one row per (group, range): the number of ranges bounds every window partition
    w = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*group, "_pid", *[(F.coalesce(f(f"_t_{n}").over(w), F.lit(0)) if n in sums else f(f"_t_{n}").over(w))
                                       .alias(f"_o_{n}") for n, f in agg.items()])
    inner = Window.partitionBy(*group, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = base.select("*", *[f(f"_x_{n}").over(inner).alias(f"_r_{n}") for n, f in agg.items()])
    out = out.join(off, group + ["_pid"])
    keep = [c for c in df.columns if c not in agg]
    return out.select(*keep, *[(F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums],
                      *[F.greatest(f"_r_{n}", f"_o_{n}").alias(n) for n in maxima])


def exact_quantiles(df: DataFrame, group: list[str], value: str, qs: dict[str, float],
                    method: str = "linear") -> DataFrame:
    """Exact quantiles per group from value counts: one row per group, one column per entry of ``qs``.

    linear interpolates between neighbours; nearest takes sorted[round_half_even(q * (n - 1))].
    """
    g = group or ["_all"]
    src = df if group else df.withColumn("_all", F.lit(1))
    counts = src.where(F.col(value).isNotNull()).groupBy(*g, value).agg(F.count(F.lit(1)).alias("_c"))
    cum = running_totals(counts, g, [value], {"_cum": "_c"})
    size = counts.groupBy(*g).agg(F.sum("_c").alias("_n"))
    j = cum.join(size, g)
    cols = []
    for name, q in qs.items():
        pos = F.lit(q) * (F.col("_n") - 1)
        lo, hi = (F.floor(pos), F.ceil(pos)) if method == "linear" else (F.bround(pos), F.bround(pos))
        at = lambda i: F.max(F.when((F.col("_cum") > i) & (F.col("_cum") - F.col("_c") <= i), F.col(value)))
        frac = F.first(pos - F.floor(pos)) if method == "linear" else F.lit(0.0)
        cols.append((at(lo) + (at(hi) - at(lo)) * frac).alias(name))
    return j.groupBy(*g).agg(*cols).drop("_all")
