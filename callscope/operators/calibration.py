"""Confidence metrics: reliability, proper scores, risk-coverage, temperature."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.operators.ranking import running_totals


def reliability(df: DataFrame, p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    """Equal-width bins (lo, hi], 0.0 in the first; empty bins kept with NULL means."""
    edge = F.greatest(F.lit(1), F.ceil(F.col(p) * bins)).cast("int")
    # the product can land one bin off the exact edge test, so settle it against the edges
    b = (F.when(F.col(p) == 0, F.lit(1)).when(F.col(p) <= (edge - 1) / F.lit(float(bins)), edge - 1)
         .when(F.col(p) > edge / F.lit(float(bins)), edge + 1).otherwise(edge))
    agg = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("confidence"),
                                         F.avg(F.col(y).cast("double")).alias("accuracy"))
    frame = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return (frame.join(agg, "bin", "left")
            .select("bin", ((F.col("bin") - 1) / bins).alias("lo"), (F.col("bin") / bins).alias("hi"),
                    F.coalesce("n", F.lit(0)).alias("n"), "confidence", "accuracy"))


def ece(df: DataFrame, p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    r = reliability(df, p, y, bins)
    return r.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("n")).alias("ece"))


def scores(df: DataFrame, p: str = "p", y: str = "y", p_true: str | None = None, floor: float = 1e-4) -> DataFrame:
    """Brier score of the binary event and log score of the probability given to the truth."""
    t = F.col(p_true) if p_true else F.when(F.col(y) == 1, F.col(p)).otherwise(1 - F.col(p))
    return df.agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"),
                  (-F.avg(F.log(F.greatest(t, F.lit(floor))))).alias("log_score"))


def brier_multiclass(df: DataFrame, probs: str, gold: str) -> DataFrame:
    """Mean of the summed squared error over classes (array column of probabilities)."""
    return df.agg(F.avg(F.expr(f"aggregate(transform({probs}, (v, i) -> pow(v - if(i = {gold}, 1.0D, 0.0D), 2)), "
                               f"0.0D, (a, x) -> a + x)")).alias("brier_multiclass"))


def risk_coverage(df: DataFrame, p: str = "p", y: str = "y", seq: str = "seq") -> DataFrame:
    """Selective prediction curve, most confident first, ties in input order; no single-task sort."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    r = running_totals(df.select(p, y, seq), [], [F.col(p).desc(), F.col(seq)], {"k": "1", "wrong": f"1 - {y}"})
    return (r.join(F.broadcast(total)).select(seq, "k", (F.col("k") / F.col("_n")).alias("coverage"),
                                              (F.col("wrong") / F.col("k")).alias("risk")))


def aurc(curve: DataFrame) -> DataFrame:
    return curve.agg(F.avg("risk").alias("aurc"))


def coverage_at_risk(curve: DataFrame, max_risk: float) -> DataFrame:
    """Largest coverage whose risk stays at or below the bound, 0 when none does."""
    return curve.agg(F.coalesce(F.max(F.when(F.col("risk") <= max_risk, F.col("coverage"))), F.lit(0.0))
                     .alias("coverage_at_risk"))


def fit_temperature(df: DataFrame, logits: str, gold: str, lo: float = 0.05, hi: float = 20.0,
                    points: int = 33, passes: int = 9) -> DataFrame:
    """One-parameter scaling: the mean log loss over a grid of log T per pass, then a narrower grid.

    Each pass is one aggregate over the data and returns ``points`` numbers. ``at_bound`` marks a loss that still falls at
    an end of the range searched.
    """
    data = df.select(F.col(logits).alias("z"), F.col(gold).alias("g"))
    data = data.groupBy("z", "g").agg(F.count(F.lit(1)).alias("w")).persist()
    try:
        a, b = math.log(lo), math.log(hi)
        for _ in range(passes):
            grid = [a + (b - a) * i / (points - 1) for i in range(points)]
            cols = []
            for i, g in enumerate(grid):
                t = math.exp(g)
                cols.append(F.expr(
                    f"sum(w * (array_max(z) / {t!r}D + ln(aggregate(z, 0.0D, (s, v) -> s + exp((v - array_max(z)) / {t!r}D)))"
                    f" - element_at(z, cast(g as int) + 1) / {t!r}D)) / sum(w)").alias(f"l{i}"))
            losses = list(data.agg(*cols).first())
            best = min(range(points), key=losses.__getitem__)
            a, b = grid[max(best - 1, 0)], grid[min(best + 1, points - 1)]
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame([(t := math.exp((a + b) / 2), not lo * 1.01 < t < hi / 1.01)], "temperature double, at_bound boolean")
