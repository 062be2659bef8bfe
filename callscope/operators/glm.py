"""Logistic regression with cluster-robust errors from aggregates."""
from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def token_glm(results: DataFrame, arms: list[str], cluster: str = "intent_id", tokens: str = "prompt_tokens",
              metric: str = "e2e_success", steps: int = 100) -> DataFrame:
    """success ~ 1 + ln(tokens) + arm (first arm is the reference), logit link.

    Newton steps run on the table of distinct covariate rows; the robust middle matrix is a sum of
    score outer products over clusters. Only k x k matrices reach the driver. ``converged`` says whether the steps
    became small; a separable sample has no finite fit and is marked so.
    """
    names = ["const", "log_input_tokens"] + [f"arm[{a}]" for a in arms[1:]]
    k = len(names)
    rows = results.where(F.col(tokens) > 0).select(
        F.lit(1.0).alias("x0"), F.log(F.col(tokens).cast("double")).alias("x1"),
        *[(F.col("arm") == a).cast("double").alias(f"x{i + 2}") for i, a in enumerate(arms[1:])],
        F.col(metric).cast("double").alias("y"), F.col(cluster).alias("c"))
    xs = [f"x{i}" for i in range(k)]
    cells = rows.groupBy(*xs).agg(F.count(F.lit(1)).alias("w"), F.sum("y").alias("s")).persist()

    def eta(beta):
        return " + ".join(f"({b!r}D * {x})" for b, x in zip(beta, xs))

    def moments(beta):
        mu = f"(1 / (1 + exp(-({eta(beta)}))))"
        exprs = [f"sum(w * {mu} * (1 - {mu}) * {xs[i]} * {xs[j]})" for i in range(k) for j in range(i, k)]
        exprs += [f"sum((s - w * {mu}) * {x})" for x in xs]
        row = list(cells.agg(*[F.expr(e).alias(f"m{n}") for n, e in enumerate(exprs)]).first())
        info = np.zeros((k, k))
        it = iter(row)
        for i in range(k):
            for j in range(i, k):
                info[i, j] = info[j, i] = next(it)
        return info, np.array(list(it))

    beta, converged = [0.0] * k, False
    for _ in range(steps):
        info, grad = moments(beta)
        step = np.linalg.pinv(info) @ grad
        beta = [float(b + s) for b, s in zip(beta, step)]
        if max(abs(step)) < 1e-10:
            converged = True
            break
    info, _ = moments(beta)
    rank = int(np.linalg.matrix_rank(info))
    mu = f"(1 / (1 + exp(-({eta(beta)}))))"
    score = rows.groupBy("c").agg(*[F.expr(f"sum((y - {mu}) * {x})").alias(f"u{i}") for i, x in enumerate(xs)],
                                  F.count(F.lit(1)).alias("m"))
    agg = score.agg(F.count(F.lit(1)).alias("g"), F.sum("m").alias("n"),
                    *[F.sum(F.expr(f"u{i} * u{j}")).alias(f"q{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    meat = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            meat[i, j] = meat[j, i] = agg[f"q{i}_{j}"]
    bread = np.linalg.pinv(info)
    g, n = agg["g"], agg["n"]
    cov = bread @ meat @ bread * (g / (g - 1) * (n - 1) / (n - k) if g > 1 and n > k else 1.0)
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    cells.unpersist()
    out = [(names[i], beta[i], float(se[i]),
            math.erfc(abs(beta[i] / se[i]) / math.sqrt(2)) if se[i] > 0 else None, rank < k, converged) for i in range(k)]
    return results.sparkSession.createDataFrame(out, "term string, coef double, se double, p double, rank_deficient boolean, converged boolean")
