"""Composed reports."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.operators import integrity as ig
from callscope.operators import stats as st


def run_report(results: DataFrame, plan: DataFrame, comparisons: list[dict] | None = None) -> dict[str, DataFrame]:
    """Cells with the completeness flag; comparisons and truncation sensitivity only for a complete run.

    The flag is one row, so reading it decides on the driver without moving data.
    """
    gate = ig.completeness(results, plan)
    cells = results.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), (100 * st.share("e2e_success")).alias("e2e"))
    out = {"cells": cells.join(F.broadcast(gate.select("complete"))).withColumn("paired_inference", F.col("complete"))}
    if comparisons and gate.first()["complete"]:
        out["comparisons"] = st.run_comparisons(results, comparisons)
        for c in comparisons:
            out[f"truncation:{c['name']}"] = st.truncation_sensitivity(results, c["a"], c["b"])
    return out
