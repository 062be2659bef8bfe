"""The end-to-end question: score raw outputs, then compare two arms as pairs."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.operators import scoring as sc
from callscope.operators import stats as st
from callscope.operators.corpus import schema_property_names
from callscope.operators.schemarules import schema_rules
from callscope.plans.fixtures import KINDS, fixture, spread


def tool_inputs(spark: SparkSession, sf: str):
    """Rule rows and known property names per tool."""
    schemas = fixture(spark, sf, "fx_tool_schemas")
    return schema_rules(schemas), schema_property_names(schemas, ("tool_name",))


def catalogs(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return (fixture(spark, sf, "fx_results_key").select("catalog_key").distinct()
            .withColumn("catalog_tools", F.expr(
                f"CASE WHEN startswith(catalog_key, 'single:') THEN array(substr(catalog_key, 8)) ELSE array({kinds}) END")))


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    t = (spread(fixture(spark, sf, "fx_task_rows").select("task_id", "tool_name", "gold_args"))
         .withColumn("unordered_paths", F.array(F.lit("tags"))))
    return sc.prepare_tasks(t, variants=None)


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(fixture(spark, sf, "fx_results").drop("tool_name", "kind", "k", "cents"))


def scored(spark: SparkSession, sf: str, family: str | None = None) -> DataFrame:
    """Scored outputs; a family filter goes in before scoring so that only its rows are parsed."""
    rules, names = tool_inputs(spark, sf)
    out = outputs(spark, sf)
    return sc.score(out.where(F.col("family") == family) if family else out, tasks(spark, sf), rules, catalogs(spark, sf), names)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    plan = [dict(name="min vs raw, end to end", a="raw", b="min", metric="e2e_success", primary=True),
            dict(name="min vs raw, tool choice", a="raw", b="min", metric="tool_correct"),
            dict(name="min vs raw, schema", a="raw", b="min", metric="schema_valid")]
    facts = scored(spark, sf, "select").select(
        "catalog_id", "task_id", "replicate", "size", "stratum", "family", "arm", "e2e_success", "tool_correct", "schema_valid")
    return st.run_comparisons(facts, plan).select(
        "name", "n_pairs", "acc_a", "acc_b", "diff_pp", "ci_low", "ci_high", "discordant_a_only", "discordant_b_only",
        "mcnemar_p", "holm_p", "odds_ratio", "or_low", "or_high")
