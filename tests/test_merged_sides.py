"""Tasks and families are merged, not broadcast by the size of the file they are derived from."""
import datetime as dt

from callscope.operators import splits as sp
from callscope.plans.queries_scoring import score_schema_errors


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_are_merged(spark, tmp_path):
    spark.createDataFrame([(i, dt.datetime(2024, 1, 1), i, "click", 1.5, '{"k": 1}') for i in range(20)],
                          "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    plan = plan_of(score_schema_errors(spark, str(tmp_path)))
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin [task_id" in line]


def test_families_are_merged(spark):
    rows = spark.createDataFrame([("a", "f", "h"), ("b", "f", "s"), ("c", "g", "s"), ("d", None, "s")], "schema_id string, family string, subset string")
    got = sp.family_split(rows, ["h"], 1, 0.0)
    assert "BroadcastHashJoin" not in plan_of(got)
    assert {r.schema_id: r.split for r in got.collect()} == {"a": "holdout_family", "b": "holdout_family", "c": "train"}
