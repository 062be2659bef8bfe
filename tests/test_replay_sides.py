"""A replay is compared by a merge of narrow rows, not by a broadcast of one side."""
from callscope.operators import integrity as ig


def test_replay_is_merged(spark):
    base = spark.createDataFrame([("x", "a", "1"), ("x", "b", "2"), ("y", "c", None), ("y", "b", "2"), ("y", None, "3")], "arm string, request_key string, raw_content string")
    again = spark.createDataFrame([("a", "1"), ("b", "2."), ("c", None), (None, "3")], "request_key string, raw_content string")
    got = ig.determinism_check(base, again, ["arm"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted(tuple(r) for r in got.collect()) == [("x", 2, 1, "b"), ("y", 2, 1, "b")]
