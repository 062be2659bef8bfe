from pyspark.sql import functions as F

from callscope.operators.lookup import dealt_lookup


def test_one_key_reaches_many_tasks_and_rows_stay(spark):
    calls = spark.range(4000).selectExpr("id", "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 50 = 1 THEN 'none' ELSE 'a' END AS tool", "array(id) AS v")
    found = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "tool string, x int").hint("merge")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = dealt_lookup(calls, found, "tool")
        tasks = got.where("tool = 'a'").select(F.spark_partition_id().alias("p")).distinct().count()
        rows = sorted(((r["id"], r["x"]) for r in got.collect()), key=repr)
        want = sorted(((r["id"], r["x"]) for r in calls.join(found, "tool", "left").collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got.columns == ["tool", "id", "v", "x"] and rows == want and tasks >= 8
