"""What leads to the rows is done once, not again for the lookup of first holders."""
from pyspark.sql import functions as F

from callscope.operators import corpus as co


def test_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def digest(key):
        made.add(1)
        return {"c": None}.get(key, "s")

    rows = spark.createDataFrame([("a", True, []), ("b", True, []), ("c", True, []), ("d", False, ["x"])], "schema_id string, eligible boolean, exclusion_reasons array<string>")
    got = co.mark_exact_duplicates(rows.withColumn("normalized_sha256", digest("schema_id"))).collect()
    assert {r.schema_id: (r.exclusion_reasons, r.eligible) for r in got} == {
        "a": ([], True), "b": (["exact_duplicate_of:a"], False), "c": ([], True), "d": (["x"], False)}
    assert made.value == 4
