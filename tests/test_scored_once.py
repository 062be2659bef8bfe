"""What is read or built once in scoring and comparing."""
from pyspark.sql import functions as F

from callscope.functions.jsontree import strict_variant, tree_nodes
from callscope.operators import scoring as sc
from callscope.operators import stats as st


def test_sums_of_a_plan_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(rows):
        for r in rows:
            seen.add(1)
            yield r
    rows = [("p", i, i % 3, f"t{i}", "raw" if i % 2 else "min", i % 2) for i in range(12)]
    facts = spark.sparkContext.parallelize(rows, 2).mapPartitions(look).toDF("catalog_id string, n int, replicate int, task_id string, arm string, ok int")
    facts = facts.withColumn("task_id", F.expr("concat('t', cast(floor(n / 2) as string))")).selectExpr("*", "1 AS size", "'flat' AS stratum", "'select' AS family")
    out = st.run_comparisons(facts, [dict(name="min vs raw", a="raw", b="min", metric="ok", primary=True)], draws=50).collect()
    assert [r["n_pairs"] for r in out] == [6]
    assert seen.value == 12


def test_a_text_is_parsed_once_for_all_forms_of_trailing_text(spark):
    assert strict_variant("t").count("try_parse_json") == 1
    texts = ['{"a":1}', "null", " [1] ", '{"a":1} x', "1,2", "1],[2", '1,"w2":2', "1}", "", " ", '"x"', "[1", '{"a":1,"a":2}', None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").selectExpr("i", f"to_json({strict_variant('t')}) AS j").orderBy("i").collect()
    assert [r["j"] for r in got] == ['{"a":1}', "null", "[1]", None, None, None, None, None, None, None, '"x"', None, None, None]


def test_equal_trees_and_names_that_look_like_paths(spark):
    """Equal arguments are met field by field all the same where a name could stand for another field."""
    rows = [(0, '{"a":{"b":1},"c":[]}', '{"a":{"b":1},"c":[]}'), (1, '{"a.b":1}', '{"a.b":1}'), (2, '{"a":1.0}', '{"a":1}'), (3, '{"a":1}', None)]
    d = spark.createDataFrame(rows, "i int, gold string, sent string")
    d = d.selectExpr("i", "try_parse_json(gold) AS g", "try_parse_json(sent) AS s").selectExpr(
        "i", f"{tree_nodes('g')} AS gold_nodes", f"CASE WHEN s IS NOT NULL THEN {tree_nodes('s')} END AS arg_nodes", "cast(array() as array<string>) AS unordered_paths",
        "cast(null as map<string,array<struct<kind:string,txt:string,num:double,json:string>>>) AS variants")
    got = sc.receipt_check(sc.compare_fields(d)).selectExpr(
        "i", "transform(fields, f -> concat_ws(':', f.path, f.present, f.exact, f.scalar_ok)) AS f", "extra_paths", "receipt = expected_receipt AS same", "receipt_ok").orderBy("i").collect()
    assert [r["f"] for r in got] == [["a.b:true:true:true", "c:true:true:false"], ["a.b:false:false:false"], ["a:true:true:true"], ["a:false:false:false"]]
    assert [r["extra_paths"] for r in got] == [[], [], [], None]
    assert [r["receipt_ok"] for r in got] == [r["same"] for r in got] == [True, False, True, False]
