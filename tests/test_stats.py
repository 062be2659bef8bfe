"""Statistics against published or closed-form values."""
import math

from pyspark.sql import functions as F

from callscope.operators import calibration as cal
from callscope.operators import corpus as co
from callscope.operators import stats as st
from callscope.operators.glm import token_glm
from callscope.operators.ranking import exact_quantiles, running_totals


def test_exact_test_and_odds_ratio(spark):
    rows = [(10, 139, 3.2925632541792714e-30), (14, 10, 0.541256), (14, 43, 0.000154), (0, 0, 1.0), (7, 37, 5.3e-06)]
    df = spark.createDataFrame(rows, "discordant_b_only bigint, discordant_a_only bigint, want double")
    out = st.odds_ratio(df.withColumn("p", st.mcnemar_exact("discordant_b_only", "discordant_a_only"))).collect()
    for r in out:
        assert math.isclose(r.p, r.want, rel_tol=5e-3)
    assert math.isclose(out[0].p, rows[0][2], rel_tol=1e-9)
    assert (round(out[0].odds_ratio, 2), round(out[0].or_low, 2), round(out[0].or_high, 2)) == (0.08, 0.04, 0.14)


def test_exact_test_stays_exact_for_many_pairs(spark):
    r = spark.createDataFrame([(49000, 51000)], "a bigint, b bigint").select(st.mcnemar_exact("a", "b").alias("p")).first()
    n, k = 100000, 49000
    want = 2 * sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)) for i in range(k + 1))
    assert math.isclose(r.p, want, rel_tol=1e-6)


def test_holm_and_power(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "seq int, p double").withColumn("f", F.lit(1))
    assert [round(r.holm_p, 4) for r in st.holm(df, "p", ["f"], "seq").orderBy("seq").collect()] == [0.03, 0.06, 0.06]
    p = st.power_table(spark.createDataFrame([(4.92,)], "design_effect double")).collect()
    assert {(round(r.delta_pp), r.discordant_share): r.pairs_needed for r in p}[(3, 0.1)] == 869


def test_running_totals_and_quantiles(spark):
    rows = [(g, i, (i * 7) % 13) for g in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    got = {(r.g, r.i): r.s for r in running_totals(df, ["g"], ["i"], {"s": "v"}).collect()}
    for g in "ab":
        acc = 0
        for _, i, v in [r for r in rows if r[0] == g]:
            acc += v
            assert got[(g, i)] == acc
    q = exact_quantiles(spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, 10.0)], "v double"), [], "v", {"m": 0.5, "t": 0.75}).first()
    assert (q.m, q.t) == (2.0, 4.0)


def test_temperature_is_recovered(spark):
    import random
    rnd = random.Random(5)
    rows = []
    for _ in range(3000):
        z = [rnd.gauss(0, 1) for _ in range(4)]
        w = [math.exp(v) for v in z]
        rows.append(([3 * v for v in z], rnd.choices(range(4), w)[0]))
    t = cal.fit_temperature(spark.createDataFrame(rows, "z array<double>, gold int"), "z", "gold").first().temperature
    assert abs(t - 3) < 0.3


def test_glm_arm_effect_is_the_log_odds_ratio(spark):
    rows = [("raw", 100, i < 60, i) for i in range(100)] + [("min", 100, i < 40, i) for i in range(100)]
    df = spark.createDataFrame(rows, "arm string, prompt_tokens int, e2e_success boolean, intent_id int")
    out = {r.term: r for r in token_glm(df, ["raw", "min"]).collect()}
    assert math.isclose(out["arm[min]"].coef, math.log((40 / 60) / (60 / 40)), rel_tol=1e-6)
    assert out["const"].rank_deficient  # constant token count


def test_printed_sizes(spark):
    import json
    doc = {"type": "object", "properties": {"a": {"enum": [1.0, "é"]}, "b": {}}, "x": []}
    r = co.doc_sizes(spark.createDataFrame([("s", json.dumps(doc))], "schema_id string, body string")).first()
    assert (r.chars_pretty, r.chars_min) == (len(json.dumps(doc, indent=2, ensure_ascii=False)), len(json.dumps(doc, separators=(",", ":"), ensure_ascii=False)))


def test_reference_status(spark):
    bodies = {"ok": '{"a":{"$ref":"#/definitions/x~1y"},"definitions":{"x/y":{"b":1}}}', "self": '{"a":{"$ref":"#"}}',
              "two": '{"a":{"$ref":"#/d/p"},"d":{"p":{"$ref":"#/d/q"},"q":{"z":[{"$ref":"#/d/p"}]}}}',
              "chain": '{"a":{"$ref":"#/d/p"},"d":{"p":{"$ref":"#/d/q"},"q":{}}}', "far": '{"$ref":"http://x"}', "none": "{}"}
    out = {r.schema_id: r.ref_status for r in co.ref_status(spark.createDataFrame(list(bodies.items()), "schema_id string, body string")).collect()}
    assert out == {"ok": "local_ok", "self": "cyclic", "two": "cyclic", "chain": "local_ok", "far": "nonlocal_or_unresolvable", "none": "none"}
