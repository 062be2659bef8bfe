from callscope.llm import linetree as lt
from callscope.llm.shared import likely
from helpers import docs, rows


def test_no_key_is_lost_and_few_others_pass(spark):
    given = spark.range(20000).selectExpr("id AS k", "id AS _row", "'x' AS _bits").union(spark.sql("SELECT CAST(NULL AS BIGINT), 1L, 'x'"))
    keys = spark.range(0, 20000, 40).selectExpr("id AS k")
    got = rows(likely(given, keys, "k"))
    wanted = set(range(0, 20000, 40))
    assert wanted <= {r[0] for r in got} and len(got) < len(wanted) + 20 and all(r[0] == r[1] for r in got)
    assert rows(likely(given, keys.limit(0), "k")) == []


def test_bands_find_the_copies_that_all_candidates_find(spark):
    base = [" ".join(f"w{i}x{j}" for j in range(60 + i)) for i in range(40)]
    given = [(i * 10 + v, t.replace(f"x{v * 7 + 3} ", f"y{v} ", 1)) for i, t in enumerate(base) for v in range(5)]
    given += [(900, ""), (901, None), (902, "two words"), (903, "Two  words"), (904, base[0] + "\n" + base[1])]
    table = docs(spark, given)
    fast, exact = (sorted(map(repr, rows(lt.drop_lines(table, exact=e).select("doc_id", "text", "n_lines", "n_dropped")))) for e in (False, True))
    assert fast == exact
