"""Columns that have the names used inside, or hold maps, come out as they went in."""
import pytest

import corpus_pipeline
from callscope.llm import linetree, mix
from helpers import docs

EXTRA = ["7 AS _row", "8 AS _copies", "9 AS _copy", "10 AS _th", "11 AS _drop", "12 AS _name", "map('k', 13) AS notes"]


@pytest.mark.parametrize("work", [mix.mix_rows, lambda d: linetree.drop_lines(d).drop("n_lines", "n_dropped"), lambda d: corpus_pipeline.one_of_near_copies(d.sparkSession, d, "")])
def test_users_columns_stay(spark, work):
    d = docs(spark, [(1, "one two three"), (2, "four five six seven"), (None, "eight nine ten")]).selectExpr("*", *EXTRA)
    got = work(d)
    assert got.columns == d.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, d.collect()))
    assert work(d.limit(0)).collect() == []
