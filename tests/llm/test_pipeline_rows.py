"""Stages of the pipeline on rows with repeated ids, without ids, and with blank texts."""
import random

import corpus_pipeline
from helpers import docs, rows
from test_linetree import prose


def test_near_copies_are_judged_row_by_row(spark):
    rnd = random.Random(3)
    a, b, c, d, e = (prose(rnd, 60) for _ in range(5))
    given = [(1, a), (2, a + " end"), (2, b), (2, c + " longer"), (2, b), (None, d), (None, d + " end"), (None, a + " last"), (5, e), (None, e), (6, None), (7, " ")]
    got = rows(corpus_pipeline.one_of_near_copies(spark, docs(spark, given), "").select("doc_id", "text"))
    assert sorted(got, key=repr) == sorted([(1, a), (2, b), (2, c + " longer"), (None, d + " end"), (5, e), (6, None), (7, " ")], key=repr)


def test_documents_of_recurring_lines_and_blank_lines_go(spark):
    rnd = random.Random(5)
    given = [(k, f"{prose(rnd, 60)}\nAll rights reserved.\nRead more here.") for k in range(6)] + [(9, "All rights reserved.\n\n \n\t\nRead more here.")]
    got = rows(corpus_pipeline.drop_recurring_lines(spark, docs(spark, given), "").select("doc_id"))
    assert sorted(got) == [(k,) for k in range(6)]
