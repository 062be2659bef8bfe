"""What recurs and what stays, rule by rule."""
import random

from callscope.llm import linetree as lt
from helpers import docs, rows
from test_linetree import prose


def cut(spark, given):
    return {r[0]: r[1:] for r in rows(lt.drop_lines(docs(spark, given)).select("doc_id", "text", "n_dropped"))}


def test_copies_below_the_threshold_of_the_jaccard_join_are_sightings(spark):
    rnd = random.Random(8)
    common, passage = prose(rnd, 150), prose(rnd, 20)  # any two texts resemble each other by .66 or so
    got = cut(spark, [(k, "\n".join([common, passage, prose(rnd, 40)])) for k in range(8)])
    assert all(passage not in t and common not in t and n == 2 for t, n in got.values())


def test_short_documents_of_common_passages_are_sightings(spark):
    rnd = random.Random(9)
    head, foot = [prose(rnd, 15) for _ in range(3)], [prose(rnd, 15) for _ in range(3)]
    got = cut(spark, [(9 * a + 3 * b + c, "\n".join([head[a], prose(rnd, 12), foot[b]])) for a in range(3) for b in range(3) for c in range(3)])
    assert all(n == 2 for _, n in got.values())


def test_a_group_of_copies_shields_no_passage(spark):
    rnd = random.Random(10)
    passage, body = prose(rnd, 12), [prose(rnd, 50) for _ in range(6)]
    given = [(k, "\n".join([prose(rnd, 60), passage, prose(rnd, 60)])) for k in range(10)]
    given += [(100 + k, "\n".join([*body, passage, prose(rnd, 2)])) for k in range(30)]  # near copies
    got = cut(spark, given)
    assert all(passage not in t and n == 1 for t, n in got.values())


def test_long_lines_recur_from_two_documents_on(spark):
    rnd = random.Random(11)
    twice, thrice, short, body = prose(rnd, 55), prose(rnd, 20), prose(rnd, 19), [prose(rnd, 50) for _ in range(6)]
    given = [(k, "\n".join([prose(rnd, 60), *[twice] * (k < 2), thrice, short, prose(rnd, 60)])) for k in range(3)]
    given += [(100 + k, "\n".join([*body, prose(rnd, 2)])) for k in range(5)]  # near copies alone
    got = cut(spark, given)
    assert all(twice not in t and thrice not in t and short in t for i, (t, _) in got.items() if i < 3)
    assert [got[i][1] for i in range(3)] == [2, 2, 1] and all(got[i][1] == 0 for i in range(100, 105))


def test_leading_tokens_of_a_leaf_are_no_evidence(spark):
    rnd = random.Random(12)
    given = [(k, "\n".join([prose(rnd, 60), f"It was the {prose(rnd, 1)}", f"In the end {prose(rnd, 2)}", f"Share this with {prose(rnd, 1)} and all friends"]))
             for k in range(12)]
    got = cut(spark, given)
    assert all("It was the" in t and "In the end" in t and "Share this" not in t and n == 1 for t, n in got.values())
