import re
from collections import Counter

import pytest

from callscope.llm import mix
from helpers import SF, docs, needs_data, rows, table


def brute_targets(sizes, total, weights=(1, 2, 3), most=3):
    """Share by weight; clamp what is above its limit; reshare the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, target = set(), {}
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else left * w[s] / free for s in names}
        over = {s for s in names if s not in capped and target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def check(given, got):
    size = {(i, t): len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in given}
    sizes, biggest = Counter(), Counter()
    for i, t, s in given:
        sizes[s] += size[i, t]
        biggest[s] = max(biggest[s], size[i, t])
    target = brute_targets(sizes, sum(sizes.values()))
    by_id = {i: (t, s) for i, t, s in given}
    taken = Counter()
    for i, n, of, goal, words in got:
        t, s = by_id[i]
        assert (n, of) == (size[i, t], sizes[s]) and goal == pytest.approx(target[s], rel=1e-9, abs=1e-6)
        assert 0 <= words <= 3 * n and (n == 0 or words % n == 0)
        taken[s] += words
    for s in sizes:
        assert abs(taken[s] - target[s]) <= biggest[s] / 2 + 1e-6, s
    # complete epochs precede the fraction: copies in a source differ by one at most
    for s in sizes:
        copies = {words // n for i, n, _, _, words in got if n and by_id[i][1] == s}
        assert not copies or max(copies) - min(copies) <= 1


def test_odd_rows(spark):
    given = [(k, "w " * (k % 7 + 1), s) for k, s in enumerate(["a"] * 40 + ["b"] * 3 + ["é"] * 2 + ["Z"] * 9 + [None] * 6)]
    given += [(100, None, "a"), (101, " \n", "empty"), (102, "x" * 5000, "b"), (103, "w " * 900, None)]
    d = docs(spark, given)
    got = rows(mix.mix_report(d))
    check(given, got)
    assert sorted(got) == sorted(rows(mix.mix_report(d.repartition(5, "text"))))


def test_repeated_rows_and_empty_tables(spark):
    d = docs(spark, [(1, "a b c", "s")] * 4 + [(None, "x y", "t")] * 2)
    got = rows(mix.mix_report(d))
    assert len(got) == 6 and {r[2] for r in got if r[0] == 1} == {12}
    assert rows(mix.mix_report(d.limit(0))) == [] and rows(mix.mix_rows(d.limit(0))) == []
    assert {r[4] for r in rows(mix.mix_report(docs(spark, [(1, None), (2, " ")])))} == {0}


def test_better_documents_come_more_often(spark):
    d = docs(spark, [(k, ("word " if k % 2 else "12345 ") * 20, "a") for k in range(2000)] + [(5000 + k, "w " * 400, "b") for k in range(50)])
    got = mix.mix_report(d, weights=(1, 1)).where("doc_id < 2000 AND taken > 0").collect()
    assert sum(r.doc_id % 2 for r in got) > 1.5 * sum(1 - r.doc_id % 2 for r in got)


def test_rows_keep_every_document(spark):
    given = [(k, f"text {k} " * 30, "hot") for k in range(60)] + [(100 + k, f"rare {k}", "rare") for k in range(5)] + [(300, "", "hot")] + [(7, "text 7 " * 30, "hot")]
    d = docs(spark, given).selectExpr("*", "1 AS _extra")
    got = rows(mix.mix_rows(d))
    times = Counter(r[0] for r in got)
    assert set(times) == {i for i, _, _ in given} and max(times.values()) <= 6
    assert times[7] == 2 and times[8] == 1 and all(times[100 + k] > 1 for k in range(5)) and len(got[0]) == 6


@needs_data
def test_query_meets_the_contract(spark):
    from callscope.llm.queries import QUERIES
    given = [(r.doc_id, r.text, r.source) for r in table(spark, "documents").collect()]
    check(given, rows(QUERIES["op1_mix"](spark, SF)))


def word_sizes(given):
    out = Counter()
    for t, s in given:
        out[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    return out
