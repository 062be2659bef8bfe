import random
import re

import numpy as np
import pytest

from callscope.llm import contamination as ct
from callscope.llm import shared
from helpers import SF, docs, needs_data, rows, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(given, items, size=10):
    """Every window of every item against every place of every text."""
    windows = [(n, words(t)) for n, t in items]
    windows = {(str(n) if n is not None else "none", tuple(w[i:i + size])) for n, w in windows if w for i in range(max(1, len(w) - size + 1))}
    by = {}
    for n, x in windows:
        by.setdefault(x, set()).add(n)
    sizes = {len(x) for x in by}
    out = []
    for i, t in given:
        w, hit, names = words(t), set(), set()
        for s in sizes:
            for k in range(len(w) - s + 1):
                found = by.get(tuple(w[k:k + s]))
                if found:
                    hit |= set(range(k, k + s))
                    names |= found
        out.append((i, len(w), len(hit), sorted(names)))
    return out


def cases():
    rnd = random.Random(3)
    some = lambda n: " ".join(rnd.choice(["Alpha", "beta", "é1", "x9", "ß", "Gamma", "漢字"]) for _ in range(n))
    items = [(1, some(25)), (2, some(10)), (2, some(14)), (3, "Only Three words"), (4, None), (5, ""), (6, "... !"), (None, "nobody owns these words"), (7, "beta"), (10, some(12))]
    given = [(k, f"{some(6)}, {items[k % 3][1].upper() if k % 2 else items[k % 3][1]}.\n{some(5)} only-three, WORDS! {some(3)}") for k in range(12)]
    given += [(50, None), (51, ""), (52, "-- \x7f"), (None, "only three words"), (53, "only three"), (53, "only three"), (54, "nobody owns these words x"), (55, "ÀÉ only three words")]
    return given, items


def test_windows_items_and_spans(spark):
    given, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS n_hit")
    got = ct.contamination(docs(spark, given).selectExpr("*", "3 AS items", "map(1, 2) AS spans"), bench)
    assert got.columns == ["doc_id", "n_words", "n_hit", "items", "spans"]
    out = rows(got)
    assert sorted(map(repr, [r[:4] for r in out])) == sorted(map(repr, brute(given, items)))
    texts = dict(given)
    for i, n, hit, _, spans in out:
        assert hit == sum(s["last"] - s["first"] + 1 for s in spans) <= n
        for s in spans:  # the characters hold the very words
            assert words(texts[i][s["start"]:s["stop"]]) == words(texts[i])[s["first"]:s["last"] + 1]


@pytest.mark.parametrize("bound", [1, 60])
def test_many_batches_equal_one(spark, monkeypatch, bound):
    monkeypatch.setattr(ct, "BOUND", bound)
    given, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows(ct.contamination(docs(spark, given), bench).select("doc_id", "n_words", "n_hit", "items"))
    assert sorted(map(repr, got)) == sorted(map(repr, brute(given, items)))
    kept = rows(ct.decontaminate(docs(spark, given), bench).select("doc_id", "text"))
    clean = [g for g, b in zip(given, brute(given, items)) if not b[2]]
    assert sorted(map(repr, kept)) == sorted(map(repr, clean))


def test_long_texts_are_scanned_in_overlapping_pieces(monkeypatch):
    rnd = random.Random(5)
    item = " ".join(f"w{rnd.randint(0, 3)}" for _ in range(14))
    text = " ".join(f"w{rnd.randint(0, 3)}" for _ in range(300)) + " " + item + " tail " * 40
    m = ct.Machine([("a", item), ("b", "w1 w2")], 10)
    monkeypatch.setattr(ct, "term_pieces", lambda t: shared.term_pieces(t, 7))
    n, ranges, names = m.scan(text)
    want = brute([(0, text)], [("a", item), ("b", "w1 w2")])[0]
    assert (n, sum(z - a + 1 for a, z in ct.merged(ranges)), sorted(names)) == want[1:]
    long = "filler " * 700_000 + item  # more than one piece as it is
    assert ct.Machine([("a", item)], 10).scan(long)[0] == 700_014 and brute([(0, item)], [("a", item)])[0][2] == 14


def test_empty_tables_and_other_columns(spark):
    given, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows(ct.contamination(docs(spark, given).limit(0), bench)) == []
    assert all(r[2] == 0 and r[3] == [] for r in rows(ct.contamination(docs(spark, given), bench.limit(0))))
    wide = docs(spark, given).selectExpr("*", "map('k', doc_id) AS state", "1 AS n_words")
    got = ct.decontaminate(wide, bench)
    assert got.columns == wide.columns and all(r["state"] == {"k": r["doc_id"]} for r in got.collect())
    assert ct.decontaminate(wide, bench.limit(0)).count() == len(given)


def test_spans_of_terms():
    text = "Ünï 12-b\n漢字,x"
    start, stop = shared.term_spans(text)
    assert [text[a:b] for a, b in zip(start, stop)] == ["Ünï", "12", "b", "漢字", "x"] and isinstance(start, np.ndarray)


@needs_data
def test_query_equals_brute_force(spark):
    import hashlib

    from callscope.llm.queries import QUERIES
    given = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    want = brute(given, [(r.item_id, r.text) for r in table(spark, "benchmark").collect()])
    got = rows(QUERIES["op12_contamination"](spark, SF))
    assert sorted(got) == sorted((i, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0) for i, n, h, x in want)
