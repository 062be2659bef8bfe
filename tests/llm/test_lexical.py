import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from callscope.llm import lexical as lx
from helpers import SF, docs, needs_data, rows, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return Counter(TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or "")))


def brute(given, items, k=20):
    """Every document scored for every item."""
    have = [(i, terms(t)) for i, t in given]
    have = [(i, t, t.total()) for i, t in have if t]
    n_docs, total = len(have), sum(h[2] for h in have)
    df = Counter(t for _, x, _ in have for t in x)
    said = {}
    for i, t in items:
        if i is not None and t is not None:
            said[i] = min(said.get(i, t).encode(), t.encode()).decode()
    out = []
    for item, t in said.items():
        scored = []
        for doc, x, n in have:
            m = 100 - 25 + 25 * n * n_docs // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * x[w] // (1000 * x[w] + 12 * m)) for w, q in terms(t).items() if w in x)
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:k])]
    return out


def cases(n=300):
    rnd = random.Random(6)
    vocabulary = [[f"{p}{i}" for i in range(60)] for p in ("Al", "bé", "漢", "x")]
    text = lambda words, most: " ".join(rnd.choice(words[:1 + rnd.randint(0, 59)]) for _ in range(rnd.randint(1, most)))
    given = [(k, text(vocabulary[k % 4], 80)) for k in range(n)]
    given += [(1000 + k, given[5][1]) for k in range(40)]  # ties
    given += [(7, given[7][1]), (None, given[5][1]), (None, "al1 al2"), (2000, None), (2001, ""), (2002, "!?"), (2003, "Al1 " * 5000)]
    items = [(k, text(vocabulary[k % 4], 30)) for k in range(50)] + [(60, given[5][1]), (61, "nothing of it"), (62, None), (63, ""), (None, "al1 al2"), (64, "al1 al2"), (64, "al2 al1 x1")]
    return given, items


@pytest.mark.parametrize("sizes", [(2048, 64, 8, 1 << 16), (64, 4, 3, 90), (7, 2, 2, 1)])
def test_equals_brute_force(spark, monkeypatch, sizes):
    """Also with many chunks, leaves and item batches, and with k so large that all documents are returned."""
    for name, value in zip(("CHUNK", "LEAF", "FAN", "TERMS"), sizes):
        monkeypatch.setattr(lx, name, value)
    given, items = cases()
    items = items if sizes[-1] > 1 else items[45:]  # a batch for each item
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS said", "2 AS score")
    wide = docs(spark, given).selectExpr("*", "1 AS id", "2 AS item_id", "map(1, 2) AS rank").repartition(3)
    for k in (20, 1) if sizes[-1] > 1 else (20,):
        assert sorted(map(repr, rows(lx.ranked(wide, bench, k=k)))) == sorted(map(repr, brute(given, items, k)))


def test_fewer_documents_than_asked_and_empty_tables(spark):
    given, items = cases(6)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(repr, rows(lx.ranked(docs(spark, given), bench, k=500)))) == sorted(map(repr, brute(given, items, 500)))
    assert rows(lx.ranked(docs(spark, given).limit(0), bench)) == [] and rows(lx.ranked(docs(spark, given), bench.limit(0))) == []
    assert rows(lx.ranked(docs(spark, [(1, None), (2, "?")]), bench)) == []


def test_bounds_hold_and_prune():
    """No pair scores more than the product of its nodes' maxima, and most pairs are never scored."""
    rnd = np.random.default_rng(2)
    told = [(k, Counter({f"t{(k % 4) * 50 + int(x)}".encode(): 1 for x in rnd.integers(0, 50, 12)})) for k in range(64)]
    number = {t: i for i, t in enumerate(sorted({t for _, c in told for t in c}))}
    tree = lx.item_tree(told, number, rnd.integers(100, 9000, len(number)))
    own = [np.array([number[f"t{i}".encode()] for i in range(g * 50, g * 50 + 50) if f"t{i}".encode() in number]) for g in range(4)]
    sets = [np.unique(rnd.choice(own[d * 4 // 2048], 10)) for d in range(2048)]
    packed = lx._pack(np.array([40 + d % 7 for d in range(2048)]), np.array([len(s) for s in sets]), np.concatenate(sets), rnd.integers(1, 4, sum(map(len, sets))))
    chunk = lx.Chunk(list(range(2048)), packed, 2048, 2048 * 43, len(number))
    every = np.array([[chunk.scores(k, v) for k in range(32)] for v in tree.vectors]).reshape(len(told), -1)
    todo = [tree.root]
    while todo:
        node = todo.pop()
        todo += node.below
        for level, size in zip(chunk.levels, (2048, 512, 64)):
            bound = level[:, node.terms] @ node.most
            assert (every[node.first:node.last].max(axis=0).reshape(-1, size).max(axis=1) <= bound).all()
    calls = []

    class Counted(lx.Best):
        def add(self, item, chunk, leaf):
            calls.append((item, leaf))
            super().add(item, chunk, leaf)
    best = Counted(tree, 5, np.ones(64, np.int64))
    lx.dual(best, chunk)
    assert len(calls) < 64 * 32 / 3
    for i, held in enumerate(best.held):
        assert [-h[0] for h in held] == sorted(every[i].tolist(), reverse=True)[:5]


@needs_data
def test_query_equals_brute_force(spark):
    from callscope.llm.queries import QUERIES
    given = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    assert sorted(rows(QUERIES["op11_lexical"](spark, SF))) == sorted(brute(given, [(r.item_id, r.text) for r in table(spark, "benchmark").collect()]))
