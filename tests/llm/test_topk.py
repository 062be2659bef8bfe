import math

import numpy as np

from callscope.llm import topk
from helpers import SF, needs_data, rows, table

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(data, k, every, scale=64):
    sound = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in data
             if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in sound:
        if q % every:
            continue
        best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in sound if i != q and len(b) == len(a))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_odd_vectors_ties_and_few_candidates(spark, monkeypatch):
    monkeypatch.setattr(topk, "BINS", 8)
    monkeypatch.setattr(topk, "CANDIDATES", 4)
    monkeypatch.setattr(topk, "QUERIES", 2)
    data = [(0, [0.5, -0.25]), (20, [1.0, 2.0]), (40, None), (60, [float("nan"), 1.0]), (80, [None, 1.0]), (3, [float("inf"), 0.0]), (100, []),
            (None, [1.0, 1.0]), (120, [0.1, 0.2, 0.3]), (140, [-900.0, 700.0])] + [(i, [0.25, 0.25]) for i in range(5, 16)] + [(200, [0.01, -0.01])]
    df = spark.createDataFrame([(i, v, 0) for i, v in data], SCHEMA)
    for k in (3, 50):
        assert sorted(rows(topk.top_k(df, k=k))) == brute(data, k, 20)
    assert rows(topk.top_k(df.limit(0))) == []


def test_large_components_stay_exact(spark):
    data = [(0, [3e6, -2e6]), (20, [2e6, 2e6 + 1])] + [(i, [1e6 + i, 1e6 - i]) for i in range(1, 9)]
    df = spark.createDataFrame([(i, v, 0) for i, v in data], "vec_id long, embedding array<double>, label int")
    sound = [(i, [math.floor(64 * x) for x in v]) for i, v in data]
    want = []
    for q, a in sound:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in sound if i != q)[:4]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(rows(topk.top_k(df, k=4))) == sorted(want)


@needs_data
def test_query_equals_brute_force(spark):
    from callscope.llm.queries import QUERIES
    data = [(r.vec_id, r.embedding) for r in table(spark, "embeddings").collect()]
    assert sorted(rows(QUERIES["op4_top_k"](spark, SF))) == brute(data, 20, 20)
