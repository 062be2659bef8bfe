import hashlib
import re

import xxhash

from callscope.llm import fingerprint as fp
from helpers import SF, docs, needs_data, rows, table
from pyspark.sql import functions as F


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def chain(words, seed=42):
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed


def brute_sketch(text, k=fp.K):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if len(w) >= 5:
        hashes = {chain(w[i:i + 5]) for i in range(len(w) - 4)}
    else:
        hashes = {chain([*w, "short"])} if w else set()
    return sorted(map(signed, hashes))[:k]


def likeness(a, b, k=fp.K):
    either = sorted({*a, *b})[:k]
    return len({*either} & {*a} & {*b}) / len(either) if either else 1.0


def brute(given):
    order = sorted(((i, t or "") for i, t in given), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        changed = t[:len(t) - half] + following[:half]
        a, b, c = brute_sketch(t), brute_sketch(changed), brute_sketch(following)
        hexed = lambda s: "".join(f"{x % 2**64:016x}" for x in s)
        out.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), hexed(a), hexed(b), likeness(a, b), likeness(a, c)))
    return out


def same(got, want):
    key = lambda r: repr((r[:5], round(r[5], 9), round(r[6], 9)))
    assert sorted(map(key, (r[:7] for r in got))) == sorted(map(key, want))


def test_odd_rows(spark):
    given = [(5, "one two three four five six seven"), (-2, "ONE two three four five six"), (9, None), (11, ""), (12, " \n\t"), (40, "a"), (41, "🙂🙂🙂 b c"), (None, "none at all"),
             (5, "another five"), (77, "x y " * 4000), (78, "x y " * 4000), (90, " ".join(f"w{k}" for k in range(900)))]
    d = docs(spark, given).selectExpr("*", "1 AS _range", "2 AS next_text")
    same(rows(fp.fingerprints(d)), brute(given))
    same(rows(fp.fingerprints(docs(spark, [(1, "all alone in here")]))), brute([(1, "all alone in here")]))
    assert rows(fp.fingerprints(d.limit(0))) == []


def test_parts_merge_into_the_whole_and_estimates(spark):
    words = [f"w{k}" for k in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    parts = [("a", " ".join(words[lo:lo + 504])) for lo in range(0, 1996, 500)] + [("b", b), ("none", None)]
    d = spark.createDataFrame(parts, "k string, text string").select("k", fp.sketch(F.col("text")).alias("sketch"))
    got = {r.k: r.sketch for r in fp.merge_sketches(d, ["k"]).collect()}
    assert got["a"] == brute_sketch(" ".join(words[:2004])) and got["b"] == brute_sketch(b) and got["none"] == []
    one = spark.createDataFrame([(a, b)], "a string, b string").select(fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b"))
    r = one.select(fp.resemblance(F.col("a"), F.col("b")).alias("r"), fp.containment(F.col("a"), F.col("b")).alias("c"),
                   fp.distinct_shingles(F.col("a")).alias("n")).first()
    assert abs(r.r - 1 / 3) < .1 and abs(r.c - .5) < .15 and abs(r.n - 1996) < 400


@needs_data
def test_query_equals_brute_force(spark):
    from callscope.llm.queries import QUERIES
    same(rows(QUERIES["op2_fingerprints"](spark, SF)), brute([(r.doc_id, r.text) for r in table(spark, "documents").collect()]))
