import random
import re

import numpy as np

from callscope.llm import jaccard
from helpers import SF, docs, needs_data, rows, table


def shingles(text, size):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(given, size, num, den):
    sets = [(i, shingles(t, size)) for i, t in given]
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and min(len(x), len(y)) * den >= num * max(len(x), len(y)):
                both = len(x & y)
                if den * both >= num * (len(x) + len(y) - both):
                    root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, len(s), low[find(k)]) for k, (i, s) in enumerate(sets))


def family(rnd, n, length, rate, first):
    words = [f"w{rnd.randrange(10**6)}" for _ in range(length)]
    for k in range(n):
        yield first + k, " ".join(w if rnd.random() > rate else f"x{rnd.randrange(10**6)}" for w in words)


def test_near_copies_chains_and_odd_rows(spark, monkeypatch):
    rnd = random.Random(3)
    given = [(900, "One two THREE four"), (901, "one two three four"), (902, "a b"), (903, "A  b\n"), (904, "a"), (905, ""), (906, None), (907, " \t"), (908, "É b"), (909, "é b")]
    at = 0
    for length, rate in ((6, .1), (14, .03), (40, .01), (120, .01), (300, .008), (300, .02), (25, .04)):
        given += list(family(rnd, 40, length, rate, at))
        at += 40
    base = [f"c{k}" for k in range(200)]  # a chain: each differs from the one before by little, the ends by much
    given += [(1000 + k, " ".join(base[4 * k:] + [f"d{j}" for j in range(4 * k)])) for k in range(20)]
    given += [(3, given[13][1]), (2000, given[60][1])]
    d = docs(spark, given)
    for size, num, den in ((3, 9, 10), (5, 4, 5)):
        want = brute(given, size, num, den)
        assert sorted(rows(jaccard.near_components(d, size, num, den))) == want
    monkeypatch.setattr(jaccard, "BLOCK_MEMBERS", 1500)  # families of many blocks
    monkeypatch.setattr(jaccard, "FRAGMENT", 64)
    assert sorted(rows(jaccard.near_components(d, 3, 9, 10))) == brute(given, 3, 9, 10)


def test_rows_without_id_and_empty_table(spark):
    d = docs(spark, [(None, "p q r s"), (5, "p q r s"), (None, "only here it is"), (None, None)])
    got = sorted(rows(jaccard.near_components(d, 3, 9, 10)), key=repr)
    assert got == sorted([(None, 2, 5), (5, 2, 5), (None, 2, None), (None, 0, None)], key=repr)
    assert rows(jaccard.near_components(d.limit(0), 3, 9, 10)) == []


def test_some_equal_fragment_is_sure():
    """Sets as far apart as the threshold allows, with the differences spread against us, still share a signature."""
    rng = np.random.default_rng(1)
    for num, den in ((9, 10), (4, 5)):
        for n in (1, 2, 5, 9, 10, 19, 20, 57, 200, 900):
            for _ in range(6):
                x = np.unique(rng.integers(0, 2**64, n, np.uint64, endpoint=False))
                most = int(n / num * den) - n
                grown = np.concatenate([x, rng.integers(0, 2**64, most, np.uint64)])
                drop = n - -(-num * n // den)
                for y in (np.unique(grown), np.sort(rng.permutation(x)[drop:])):
                    if len(y) and den * min(len(x), len(y)) >= num * max(len(x), len(y)):
                        a, b = (set(jaccard._signatures(s, num, den).tolist()) for s in (x, y))
                        assert a & b, (n, len(y))


@needs_data
def test_query_equals_brute_force(spark):
    from callscope.llm.queries import QUERIES
    given = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    assert sorted(rows(QUERIES["op7_near_components"](spark, SF))) == brute(given, 3, 9, 10)
