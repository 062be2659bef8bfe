import random
from collections import Counter, defaultdict

from callscope.llm import linetree as lt
from helpers import SF, docs, needs_data, rows, table
from test_jaccard import brute as groups


def brute(given, sightings=lt.SIGHTINGS, long_sightings=lt.LONG_SIGHTINGS):
    """The definition over dictionaries: groups of near copies, leaves, constant tokens, templates, long lines."""
    texts = sorted({t for _, t in given if t is not None})
    group = [c for _, _, c in groups(list(enumerate(texts)), lt.SHINGLE, lt.NEAR_NUM, lt.NEAR_DEN)]
    size = Counter(group)
    weight = {t: 1 / size[c] for t, c in zip(texts, group, strict=True)}
    leaf_of = lambda k: (len(k), *k[:lt.DEPTH])
    lines = {t: {tuple(lt.masked_tokens(x)) for x in t.split("\n")} - {()} for t in texts}
    leaf, seen = defaultdict(float), defaultdict(float)
    for t in texts:
        for f in {leaf_of(k) for k in lines[t]}:
            leaf[f] += weight[t]
        for k in lines[t]:
            seen[k] += weight[t]
    long = {k for k, s in seen.items() if len(k) - k.count(lt.VARIABLE) >= lt.LONG and s >= long_sightings - 1e-9}
    alive = {k for k in seen if leaf[leaf_of(k)] >= sightings - 1e-9}
    token = defaultdict(float)
    for k in alive:
        for p, x in enumerate(k):
            token[leaf_of(k), p, x] += seen[k]
    template = {}
    for k in alive:
        firm = [x != lt.VARIABLE and token[leaf_of(k), p, x] >= sightings - 1e-9 for p, x in enumerate(k)]
        behind = firm[lt.DEPTH:]
        general = behind and sum(behind) / len(behind) >= lt.CONSTANT
        template[k] = (leaf_of(k), tuple(x if f else lt.VARIABLE for x, f in zip(k, firm))) if general else k
    total = defaultdict(float)
    for t in texts:
        for m in {template[k] for k in lines[t] if k in alive}:
            total[m] += weight[t]
    drop = {k for k in alive if total[template[k]] >= sightings - 1e-9} | long
    out = []
    for i, t in given:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        split = t.split("\n")
        keep = [x for x in split if tuple(lt.masked_tokens(x)) not in drop]
        out.append((i, "\n".join(keep), len(split), len(split) - len(keep)))
    return out


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def test_templates_go_and_copies_stay(spark):
    rnd = random.Random(4)
    given = []
    for k in range(40):
        body = [prose(rnd, 60) for _ in range(4)]
        body.insert(k % 4, f"Page {k} of {k + 7}, printed by {rnd.choice(['Ann', 'Bob', 'Cy', 'Di', 'Ed', 'Flo'])} for all readers")
        if k % 2:
            body.append("All rights reserved.")
        given.append((k, "\n".join(body)))
    base = [prose(rnd, 50) for _ in range(6)]
    for k in range(30):  # near copies: some words of one line differ
        words = base[k % 6].split()
        words[5 + k % 9] = "edit" + chr(65 + k)
        given.append((100 + k, "\n".join(base[:k % 6] + [" ".join(words)] + base[k % 6 + 1:])))
    given += [(200 + k, "\n".join(base)) for k in range(9)] + [(300, None), (301, ""), (302, "\n\n"), (None, prose(rnd, 30)), (303, "All rights reserved.")]
    passage = prose(rnd, 55)
    given += [(400 + k, "\n".join([prose(rnd, 90), passage, prose(rnd, 80)])) for k in range(6)]
    got = rows(lt.drop_lines(docs(spark, given)).select("doc_id", "text", "n_lines", "n_dropped"))
    assert sorted(map(repr, got)) == sorted(map(repr, brute(given)))
    by = {r[0]: r for r in got}
    assert all("rights reserved" not in by[k][1] and "Page" not in by[k][1] and by[k][3] == 1 + k % 2 for k in range(40))
    assert all(by[k][3] == 0 for k in [*range(100, 130), *range(200, 209)])
    assert all(passage not in by[k][1] and by[k][3] == 1 for k in range(400, 406)) and by[303][1] == "" and by[302][1] == "\n\n"


def test_extra_columns_and_empty_table(spark):
    d = docs(spark, [(1, "a\nb")]).selectExpr("*", "1 AS n_lines", "2 AS drop", "3 AS th")
    got = lt.drop_lines(d)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "drop", "th", "n_lines", "n_dropped"]
    assert rows(got.select("text", "n_lines", "n_dropped", "drop", "th")) == [("a\nb", 2, 0, 2, 3)]
    assert rows(lt.drop_lines(d.limit(0))) == []


@needs_data
def test_query_equals_brute_force(spark):
    from callscope.llm.queries import QUERIES
    given = [(r.doc_id, r.text) for r in table(spark, "documents").collect()]
    assert sorted(rows(QUERIES["op6_line_templates"](spark, SF))) == sorted(brute(given))
