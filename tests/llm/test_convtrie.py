import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from callscope.llm import convtrie as trie
from helpers import SF, needs_data, rows, table

SCHEMA = "conv_id long, turn long, role string, text string"


def listed(given):
    turns = defaultdict(list)
    for c, turn, role, text in given:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}


def regrouped(turns):
    out = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + t[h:]
    return out


def brute(conversations):
    """Nodes as a dictionary of paths; sums over subtrees from the deepest up."""
    members = defaultdict(list)
    for c, t in conversations.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    out, leaves, saved = [], {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0) + sum(saved[k] for k in kids[path])
        ends = sorted(c for c in members[path] if len(conversations[c]) == len(path))
        out.append((min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(kids[path]), leaves[path], saved[path],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def cases():
    rnd = random.Random(8)
    words = ["", "é", "yes", "no", "long text " * 20]
    given = []
    for c in range(120):
        for t in range(rnd.randint(1, 7)):
            given.append((c, t if rnd.random() < .9 else None, rnd.choice(["user", None, "assistant"]), rnd.choice([*words, None])))
    given += [(200 + k, t, "user", "hello") for k in range(30) for t in range(12)]  # copies
    given += [(300 + k, t, "user", "hello" if t < 11 else f"end {k}") for k in range(25) for t in range(13)]  # one long common beginning
    given += [(5001, t, "user", f"turn {t}") for t in range(400)]  # far longer than the others
    given += [(6002, 0, "x", "alone"), (6003, 0, "x", "alone"), (None, 0, "x", "no id"), (7, 3, "user", "twice"), (7, 3, "user", "twice"), (-4, 0, "a", "b")]
    rnd.shuffle(given)
    return given


@pytest.mark.parametrize("burst", [1, 20, 150, 4096])
def test_bursting_changes_no_node(spark, monkeypatch, burst):
    monkeypatch.setattr(trie, "PIECE", 7)
    given = cases()
    if burst < 20:
        given = [g for g in given if g[0] != 5001]  # each of its 400 turns would be a head of its own
    df = spark.createDataFrame(given, SCHEMA).selectExpr("*", "1 AS at", "2 AS depth", "map(1, 2) AS h1")
    got = trie.prefix_trie(df, burst)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(repr, rows(got))) == sorted(map(repr, brute(listed(given))))


@pytest.mark.parametrize("burst", [30, 4096])
def test_rebuilt_conversations(spark, burst):
    """Also conversations whose group's first is absent, some of them left without turns."""
    given = [g for g in cases() if g[0] not in (5, 10, 15, 20, 25, 30)]
    rest, members = trie.rebuilt(trie.ordered(spark.createDataFrame(given, SCHEMA)))
    want = regrouped(listed(given))
    assert [] in want.values()
    assert sorted(map(repr, rows(trie.trie_nodes(rest, members, burst)))) == sorted(map(repr, brute(want)))


def test_nothing_given(spark):
    assert rows(trie.prefix_trie(spark.createDataFrame([], SCHEMA))) == []
    assert rows(trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))) == []


@needs_data
def test_query_equals_brute_force(spark):
    from callscope.llm.queries import QUERIES
    given = [tuple(r) for r in table(spark, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(repr, rows(QUERIES["op13_prefix_trie"](spark, SF)))) == sorted(map(repr, brute(regrouped(listed(given)))))
