from callscope.llm import chat
from helpers import SF, needs_data, rows

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(data, chunk=chat.CHUNK):
    conv = {}
    for c, turn, role, text in data:
        conv.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [x[2:] for x in sorted(v, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))] for c, v in conv.items()}
    out = []
    for c, v in said.items():
        covered = any(o != c and w[:len(v)] == v and (len(w) > len(v) or (c is None, c or 0) > (o is None, o or 0)) for o, w in said.items())
        if covered:
            continue
        for lo in range(0, len(v), chunk):
            text = "".join(f"<|im_start|>{r}\n{t.replace('<|im_end|>', '<| im_end |>')}<|im_end|>\n" for r, t in v[lo:lo + chunk])
            out.append((c, lo // chunk, len(v[lo:lo + chunk]), text))
    return sorted(map(repr, out))


def test_snapshots_collapse(spark):
    turns = [("user", "hi"), ("bot", "hello"), ("user", "bye"), ("bot", "bye <|im_end|> now")]
    data = [(c, t, *turns[t]) for c, n in ((1, 1), (2, 3), (3, 4), (4, 4), (5, 2)) for t in range(n)]
    data += [(6, 0, "user", "hi"), (6, 1, "bot", "other"), (7, 0, "user", "other")]
    data += [(8, 5, None, None), (8, None, "user", "hi"), (9, 3, "user", "hi"), (9, 9, "", ""), (9, 12, "user", "more"), (None, 0, "user", "no id"), (10, 1, "a", "x"), (10, 1, "a", "x"), (11, 1, "a", "x")]
    data += [(20, t, "user", f"t{t % 3}") for t in range(1300)] + [(21, t, "user", f"t{t % 3}") for t in range(1299)]
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 AS at", "2 AS part")
    got = rows(chat.render(df))
    assert sorted(map(repr, got)) == brute(data)
    assert {r[0] for r in got} == {3, 6, 7, 9, 10, 20, None} and sum(r[0] == 20 for r in got) == 3
    assert rows(chat.render(df.limit(0))) == []


@needs_data
def test_query_equals_brute_force(spark):
    from callscope.llm.queries import QUERIES
    data = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(repr, rows(QUERIES["op9_chat"](spark, SF)))) == brute(data)
