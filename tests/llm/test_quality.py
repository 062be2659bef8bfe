import random
import zlib

from callscope.llm import quality
from helpers import SF, docs, needs_data, rows, table


def labelled(spark, rows_):
    return spark.createDataFrame(rows_, "doc_id long, quality int, toxic int")


def corpus(n=400):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9)))
    given, marks = [], []
    for k in range(n):
        words = [word() for _ in range(rnd.randrange(40, 90))]
        text = ". ".join(" ".join(words[i:i + 9]).capitalize() for i in range(0, len(words), 9)) + "."
        if k % 4 == 0:
            text = [" ".join(w.upper() + "!!" for w in words), " ".join([words[0]] * 60), " ".join(w + "###" for w in words)][k % 3]
        given.append((k, text))
        marks.append((k, int(k % 4 != 0), 0))
    return given, marks


def test_held_out_accuracy_and_odd_rows(spark):
    given, marks = corpus()
    odd = [(1000, None), (1001, ""), (1002, " \n"), (None, given[1][1]), (1003, given[1][1] * 200), (1, given[1][1])]
    d, l = docs(spark, given + odd), labelled(spark, marks + [(None, 0, 0), (5, None, 1), (7, 1, None), (9999, 0, 0)])
    model = quality.fit(d, l)
    got = rows(quality.score(d, model))
    assert len(got) == len(given) + len(odd) and all(0 <= s <= 1 for _, s in got)
    score = {i: s for i, s in got}
    test = [(i, y) for i, y, _ in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(test) > 50 and sum((score[i] >= .7) == bool(y) for i, y in test) >= .97 * len(test)
    assert score[1000] == score[1001] == score[1002] == 0 and score[None] == score[1] >= .7 and score[1003] >= 0


def test_held_out_labels_are_never_learned(spark):
    given, marks = corpus(200)
    d = docs(spark, given)
    fold = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    flipped = [(i, 1 - y if fold(i) else y, 1) for i, y, _ in marks]
    a, b = (sorted(rows(quality.score(d, quality.fit(d, labelled(spark, m))))) for m in (marks, flipped))
    assert a == b


def test_keep_good_keeps_columns(spark):
    given, marks = corpus(200)
    d = docs(spark, given + [(500, None)]).selectExpr("*", "7 AS score", "8 AS _scored")
    kept = quality.keep_good(d, labelled(spark, marks))
    assert kept.columns == d.columns
    ids = {r.doc_id for r in kept.collect()}
    wrong = [k for k in range(200) if (k in ids) != (k % 4 != 0)]
    assert len(wrong) <= 4 and 500 not in ids


def test_no_labels_one_class_and_empty_tables(spark):
    given, marks = corpus(60)
    d = docs(spark, given)
    none = labelled(spark, marks).limit(0)
    assert {s for _, s in rows(quality.score(d, quality.fit(d, none)))} == {0.5}
    good = labelled(spark, [(i, 1, 0) for i, _, _ in marks])
    assert {s for _, s in rows(quality.score(d, quality.fit(d, good)))} == {1.0}
    assert rows(quality.score(d.limit(0), quality.fit(d, good))) == []


@needs_data
def test_query_covers_every_document(spark):
    from callscope.llm.queries import QUERIES
    got = rows(QUERIES["op8_quality"](spark, SF))
    ids = [r.doc_id for r in table(spark, "documents").collect()]
    assert sorted(r[0] for r in got) == sorted(ids) and all(h == (zlib.crc32(str(i).encode()) % 4 == 2) and p == int(s >= .7) for i, h, s, p in got)
    truth = {r.doc_id: r.quality for r in table(spark, "labels").collect()}
    test = [(truth[i], p) for i, h, _, p in got if h and i in truth]
    assert sum(a == b for a, b in test) >= .85 * len(test)
