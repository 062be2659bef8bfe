"""The pipeline's stages against plain Python over each stage's own input."""
import hashlib
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from callscope.llm import quality
from callscope.llm.shared import public_vocabulary
from helpers import SF, docs, needs_data, rows
from test_jaccard import brute as groups
from test_linetree import brute as without_lines
from test_mix import word_sizes


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows that each stage got and gave."""
    folder = tmp_path_factory.mktemp("stages")
    df = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, df, SF)
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(folder / str(k)))
        out = spark.read.parquet(str(folder / str(k)))
        seen.append((df.collect(), out.collect()))
        df = out
    return seen


@needs_data
def test_quality_keeps_what_scores_well(spark, stages):
    given, kept = stages[0]
    d = spark.createDataFrame(given)
    score = dict(rows(quality.score(d, quality.fit(d, spark.read.parquet(f"{SF}/labels.parquet")))))
    assert sorted(kept) == sorted(r for r in given if score[r.doc_id] >= .7) and len(kept) > .6 * len(given)


@needs_data
def test_lines(stages):
    given, kept = stages[1]
    want = {i: t for i, t, n, gone in without_lines([(r.doc_id, r.text) for r in given]) if not gone or t.strip()}
    assert {r.doc_id: r.text for r in kept} == want and len(kept) == len(want)
    assert all(r.n_chars == len(r.text) for r in kept)


@needs_data
def test_one_of_each_group_stays(stages):
    given, kept = stages[2]
    first = sorted({c for _, _, c in groups([(r.doc_id, r.text) for r in given], 5, 4, 5)})
    assert sorted(r.doc_id for r in kept) == first and set(kept) <= set(given)


@needs_data
def test_mix_repeats_small_sources(stages):
    given, mixed = stages[3]
    sizes, level = word_sizes([(r.text, r.source) for r in given]), {}
    weights = {s: n ** .7 for s, n in sizes.items() if n}
    top = max(sizes[s] / w for s, w in weights.items())
    times = Counter(r.doc_id for r in mixed)
    assert set(times) == {r.doc_id for r in given} and max(times.values()) <= 3
    taken = word_sizes([(r.text, r.source) for r in mixed])
    for s, w in weights.items():
        level[s] = min(3 * sizes[s], w * top)
        longest = max(word_sizes([(r.text, 0)])[0] for r in given if r.source == s)
        assert abs(taken[s] - level[s]) <= longest / 2 + 1e-6


@needs_data
def test_encoding(stages):
    given, out = stages[4]
    library = Tokenizer.from_file(public_vocabulary("byte_bpe_50k.json"))

    def one(r):
        ids = library.encode(r.text, add_special_tokens=False).ids
        return r.doc_id, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()
    assert sorted(map(tuple, out)) == sorted(map(one, given))


def test_run_and_odd_rows(spark, tmp_path):
    given = [(1, "plain words in a row. " * 9, "a"), (1, "plain words in a row. " * 9, "a"), (2, None, None), (3, "", "b"), (None, "words without an id here. " * 5, "b"), (5, "x", None)]
    docs(spark, given).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = rows(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id"))
    assert {r[0] for r in got} <= {1, None, 5} and (1,) in got
    empty = tmp_path / "empty"
    docs(spark, given).limit(0).write.parquet(str(empty / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(empty / "labels.parquet"))
    assert rows(corpus_pipeline.run(spark, str(empty))) == []
