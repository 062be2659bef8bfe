import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from callscope.llm import tokenfile
from callscope.llm.shared import public_vocabulary
from helpers import SF, docs, needs_data, rows, table

PATH = public_vocabulary("word_bpe_49k.json")
ODD = ["", " ", "Word, word. WORD", "a  b\n\nc", "it's 'S we'LL", "<|endoftext|>", "<|EndOfText|>,", "a<|endoftext|>b <|startoftext|>.", "İ# İ.", "ΣΑΣ, ς",
       "é, é# x", "日本, 語", "½ 12.5!", "\x1c\x85", "...", "don't.", "#a# *b*", None]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@given(st.lists(st.integers(0, 300), max_size=1200))
@settings(max_examples=25, deadline=None)
def test_matrix_against_plain_lists(values):
    x = np.array(values, "<u2")
    m = tokenfile.WaveletMatrix.build(x, 9)
    m = tokenfile.WaveletMatrix(m.n, **{k: v for k, v in m.row().items() if k != "n_ids"})
    assert m.values().tolist() == values
    assert m.access(np.arange(len(values))).tolist() == values
    for token in {*values[:3], 0, 300, 5000}:
        assert m.count(token) == values.count(token)
        assert m.locate(token).tolist() == [i for i, v in enumerate(values) if v == token]


def test_units_equal_the_library(library):
    units = tokenfile.LibraryUnits(PATH)
    texts = [*ODD, *(f"ax{chr(c)}y1 {chr(c)}, z{chr(c)}." for c in range(0x20, 0x2100))]
    for t, got in zip(texts, units.encode(pa.array(texts, pa.string()))):
        assert np.frombuffer(got, units.width).tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)


def expected(library, given):
    out, start = [], 0
    for key, text in given:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((key, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        start += len(ids)
    return out


def test_files_hold_rows_in_order_of_id(spark, tmp_path, library):
    given = [(None, "no id"), (-4, "low"), (2, None), (2, "twice two"), *[(10 + k, t) for k, t in enumerate(ODD)]]
    d = docs(spark, given[::-1])
    path = str(tmp_path / "files")
    tokenfile.write_shards(d, path, PATH, end_id=1, shard_ids=8)
    got = [(r[0], r[1], np.frombuffer(r[2], "<u4").tolist()) for r in rows(tokenfile.read_tokens(spark, path))]
    got.sort(key=lambda r: r[1])
    sizes = np.cumsum([0] + [len(r[2]) for r in got])
    assert [r[1] for r in got] == sizes[:-1].tolist()
    assert sorted(map(repr, ((r[0], r[2]) for r in got))) == sorted(repr((k, [*library.encode(t or "", add_special_tokens=False).ids, 1])) for k, t in given)
    ids = [i for i in (r[0] for r in got) if i is not None]
    assert ids == sorted(ids) and got[0][0] is None
    flat = [i for r in got for i in r[2]]
    token = flat[3]
    assert sum(r.n for r in tokenfile.count_token(spark, path, token).collect()) == flat.count(token)
    found = sorted(r.position for r in tokenfile.find_token(spark, path, token).collect())
    assert found == [i for i, t in enumerate(flat) if t == token]
    some = sorted(rows(tokenfile.tokens_at(spark, path, 5, 21)))
    assert some == [(i, flat[i]) for i in range(5, 21)]
    for r in tokenfile.find_token(spark, path, token).collect():
        start = next(g[1] for g in got if g[1] <= r.position < g[1] + len(g[2]))
        assert r.offset == r.position - start


def test_empty_table(spark, tmp_path):
    tokenfile.write_shards(docs(spark, [(1, "x")]).limit(0), str(tmp_path / "none"), PATH, end_id=1)
    assert rows(tokenfile.read_tokens(spark, str(tmp_path / "none"))) == []


@needs_data
def test_query_equals_the_library(spark, library):
    from callscope.llm.queries import QUERIES
    given = sorted((r.doc_id, r.text) for r in table(spark, "documents").collect())
    assert sorted(rows(QUERIES["op3_token_files"](spark, SF))) == expected(library, given)
