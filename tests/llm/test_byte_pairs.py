import hashlib

import pytest
from tokenizers import Tokenizer

from callscope.llm import bpe
from callscope.llm.shared import public_vocabulary
from helpers import SF, docs, needs_data, rows, table

PATH = public_vocabulary("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a  b", "a \n b", "a\n\n b", "x\xa0 \xa0y", "it's we'll 'S", "tab\tend ", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b",
       "日本語 テスト", "é à", "\x1c\x85 z", "🙂🙂 ok", "%%%###", "12 345 ½ Ⅷ", "a" * 700, "ab" * 900, " " * 300 + "x", "\x00\x01"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    raw = b"".join(i.to_bytes(4, "little") for i in ids)
    return len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_texts_equal_the_library(spark, library):
    given = [(k, t) for k, t in enumerate([*ODD, None])] + [(3, ODD[3]), (None, "no id")]
    got = rows(bpe.round_trip(docs(spark, given), PATH))
    assert sorted(map(repr, got)) == sorted(repr((k, *expected(library, t))) for k, t in given)


def test_every_class_of_code_points(library):
    pairs = bpe.BytePairs(PATH)
    points = [c for c in [*range(0x20, 0x3100), *range(0xFE00, 0x10000), 0x1F600, 0x10FFFF]]
    texts = [f"x{chr(c)}y1{chr(c)}2 {chr(c)} z" for c in points]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert list(memoryview(pairs.encode(t)).cast("I")) == e.ids, hex(ord(t[1]))


def test_heap_and_array_merge_alike():
    pairs = bpe.BytePairs(PATH)
    ids = [pairs.first[b] for b in ("thehand" * 25 + "zq" * 10).encode()]
    assert pairs.merge(list(ids)) == pairs._merge_long(list(ids))


@needs_data
def test_query_equals_the_library(spark, library):
    from callscope.llm.queries import QUERIES
    want = {r.doc_id: expected(library, r.text) for r in table(spark, "documents").select("doc_id", "text").collect()}
    got = {r[0]: tuple(r[1:]) for r in rows(QUERIES["op10_byte_pairs"](spark, SF))}
    assert got == want


def test_decode_and_empty_table(spark):
    d = docs(spark, [(1, "a b"), (2, None)])
    assert sorted(rows(bpe.decode_documents(bpe.encode_documents(d, PATH), PATH))) == [(1, "a b"), (2, "")]
    assert rows(bpe.round_trip(d.limit(0), PATH)) == []
