"""Benchmark decontamination by one Aho-Corasick automaton over the normalised items.

Windows of consecutive item words are the automaton's patterns. Each text is normalised and scanned once; matches are
mapped back to words and from there to characters of the text as it is. Items are few and are broadcast in batches of
bounded size; a benchmark of several batches is scanned batch by batch, each adding to what the ones before have marked.
"""
from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.llm.shared import batch, bounded_batches, slices, term_pieces, term_spans
from callscope.session import cut_lineage

#: Words of a window.
WINDOW = 10
#: Bytes of item texts that one automaton is built of, at about 400 bytes of memory each.
BOUND = 1 << 18
ROWS = 512

_STATE = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<first:bigint,last:bigint,start:bigint,stop:bigint>>"
_SPAN = pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "stop")])
_built: dict[tuple, Machine] = {}


class Machine:
    """The automaton of some items and its longest window."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        windows: dict[str, tuple[int, set[str]]] = {}
        for name, text in items:
            words = [w for piece in term_pieces(text) for w in piece]
            for at in range(max(1, len(words) - size + 1) if words else 0):
                some = words[at:at + size]
                windows.setdefault((b" " + b" ".join(some) + b" ").decode("latin-1"), (len(some), set()))[1].add(name)
        self.longest = max((n for n, _ in windows.values()), default=0)
        self.automaton = ahocorasick.Automaton()
        for pattern, value in windows.items():
            self.automaton.add_word(pattern, value)
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words of a text, ranges of words that a window covers (not merged), and the items of the windows found."""
        n, ranges, names, tail = 0, [], set(), []
        for piece in term_pieces(text):
            words = tail + piece
            first = n - len(tail)
            if self.longest:
                line = b" " + b" ".join(words) + b" "
                blanks = None
                for end, (size, found) in self.automaton.iter(line.decode("latin-1")):
                    if blanks is None:
                        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                    last = first + int(np.searchsorted(blanks, end)) - 1
                    ranges.append((last - size + 1, last))
                    names |= found
            n += len(piece)
            tail = words[-(self.longest - 1):] if self.longest > 1 else []
        return n, ranges, names


def machine(items: list[tuple[str, str]], size: int, key: tuple) -> Machine:
    """The automaton, built once per Python worker."""
    if key not in _built:
        _built.clear()
        _built[key] = Machine(items, size)
    return _built[key]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words without overlaps; those that touch are one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(set(ranges)):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def _batches(items: DataFrame, item_id: str, item_text: str) -> list[DataFrame]:
    rows = items.select(F.coalesce(items[item_id].cast("string"), F.lit("none")).alias("item"), items[item_text].alias("said")).where("said IS NOT NULL")
    return bounded_batches(rows, ["item", "said"], F.octet_length("said"), BOUND)


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, text: str = "text", id: str = "doc_id",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) of every row of ``docs``.

    A window is ``size`` consecutive words of an item, or all words of an item that has fewer. ``n_hit`` counts the words of
    a text inside any occurrence of a window, ``items`` names in order the items whose windows occur, and ``spans`` gives
    the ranges hit: first and last word, first and behind-last character. Null and empty texts have no words. Rows without
    an item id count as the item ``none``; rows that repeat an id are one item. Repeated rows of ``docs`` stay, in no set
    order; only id and text are read, so other columns cannot clash. Very long texts are scanned in pieces that overlap by a
    window less one word. Without items, or on an empty table, nothing is hit.
    """
    spark = docs.sparkSession
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(_SPAN))])
    state = docs.select(docs[id].cast("bigint").alias("doc_id"), docs[text].alias("text"), F.expr("0L n_words"), F.expr("0L n_hit"),
                        F.expr("cast(array() AS array<string>) items"), F.array().cast("array<struct<first:bigint,last:bigint,start:bigint,stop:bigint>>").alias("spans"))
    parts = _batches(items, item_id, item_text)
    for part in parts or [None]:
        told = [tuple(r) for r in part.collect()] if part is not None else []  # BOUND bytes and one item at most
        shared = spark.sparkContext.broadcast((told, hash(tuple(told))))
        alone = len(parts) <= 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, alone=alone) -> Iterator[pa.RecordBatch]:
            known = machine(shared.value[0], size, (shared.value[1], len(shared.value[0]), size))
            for b in batches:
                for s in slices(b, 1, ROWS):
                    out: dict[str, list] = {f.name: [] for f in schema}
                    for key, said, _, _, before, spans in zip(*(c.to_pylist() for c in s.columns), strict=True):
                        n, ranges, names = known.scan(said or "")
                        if ranges:
                            ranges = merged(ranges + [(r["first"], r["last"]) for r in spans])
                            start, stop = term_spans(said)
                            spans = [{"first": a, "last": z, "start": int(start[a]), "stop": int(stop[z])} for a, z in ranges]
                        for name, value in zip(out, (key, None if alone else said, n, sum(r["last"] - r["first"] + 1 for r in spans), sorted({*before, *names}), spans), strict=True):
                            out[name].append(value)
                    yield batch(schema, **out)

        state = state.mapInArrow(run, f"doc_id bigint, text string, {_STATE}")
        if not alone:
            state = cut_lineage(state)  # the next batch takes these texts up again
    return state.drop("text")


def decontaminate(docs: DataFrame, items: DataFrame, share: float = 0.0, size: int = WINDOW, text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, of which windows of no batch of items cover more than ``share`` of the words.

    With the default, every row that holds a window of any item goes. No shuffle; each row is judged by its own text.
    """
    at_text, parts = docs.columns.index(text), _batches(items, item_id, item_text)
    for part in parts:
        told = [tuple(r) for r in part.collect()]  # BOUND bytes and one item at most
        shared = docs.sparkSession.sparkContext.broadcast((told, hash(tuple(told))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = machine(shared.value[0], size, (shared.value[1], len(shared.value[0]), size))
            for b in batches:
                for s in slices(b, at_text, ROWS):
                    keep = []
                    for said in s.column(at_text).to_pylist():
                        n, ranges, _ = known.scan(said or "")
                        keep.append(sum(z - a + 1 for a, z in merged(ranges)) <= share * n)
                    yield s.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if len(parts) > 1:
            docs = cut_lineage(docs)  # one automaton at a time
    return docs


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
           FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'none') AS item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(list_slice(w, i, i + 9), ' ') AS x, least(len(w), 10) AS n
        FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
spots AS (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS x
          FROM (SELECT d.r, d.w, s.n, unnest(range(1, len(d.w) - s.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) s)),
hit AS (SELECT spots.r, spots.i, spots.n, win.item FROM spots JOIN win ON spots.x = win.x AND spots.n = win.n),
covered AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
