"""Byte-level BPE: encode and decode with a contiguous array of adjacent ranks per word."""
from __future__ import annotations

import functools
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from callscope.llm.shared import batch, slices, text_list

NONE = 1 << 60
#: Words of more parts are merged from a heap: scanning an array is quadratic in the word.
SHORT = 192
#: Units kept per Python worker between batches; the table is emptied when it is full.
KEPT_UNITS = 150_000
#: Rows of one Arrow slice: bounds what a worker holds at once.
ROWS = 256

#: Split of text before the merges (fixed values of the byte-level vocabulary). White space is spelled out, because
#: libraries disagree on U+001C to U+001F.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_SPACE = regex.compile(f"[{_S}]")
#: A space before something that is not white space always begins a piece, so text may be cut there.
_CUT = regex.compile(f"(?= [^{_S}])")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 itself, others from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class _Run(Exception):
    """A space before more white space: the text can't be cut at every space."""


class _Tails(dict):
    """Ids of a space and what follows it up to the next space."""

    def __init__(self, pairs: BytePairs):
        super().__init__()
        self.pairs = pairs

    def __missing__(self, tail: str) -> bytes:
        if not tail or _SPACE.match(tail):
            raise _Run
        if len(self) >= KEPT_UNITS:
            self.clear()
        got = self.pairs.unit(" " + tail)
        if len(tail) <= SHORT:
            self[tail] = got
        return got


class BytePairs:
    """Ranks of a byte-level BPE file: ``encode`` gives ids as little-endian unsigned 32-bit integers, ``decode`` text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.first = [vocab[c] for c in letters]
        to_byte = {c: b for b, c in enumerate(letters)}
        self.rank, self.merged = {}, []
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 32 | vocab[b]] = k
            self.merged.append(vocab[a + b])
        self.token = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        self._marks = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._words: dict[str, bytes] = {}
        self._tails = _Tails(self)

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the lowest rank, leftmost first, until no adjacent pair has one."""
        if len(ids) > SHORT:
            return self._merge_long(ids)
        rank = self.rank.get
        ranks = [rank(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            ids[i] = self.merged[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 32 | ids[i], NONE)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 32 | ids[i + 1], NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same order of merges from a heap over linked parts; stale entries are skipped."""
        n, rank = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank(ids[i] << 32 | ids[j], NONE) != r:
                continue
            ids[i], ids[j], after[i] = self.merged[r], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank(ids[a] << 32 | ids[b], NONE)) != NONE:
                    heapq.heappush(heap, (r, a))
        return [i for i in ids if i >= 0]

    def _word(self, piece: str) -> bytes:
        got = self._words.get(piece)
        if got is None:
            if len(self._words) >= KEPT_UNITS:
                self._words.clear()
            got = array("I", self.merge([self.first[b] for b in piece.encode()])).tobytes()
            if len(piece) <= SHORT:
                self._words[piece] = got
        return got

    def unit(self, text: str) -> bytes:
        return b"".join(map(self._word, PIECES.findall(text)))

    def _plain(self, text: str) -> bytes:
        head, *tails = text.split(" ")
        try:
            return b"".join([self.unit(head), *map(self._tails.__getitem__, tails)])
        except _Run:
            return b"".join(map(self.unit, _CUT.split(text)))

    def encode(self, text: str) -> bytes:
        if self._marks is None or not any(t in text for t in self.special):
            return self._plain(text) if text else b""
        return b"".join(self.special[s].to_bytes(4, "little") if s in self.special else self._plain(s)
                        for s in self._marks.split(text) if s)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@functools.lru_cache(2)
def byte_pairs(path: str) -> BytePairs:
    """One table per Python worker."""
    return BytePairs(path)


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, ids binary): token ids of each whole text as little-endian unsigned 32-bit integers.

    No shuffle: every row is encoded where it is read. A null or empty text has no ids; repeated rows stay; other
    columns are not looked at. ``vocabulary`` is the path of a byte-level BPE file on every worker.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_pairs(vocabulary)
        for b in batches:
            for s in slices(b, 1, ROWS):
                yield batch(schema, doc_id=s.column(0), ids=[bpe.encode(t) for t in text_list(s.column(1))])

    return docs.select(docs[id].cast("bigint"), docs[text]).mapInArrow(run, "doc_id bigint, ids binary")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); invalid UTF-8 becomes U+FFFD, null ids an empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_pairs(vocabulary)
        for b in batches:
            for s in slices(b, 1, ROWS):
                yield batch(schema, doc_id=s.column(0), text=[bpe.decode(i or b"") for i in s.column(1).to_pylist()])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, encoded and decoded in one pass over the rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_pairs(vocabulary)
        hexed = lambda raw: hashlib.sha256(raw).hexdigest()
        for b in batches:
            ids = [i or b"" for i in b.column(1).to_pylist()]
            yield batch(schema, doc_id=b.column(0), n_tokens=[len(i) // 4 for i in ids], ids_sha256=[hexed(i) for i in ids],
                        decoded_sha256=[hexed(bpe.decode(i).encode()) for i in ids])

    return encode_documents(docs, vocabulary).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
