"""Byte-level BPE encoding and decoding from a rank file.

A text is cut into pre-tokens by the vocabulary's pattern. Two tiers give the
ids of a pre-token: a minimal perfect hash over the vocabulary finds those that
are tokens as a whole; any other is merged from its bytes, lowest rank first and
leftmost on ties, with a heap over a doubly linked list. Each worker remembers
what it has merged, and puts whole batches together by array operations.

Defined cases: a null or empty text has no ids; special tokens are ordinary text;
ids outside the vocabulary decode to nothing; other columns pass through.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from turnloom.llm.mphf import MinimalPerfectHash
from turnloom.llm.word_bpe import ChunkMemo

#: Chunks and pre-tokens that one worker remembers before it starts over; bounds its memory, not the result.
REMEMBERED, MERGED = 500_000, 200_000
#: Rows put together at a time.
PART = 128
#: A chunk with white space at an edge: its neighbours decide how it is cut.
TORN = -2


class Vocabulary:
    """Ranks of byte strings behind a minimal perfect hash."""

    def __init__(self, path: str):
        pairs = [line.split() for line in open(path, "rb") if line.strip()]
        tokens, ranks = [base64.b64decode(a) for a, _ in pairs], np.array([int(b) for _, b in pairs], np.int64)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
        self.hash = MinimalPerfectHash.build(hashes)
        slot = self.hash.slots(hashes)
        self.tokens: list[bytes] = [b""] * len(tokens)
        for s, t in zip(slot.tolist(), tokens, strict=True):
            self.tokens[s] = t
        self.ranks = np.empty(len(tokens), np.int64)
        self.ranks[slot] = ranks
        #: For merges, which ask for one short string after the other.
        self.rank = dict(zip(tokens, ranks.tolist(), strict=True))
        size = int(ranks.max()) + 1
        self.lens = np.zeros(size, np.int64)
        self.lens[ranks] = [len(t) for t in tokens]
        self.starts = np.cumsum(self.lens) - self.lens
        by_rank = sorted(zip(ranks.tolist(), tokens, strict=True))
        self.bytes = np.frombuffer(b"".join(t for _, t in by_rank), np.uint8)

    def whole(self, pieces: list[bytes]) -> list[int]:
        """The rank of each piece that is a token, else -1."""
        slot = self.hash.slots(np.fromiter(map(xxhash.xxh3_64_intdigest, pieces), np.uint64, len(pieces)))
        return [int(self.ranks[s]) if s >= 0 and self.tokens[s] == p else -1 for s, p in zip(slot.tolist(), pieces, strict=True)]

    def merge(self, piece: bytes) -> list[int]:
        rank = self.rank
        n = len(piece)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            left = part[i]
            if left is None or (j := after[i]) >= n or len(left) + len(part[j]) != size:
                continue
            left = part[i] = left + part[j]
            part[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(left + part[k])) is not None:
                    heappush(heap, (r, i, len(left) + len(part[k])))
            if (h := before[i]) >= 0 and (r := rank.get(part[h] + left)) is not None:
                heappush(heap, (r, h, len(part[h]) + len(left)))
        return [rank[p] for p in part if p is not None]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and how many fall to each text of so many ids."""
        known = (ids >= 0) & (ids < len(self.lens))
        ids = np.where(known, ids, 0)
        lens = np.where(known, self.lens[ids], 0)
        ends = np.concatenate([[0], np.cumsum(lens)])
        out = self.bytes[np.repeat(self.starts[ids] - ends[:-1], lens) + np.arange(ends[-1])]
        return out, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])])


class ByteEncoder(ChunkMemo):
    """A space between two other characters always starts a pre-token, so the chunks between such spaces are encoded by themselves."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = vocabulary(path)
        self.cut = regex.compile(pattern).findall
        self.merged: dict[str, list[int]] = {}
        self._start()

    def _pretokens(self, key: str) -> list[str] | None:
        """Of a key: two spaces and a pre-token; a text's first chunk and a space; or a later chunk, whose space went."""
        if key.startswith("  "):
            return [key[2:]]
        own = key[:-1] if key.endswith(" ") else key
        if not own or own[0].isspace() or own[-1].isspace():
            return None
        return self.cut(own if key.endswith(" ") else " " + own)

    def _learn(self, keys: list[str]) -> None:
        cuts = [self._pretokens(k) for k in keys]
        if len(self.merged) > MERGED:
            self.merged = {}
        new = list({p for c in cuts if c for p in c} - self.merged.keys())
        raw = [p.encode() for p in new]
        for text, piece, rank in zip(new, raw, self.vocabulary.whole(raw), strict=True):
            self.merged[text] = [rank] if rank >= 0 else self.vocabulary.merge(piece)
        whole = [(k, c) for k, c in zip(keys, cuts, strict=True) if c is not None]
        self._add([k for k, _ in whole], [[i for p in c for i in self.merged[p]] for _, c in whole])
        self.number.update((k, TORN) for k, c in zip(keys, cuts, strict=True) if c is None)

    def _numbers(self, keys: list[str]) -> np.ndarray:
        get = self.number.get
        number = np.fromiter((get(k, -1) for k in keys), np.int64, len(keys))
        missed = np.flatnonzero(number == -1)
        if len(missed):
            self._learn(list(dict.fromkeys(keys[i] for i in missed.tolist())))
            number[missed] = np.fromiter((get(keys[i]) for i in missed.tolist()), np.int64, len(missed))
        return number

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many belong to each text."""
        if len(self.number) > REMEMBERED:
            self._start()
        keys: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                own = text.split(" ")
                own[0] += " "
                keys += own
                counts[i] = len(own)
        number = self._numbers(keys)
        ends = np.cumsum(counts)
        torn = np.unique(np.searchsorted(ends, np.flatnonzero(number == TORN), side="right"))
        if len(torn):
            parts = np.split(number, ends[:-1])
            for i in torn.tolist():
                parts[i] = self._numbers(["  " + p for p in self.cut(texts[i])])
                counts[i] = len(parts[i])
            number = np.concatenate(parts)
        return self._gather(number, counts)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ByteEncoder:
    return ByteEncoder(path, pattern)


def _with(schema: StructType, name: str, kind) -> StructType:
    return StructType([*(f for f in schema.fields if f.name != name), StructField(name, kind)])


def encode(rows: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``rows`` with the ids of ``text``, an array<int>, in place of it. Batches go out in small parts."""
    schema = _with(rows.drop(text).schema, into, ArrayType(IntegerType(), False))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, PART):
                part = batch.slice(i, PART)
                flat, counts = own.encode(part.column(text).to_pylist())
                ends = np.concatenate([[0], np.cumsum(counts)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in schema.fields[:-1]), lists], schema.names)

    return rows.mapInArrow(ids, schema)


def decode(rows: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the bytes of ``ids``, a null array being empty."""
    schema = _with(rows.schema, into, BinaryType())

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            for i in range(0, batch.num_rows, PART):
                part = batch.slice(i, PART)
                lists = part.column(ids)
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                data, n = own.decode(lists.flatten().to_numpy(zero_copy_only=False), counts)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                held = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in schema.fields[:-1]), held], schema.names)

    return rows.mapInArrow(raw, schema)
