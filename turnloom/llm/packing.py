"""Harmonic packing of token sequences.

Documents may be cut. A stretch of r tokens left of a document, r below the
capacity C, belongs to the reciprocal class k = floor(C / r): k such pieces fill
a sequence. If r wastes more than ``SLACK`` of its share C / k, the document is cut
at the next smaller share, floor(C / (k + 1)), and the rest goes on the same way;
so every piece nearly fills the share of its class, and stretches of C tokens
fill a sequence alone.

Each class fills its sequences with exactly k pieces. A class is dealt out to
independent lots, each of many sequences, so at most one sequence of a class and
lot is left part full, and no task ever needs another's state. Each task that cuts
documents numbers the pieces of a class and deals them in turn, so lots are even
even where a third of all rows are copies. The pieces of those few part-full sequences
are put together, lot by lot, where they leave the least room. The layout moves only
(document, start, length), never ids.

Padding: ``sequences`` fills each sequence up to the capacity, but one whose length
is a power of two stays as long as it is.

Defined cases: a null or empty text is one piece with its end id only; repeated
rows are separate documents; an empty table gives no pieces; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import cut
from turnloom.llm.word_bpe import as_bytes, encoder, slices

CAPACITY = 4096
SLACK = 1 / 32
#: Full sequences a lot should fill for its one part-full sequence, and bits of a sequence's number in its lot.
LOT_SEQUENCES, BIN_BITS = 256, 20

#: ``turn`` deals pieces out to lots.
PIECES = "doc_id long, start long, length long, class int, doc_tokens long, ids_crc32 long, turn long, ids binary"


def piece_lengths(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """The lengths into which a document of n tokens is cut, in order."""
    out = [capacity] * (n // capacity)
    left = n % capacity
    while left:
        k = capacity // left
        share = capacity // k
        take = left if share - left <= slack * share else capacity // (k + 1)
        out.append(take)
        left -= take
    return out


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Encode every document and cut it: PIECES. ``ids`` is little-endian unsigned 32-bit, null without ``with_ids``."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path, end_id)
        known: dict[int, list[int]] = {}
        # The tasks' first turns differ, so that no lot is the first of all.
        turns: dict[int, int] = defaultdict(lambda first=zlib.crc32(str(TaskContext.get().partitionId()).encode()): first)
        for batch in batches:
            for rows in slices(batch, "text"):
                ids, lens = coder.encode(as_bytes(rows.column("text")).to_pylist())
                raw = np.ascontiguousarray(ids, "<u4").tobytes()
                keys = rows.column("k").to_pylist()
                out: list[list] = [[] for _ in range(8)]
                at = 0
                for doc, n in zip(keys, lens.tolist(), strict=True):
                    start = 0
                    if n not in known:
                        known[n] = piece_lengths(n, capacity)
                    for length in known[n]:
                        own = raw[4 * (at + start) : 4 * (at + start + length)]
                        kind = capacity // length
                        for column, value in zip(out, (doc, start, length, kind, n, zlib.crc32(own), turns[kind], own if with_ids else None), strict=True):
                            column.append(value)
                        turns[kind] += 1
                        start += length
                    at += n
                if len(known) > 100_000:
                    known = {}
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "start", "length", "class", "doc_tokens", "ids_crc32", "turn", "ids"])

    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(pieces, PIECES)


def _fill(capacity: int):
    """Sequences for the pieces of part-full ones: longest first, each where it leaves the least room."""

    def fill(left: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["length", "doc_id", "start", "ids_crc32", "turn"], ascending=[False, True, True, True, True], ignore_index=True)
        rooms: list[tuple[int, int]] = []
        used: list[int] = []
        bins, offsets = [], []
        for length in left["length"].tolist():
            at = bisect_left(rooms, (length, -1))
            if at < len(rooms):
                room, number = rooms.pop(at)
            else:
                room, number = capacity, len(used)
                used.append(0)
            bins.append(number)
            offsets.append(used[number])
            used[number] += length
            if room > length:
                insort(rooms, (room - length, number))
        # Class 0 of the sequence numbers: no class of pieces has it.
        return left.assign(sequence_id=left["lot"].astype("int64") * _lot_step(capacity) + np.array(bins, np.int64) * (1 << capacity.bit_length()), offset=np.array(offsets, np.int64)).drop(columns=["lot", "turn"])

    return fill


def _lot_step(capacity: int) -> int:
    return 1 << (capacity.bit_length() + BIN_BITS)


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset. Reads the pieces more than once: hand in a written table."""
    # One row per class, of which there are at most as many as tokens in a sequence.
    per_class = pieces.groupBy("class").agg(F.count("*").alias("n"))
    lots = per_class.select("class", F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / (F.col("class") * LOT_SEQUENCES))).alias("lots"))
    dealt = pieces.join(F.broadcast(lots), "class").withColumn("lot", F.pmod("turn", "lots"))
    order = ["doc_id", "start", "length", "ids_crc32", "turn"]
    lot = Window.partitionBy("class", "lot")
    number = F.row_number().over(lot.orderBy(*order)) - 1
    placed = dealt.withColumn("all", F.count("*").over(lot)).withColumn("bin", F.floor(number / F.col("class")))
    # A sequence is full if its class's count of pieces is there.
    placed = placed.withColumn("full", (F.col("bin") + 1) * F.col("class") <= F.col("all")).drop("lots", "all")
    # Classes are at most the capacity; numbers that don't fit would meet those of another lot.
    fits = F.when(F.col("bin") < 1 << BIN_BITS, F.col("bin")).otherwise(F.raise_error(F.lit("a lot holds more sequences than its numbers")).cast("long"))
    sequence = F.col("lot") * F.lit(_lot_step(capacity)) + fits * F.lit(1 << capacity.bit_length()) + F.col("class")
    before = Window.partitionBy("class", "lot", "bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    full = placed.where("full").withColumn("sequence_id", sequence).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))).drop("lot", "bin", "full", "turn")
    # At most one part-full sequence of each class is left of a lot: few pieces, whatever the input.
    rest = placed.where("NOT full").drop("bin", "full")
    filled = rest.groupBy("lot").applyInPandas(_fill(capacity), full.schema)
    return full.unionByName(filled)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, key: str = "doc_id", text: str = "text", with_ids: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """The layout of all pieces: PIECES without turn, with sequence_id and offset."""
    return assign(cut(cut_documents(docs, tokenizer_path, end_id, key, text, capacity, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """(sequence_id, length, ids) from a layout that holds ids, filled up to ``capacity`` where the length is no power of two."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("length"))
    joined = F.concat_ws("", F.transform("p", lambda x: F.hex(x["ids"])))
    length = F.col("length").cast("int")
    wanted = F.when(length.bitwiseAND(length - 1) == 0, length).otherwise(capacity)
    hexed = F.rpad(joined, 8 * wanted, F.lit(pad_id.to_bytes(4, "little").hex()))
    return parts.select("sequence_id", "length", F.unhex(hexed).alias("ids"))
