"""Removal of long byte strings that occur more than once, by suffix order.

Every byte covered by a ``LENGTH``-byte string that also starts anywhere else, in
the same text or another, is removed; strings are judged on the input.

Where to look: each ``LENGTH``-byte window picks the least hashed ``GRAM``-byte gram
in it (its anchor, the leftmost on ties). Equal windows pick equal anchors at equal
places, so only windows of equal anchors need be compared, and each window has one
anchor. Consecutive windows of one anchor make a segment. Only anchors met twice
go on, equal segments of an anchor travel once (two copies stand for all), and
only their digests are shuffled until then.

How: a segment whose bytes next to the anchor no other segment of it has, on either
side, can't share a window and is left out, as is the half of one that meets others
on one side only. What stays of a group of anchors is joined, its suffixes sorted, and the
Burrows-Wheeler transform is extended backwards breadth first. Each level
gives the suffixes whose common prefix with the next has that length; it stops at
``LENGTH``. What has no value by then shares ``LENGTH`` bytes or more.

An anchor with more than ``CROWD`` different segments is not gathered: its segments
are split where they lie before the anchor, into ever smaller cells, and each part
goes by the hash of the bytes that all windows of its cell share, so copies fall
together and the others drop out.

Defined cases: a null text is empty; texts shorter than ``LENGTH`` lose nothing; rows
that repeat, their doc_id too, are separate texts and cover each other; a null
doc_id is an id like others; an empty table gives no rows; extra columns are
kept, whatever their names, but for ``remove``'s own two.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from turnloom.llm.common import cut, forget, fresh
from turnloom.llm.mphf import mix
from turnloom.llm.word_bpe import as_bytes

LENGTH, GRAM = 400, 32
CROWD = 1000
#: Bytes hashed at a time, and bytes of segments whose suffixes are sorted together.
STRETCH, SORTED = 1 << 20, 1 << 20
#: Segments with runs that a worker sends on at a time.
MOST_FOUND = 20_000
PLACE_BITS = 24

_ODD = 0xD6E8FEB86659FD93
_VALUES = mix(np.arange(256, dtype=np.uint64), 23)


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]), dtype=np.uint64) for b in (_ODD, _inverse(_ODD)))


class Hashes:
    """64-bit hashes of any stretch of some bytes."""

    def __init__(self, data: np.ndarray):
        forth, self.back = _powers(max(STRETCH + LENGTH, 1 << len(data).bit_length()))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * forth[: len(data)], dtype=np.uint64)])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[stop] - self.sums[start]) * self.back[start], 29)


def segments(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(anchor, digest, start, windows, lead) of the segments of one stretch of text."""
    n = len(data) - length + 1
    gram = min(GRAM, length)
    hashes = Hashes(data)
    at = np.arange(len(data) - gram + 1)
    grams = hashes.of(at, at + gram)
    least = (grams & np.uint64((1 << 64) - (1 << PLACE_BITS))) | at.astype(np.uint64)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    place = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    stops = np.append(starts[1:], n)
    anchor = place[starts]
    digest = mix(hashes.of(starts, stops + length - 1) ^ mix((anchor - starts).astype(np.uint64), 31), 37) ^ (stops - starts).astype(np.uint64)
    return grams[anchor], digest, starts, stops - starts, anchor - starts


SEGMENT = "rid long, did long, anchor long, digest long, start long, windows int, lead int"


def _scan(docs: DataFrame, length: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            rid, did = (batch.column(c).to_pylist() for c in ("rid", "did"))
            held: list[list] = [[] for _ in range(7)]
            size = 0

            def out() -> pa.RecordBatch:
                kinds = [np.int64] * 5 + [np.int32] * 2
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(h).astype(k, copy=False)) for h, k in zip(held, kinds, strict=True)], ["rid", "did", "anchor", "digest", "start", "windows", "lead"])

            for i in range(len(texts)):
                data = np.frombuffer(texts[i].as_buffer(), np.uint8)
                for base in range(0, len(data) - length + 1, STRETCH):
                    anchor, digest, start, windows, lead = segments(data[base : base + STRETCH + length - 1], length)
                    k = len(start)
                    for h, x in zip(held, (np.full(k, rid[i]), np.full(k, did[i]), anchor.view(np.int64), digest.view(np.int64), start + base, windows, lead), strict=True):
                        h.append(x)
                    size += k
                if size > 50_000:
                    yield out()
                    held, size = [[] for _ in range(7)], 0
            if size:
                yield out()

    return docs.mapInArrow(rows, SEGMENT)


def repeats(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each place of ``data``, whether its next ``length`` bytes also start elsewhere in it.

    ``data`` ends in at least one byte 255, as does every part of it that stands for itself.
    """
    n = len(data)
    padded = np.concatenate([data, np.full(8, 255, np.uint8)])
    size = min(8, 1 << length.bit_length() - 1)
    rank = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n].copy().view(">u8").ravel().astype(np.uint64) >> np.uint64(64 - 8 * size)
    # Classes by ever more first bytes, three ranks to a key where they fit. A class's rank is its first place in the order; places of
    # classes of one are settled, so only the others are sorted again. Suffixes still equal at the end lie in any order, as no
    # interval parts them.
    order = np.argsort(rank)
    fresh = np.concatenate([[True], np.diff(rank[order]) != 0, [True]])
    # Ranks count from 1; behind the end all are 0.
    rank = np.zeros(n + 2 * length + 1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(fresh[:-1], np.arange(1, n + 1, dtype=np.int32), 0))
    opened = np.flatnonzero(~(fresh[:-1] & fresh[1:]))
    bound, terms = None, 3 if n + 1 < 1 << 21 else 2
    while True:
        # Boundaries known before the walk: suffixes that differ in their first ``base`` bytes.
        if bound is None or size <= length // 4:
            bound, base, known = fresh.copy(), size, rank.copy()
        if size > length or not len(opened):
            break
        place = order[opened]
        key = rank.take(place).astype(np.int64)
        for k in range(1, terms):
            key *= n + 1
            key += rank[k * size :].take(place)
        by = np.argsort(key)
        key, place = key.take(by), place.take(by)
        new = np.concatenate([[True], key[1:] != key[:-1], [True]])
        order[opened] = place
        rank[place] = np.maximum.accumulate(np.where(new[:-1], opened + 1, 0))
        fresh[opened] |= new[:-1]
        opened = opened[~(new[:-1] & new[1:])]
        size *= terms
    suffix = order
    of = np.empty(n, np.int32)
    of[suffix] = np.arange(n)
    before = data[suffix - 1]  # the transform; the first place wraps around to a closing byte
    back = of[suffix - 1]
    low = high = np.zeros(0, np.int64)
    if base < length:
        # The first extension takes every interval: a byte, then a class.
        follows, byte = known[1:].take(suffix), data.take(suffix)
        further = np.concatenate([[True], (follows[1:] != follows[:-1]) | (byte[1:] != byte[:-1]), [True]])
        high = np.flatnonzero(further & ~bound) - 1
        low = np.maximum.accumulate(np.where(further[:-1], np.arange(n), 0))[high]
        bound = further
    for _ in range(base + 1, length):
        if not len(low):
            break
        sizes = high - low + 1
        owner = np.repeat(np.arange(len(low)), sizes)
        place = np.arange(int(sizes.sum())) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)
        key = owner * 256 + before[place]
        to = back[place]
        if len(key) > len(low):
            by = np.argsort(key)
            key, to = key[by], to[by]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        low, high = np.minimum.reduceat(to, starts), np.maximum.reduceat(to, starts)
        fresh = ~bound[high + 1]
        low, high = low[fresh], high[fresh]
        bound[high + 1] = True
    shares = np.zeros(n + 1, bool)
    shares[:-1] |= ~bound[:-1]
    shares[:-1] |= ~bound[1:]
    out = np.zeros(n, bool)
    out[suffix] = shares[:-1]
    return out


RUNS = "anchor long, digest long, runs array<struct<first:int,last:int>>"


def _likely(own: list[tuple[int, int, int, int, bytes]], length: int) -> list[tuple[int, int]]:
    """Of each segment of one anchor the first and last window that may be in another; none if the last lies before the first.

    A window has ``half`` bytes or more before its anchor or behind it, so those that lie next to the anchor meet in every two equal windows.
    """
    gram = min(GRAM, length)
    half = (length - gram) // 2
    lefts = [raw[lead - half : lead] if lead >= half else None for _, _, _, lead, raw in own]
    rights = [raw[lead + gram : lead + gram + half] if lead - len(raw) + length <= half else None for _, _, _, lead, raw in own]
    met = [Counter(lefts), Counter(rights)]
    out = []
    for (_, _, _, lead, raw), left, right in zip(own, lefts, rights, strict=True):
        on_left, on_right = (x is not None and m[x] > 1 for x, m in zip((left, right), met, strict=True))
        first, last = 0, len(raw) - length
        if not on_left:
            first = max(first, lead - half)
        if not on_right:
            last = min(last, lead - half)
        out.append((first, last) if on_left or on_right else (0, -1))
    return out


def walked(rows: Iterator[tuple[int, int, int, int, bytes]], length: int) -> Iterator[pa.RecordBatch]:
    """RUNS of (anchor, digest, copies, lead, bytes), whole anchors in a row. Only windows that may be in another segment go through the transform."""
    found: list[tuple[int, int, list[tuple[int, int]]]] = []
    held: list[tuple[int, int, int, bytes]] = []

    def out() -> pa.RecordBatch:
        if held:
            marks = repeats(np.frombuffer(b"\xff".join(h[3] for h in held) + b"\xff", np.uint8), length)
            begin = 0
            for anchor, digest, first, raw in held:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], marks[begin : begin + len(raw) - length + 1].astype(np.int8), [0]])))
                if len(edge) and first >= 0:
                    found.append((anchor, digest, [(first + int(a), first + int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]))
                begin += len(raw) + 1
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        runs = [[{"first": a, "last": b} for a, b in f[2]] for f in found]
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array(runs, kind)], ["anchor", "digest", "runs"])

    size = 0
    for _, group in groupby(rows, key=lambda r: r[0]):
        own = list(group)
        # All windows of a segment that stands for two are met twice; it is walked for the others alone.
        found += [(anchor, digest, [(0, len(raw) - length)]) for anchor, digest, copies, _, raw in own if copies > 1]
        likely = [(row, *ends) for row, ends in zip(own, _likely(own, length), strict=True) if ends[0] <= ends[1]]
        if any(row[2] == 1 for row, _, _ in likely):
            for (anchor, digest, copies, _, raw), first, last in likely:
                held.append((anchor, digest, first if copies == 1 else -1, raw[first : last + length]))
                size += len(held[-1][3])
        if size >= SORTED or len(found) >= MOST_FOUND:
            yield out()
            found, held, size = [], [], 0
    if found or held:
        yield out()


def _walk(rows: DataFrame, length: int) -> DataFrame:
    """RUNS of repeated windows of each segment: (anchor, digest, copies, lead, bytes), whole anchors together."""
    columns = ("anchor", "digest", "copies", "lead", "bytes")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from walked((row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)), length)

    return rows.repartition("anchor").sortWithinPartitions("anchor").select(*columns).mapInArrow(walk, RUNS)


def _cells(rows: DataFrame, length: int, width: int) -> DataFrame:
    """The parts of each segment in cells of ``width`` places before the anchor, under the hash of the bytes that all windows of a cell share."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for anchor, digest, copies, lead, raw in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "copies", "lead", "bytes")), strict=True):
                hashes, windows = Hashes(np.frombuffer(raw, np.uint8)), len(raw) - length + 1
                # A window that starts p places before the anchor is in cell p // width; the segment goes from lead down.
                a = 0
                while a < windows:
                    cell = (lead - a) // width
                    b = min(windows, lead - cell * width + 1)
                    # The cell's windows start between ``early`` and ``late``; all hold the bytes from late to early + length.
                    late, early = lead - cell * width, lead - cell * width - width + 1
                    core = hashes.of(np.array([late]), np.array([early + length])) ^ mix(np.array([cell]), 41 + width)
                    whole = hashes.of(np.array([a]), np.array([b - 1 + length])) ^ mix(np.array([lead - a]), 43)
                    for _ in range(copies):
                        for column, x in zip(out, (anchor, digest, a, int(core.view(np.int64)[0]), int(whole.view(np.int64)[0]), lead - a, raw[a : b - 1 + length]), strict=True):
                            column.append(x)
                    a = b
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["up_anchor", "up_digest", "shift", "anchor", "digest", "lead", "bytes"])

    return rows.select("anchor", "digest", "copies", "lead", "bytes").mapInArrow(split, "up_anchor long, up_digest long, shift int, anchor long, digest long, lead int, bytes binary")


def _repeated(rows: DataFrame, length: int, width: int | None = None) -> DataFrame:
    """RUNS of (anchor, digest, copies, lead, bytes); crowded anchors go by ever smaller cells until they aren't."""
    width = width or 1 << (length - 1).bit_length() >> 1
    crowds = cut(rows.groupBy("anchor").count().where(F.col("count") > CROWD).select("anchor"), "crowds")
    # Cells of one place hold equal windows only, which never crowd.
    if width < 1 or crowds.isEmpty():
        return cut(_walk(rows, length), "runs")
    calm = cut(_walk(rows.join(crowds, "anchor", "left_anti"), length), "runs")
    parts = cut(_cells(rows.join(crowds, "anchor", "left_semi"), length, width), "cells")
    # One row for equal parts; those whose core nobody else has drop out.
    each = parts.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.first("lead").alias("lead"), F.first("bytes").alias("bytes"))
    met = each.groupBy("anchor").agg(F.sum("n").alias("all")).where("all > 1").select("anchor")
    each = cut(each.join(met, "anchor", "left_semi").select("anchor", "digest", F.least(F.col("n"), F.lit(2)).cast("int").alias("copies"), "lead", "bytes"), "cells")
    deeper = _repeated(each, length, width >> 1)
    found = deeper.join(parts.select("up_anchor", "up_digest", "shift", "anchor", "digest").distinct(), ["anchor", "digest"])
    moved = found.select(F.col("up_anchor").alias("anchor"), F.col("up_digest").alias("digest"), F.transform("runs", lambda r: F.struct((r["first"] + F.col("shift")).alias("first"), (r["last"] + F.col("shift")).alias("last"))).alias("runs"))
    moved = moved.groupBy("anchor", "digest").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return calm.unionByName(cut(moved, "runs"))


def spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(rid, did, spans) of the texts of (rid, did, text) that lose bytes; spans are [first, stop) in order, disjoint and apart."""
    every = cut(_scan(docs, length), "segments")
    # Written, so that the join's both sides are dealt out for it alone and a hot anchor can be split.
    met = cut(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors-met")
    rows = cut(every.join(met, "anchor", "left_semi"), "segments-met")
    forget(every, met)
    spot = F.struct("did", "rid", "start", "windows")
    kinds = rows.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.first("lead").alias("lead"), F.min(spot).alias("one"), F.max(spot).alias("two"))
    # Two copies of an equal segment, read from two places where there are two, stand for all.
    asked = kinds.select("anchor", "digest", "n", "lead", F.explode(F.array_distinct(F.array("one", "two"))).alias("at")).select("anchor", "digest", "n", "lead", "at.*")
    text = docs.select("rid", "did", F.col("text").cast("binary").alias("raw"))
    read = asked.join(text, ["rid", "did"]).select("anchor", "digest", "n", "lead", F.substring("raw", F.col("start").cast("int") + 1, F.col("windows") + length - 1).alias("bytes"))
    read = read.groupBy("anchor", "digest").agg(F.first("n").alias("n"), F.first("lead").alias("lead"), F.first("bytes").alias("bytes"))
    wanted = cut(read.select("anchor", "digest", F.least(F.col("n"), F.lit(2)).cast("int").alias("copies"), "lead", "bytes"), "segments-read")
    runs = _repeated(wanted, length)
    forget(wanted)
    found = rows.join(runs, ["anchor", "digest"]).select("rid", "did", F.explode(F.transform("runs", lambda r: F.struct((F.col("start") + r["first"]).alias("first"), (F.col("start") + r["last"] + length).alias("stop")))).alias("s"))
    gathered = found.groupBy("rid", "did").agg(F.array_sort(F.collect_set("s")).alias("s"))
    # Spans that overlap or touch become one.
    empty = F.array().cast("array<struct<first:bigint,stop:bigint>>")
    merged = F.aggregate(
        "s",
        F.struct(empty.alias("done"), F.lit(-1).cast("long").alias("first"), F.lit(-1).cast("long").alias("stop")),
        lambda acc, x: F.when(
            x["first"] <= acc["stop"], F.struct(acc["done"].alias("done"), acc["first"].alias("first"), F.greatest(acc["stop"], x["stop"]).alias("stop"))
        ).otherwise(
            F.struct(
                F.when(acc["stop"] < 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), acc["stop"].alias("stop"))))).alias("done"),
                x["first"].alias("first"),
                x["stop"].alias("stop"),
            )
        ),
        lambda acc: F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), acc["stop"].alias("stop")))),
    )
    return gathered.select("rid", "did", merged.alias("spans"))


def _pieces(texts: pa.Array, spans: pa.Array, words: int = 0) -> Iterator[list[bytes] | None]:
    """What lies between the spans of each text; None where there are none. Spans of fewer ``words`` and under LENGTH bytes stay."""
    for raw, own in zip(as_bytes(texts).to_pylist(), spans.to_pylist(), strict=True):
        if own is None:
            yield None
            continue
        own = [s for s in own if s["stop"] - s["first"] >= LENGTH or len(raw[s["first"] : s["stop"]].split()) >= words]
        ends = [0, *(s["stop"] for s in own)]
        yield [raw[a:b] for a, b in zip(ends, [*(s["first"] for s in own), len(raw)], strict=True)]


@F.arrow_udf(BinaryType())
def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([p and b"".join(p) for p in _pieces(texts, spans)], pa.binary())


def _readable(words: int):
    @F.arrow_udf(StringType())
    def readable(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([p and "".join(x.decode("utf-8", "ignore") for x in p) for p in _pieces(texts, spans, words)], pa.string())

    return readable


def _marked(docs: DataFrame, length: int, key: str, text: str) -> tuple[DataFrame, Column]:
    """``docs`` with the spans of each text, and that column; working names are none of ``docs``'s own."""
    rid, did, mark = fresh(docs, "rid", "did", "spans")
    whole = F.coalesce(F.col(text), F.lit(""))
    named = docs.withColumn(did, F.coalesce(F.col(key).cast("long"), F.lit(-1).cast("long"))).withColumn(rid, F.xxhash64(F.col(key).isNull(), did, whole))
    found = spans(named.where(F.octet_length(whole) >= length).select(F.col(rid).alias("rid"), F.col(did).alias("did"), whole.alias("text")), length)
    found = found.withColumnsRenamed({"rid": rid, "did": did, "spans": mark})
    return named.join(found, [rid, did], "left").select(*docs.columns, mark), F.col(mark)


def remove(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every column of ``docs`` and: spans (null where nothing goes), kept (the bytes that stay). Input columns of these two names are replaced."""
    out, own = _marked(docs, length, key, text)
    whole = F.coalesce(F.col(text), F.lit(""))
    kept = F.coalesce(_without(F.when(own.isNotNull(), whole), own), whole.cast("binary"))
    return out.select(*(c for c in docs.columns if c.lower() not in ("spans", "kept")), own.alias("spans"), kept.alias("kept"))


def strip(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", words: int = 0) -> DataFrame:
    """``docs`` with shortened texts; a character of which bytes went goes with them.

    Of repeats that are shorter than LENGTH bytes only stretches of at least ``words`` words go.
    """
    out, own = _marked(docs, length, key, text)
    short = _readable(words)(F.when(own.isNotNull(), F.col(text)), own)
    return out.withColumn(text, F.when(own.isNull(), F.col(text)).otherwise(short)).select(*docs.columns)
