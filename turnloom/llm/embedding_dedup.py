"""Embedding near-dedup through a pivot-permutation index.

A vector is described by its ``NEAREST`` pivots, nearest first. Each pivot has an
inverted list of the vectors that name it; two vectors are candidates when they
share at least ``SHARED`` pivots, and candidates are verified by their cosine in
double precision. Equal vectors are one entry with a count.

The pivots are a sample of the distinct vectors (twice the square root of their number,
at most ``MOST_PIVOTS`` in all, which lengths share by their numbers but for ``LEAST_PIVOTS`` each), in the order of a hash of their id, thinned: one whose cosine
with an earlier one is ``THIN`` or more is none. So a dense group has few pivots
however large it is, and its members share them. Every vector is indexed. Lists are cut into blocks, and each pair of blocks of a list is one
group: a list that holds a third of all vectors is many groups of bounded size.
A pair found in several lists counts in the list of its smallest shared pivot
only. Groups return one row per linked vector - how many it links with, and
the smallest of its own part of the group - never pairs.

Vectors link with vectors of their own length only. Each of the ``INDEXED`` lengths
that most vectors have gets pivots of its own; any other length is one list, which
is cut into blocks as every list is and compared whole.

Defined cases: a vector that is null, empty or zero or holds a null or a non-finite
component links with nothing, and so does a row with a null vec_id (its component is
null); repeated rows are separate vectors; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import cut
from turnloom.llm.components import components, roots

COSINE = 0.95
NEAREST, SHARED = 12, 2
LEAST_PIVOTS, MOST_PIVOTS = 32, 4096
#: Lengths of vectors that get pivots of their own.
INDEXED = 16
#: Pivots lie further apart than this cosine; so many times the wanted pivots are looked at.
THIN, LOOKED_AT = 0.8, 2
BLOCK = 1024
#: Where one pair in so many is close, a matrix product counts what they share. More than any pair shares.
DENSE, EARLIER = 16, 1000


def _checked(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, code, vec): unit-free doubles as bytes and their digest, both null where the row can't link."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, raw = [], []
            for own, known in zip(batch.column("v").to_pylist(), batch.column("k").is_valid().to_pylist(), strict=True):
                x = None
                if known and own and None not in own:
                    x = np.array(own, np.float64) + 0.0
                    if not np.isfinite(x).all() or not np.isfinite(scale := np.abs(x).max()) or scale == 0:
                        x = None
                codes.append(None if x is None else hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                raw.append(None if x is None else x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(codes, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "code", "vec"])

    return vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(rows, "vec_id long, code binary, vec binary")


def unit(raw: list[bytes]) -> np.ndarray:
    """Rows scaled to length 1; scaled by their largest component first, so no square over- or underflows."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def thinned(sample: np.ndarray, wanted: int) -> np.ndarray:
    """The first ``wanted`` unit vectors of ``sample`` that have a cosine below THIN with each other, greedily."""
    kept = sample[:0]
    for i in range(0, len(sample), 256):
        part = sample[i : i + 256]
        part = part[(part @ kept.T).max(axis=1, initial=-1) < THIN]
        likeness, own = part @ part.T, []
        for j in range(len(part)):
            if likeness[j, own].max(initial=-1) < THIN:
                own.append(j)
        kept = np.vstack([kept, part[own]])
        if len(kept) >= wanted:
            break
    return kept[:wanted]


def _lists(nodes: DataFrame, pivots: dict[int, tuple[int, np.ndarray]]) -> DataFrame:
    """One row per vector and pivot it names: pivot, rep, many, near (its pivots in order, as 32-bit integers), vec.

    ``pivots`` holds of a length the number of its first pivot and all of them; a length that it lacks names one pivot of its own.
    """
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)

    def nearest(size: int, vec: list[bytes]) -> np.ndarray:
        if size not in shared.value:
            return np.full((len(vec), 1), -size, np.int32)
        first, own = shared.value[size]
        likeness = unit(vec) @ own.T
        k = min(NEAREST, len(own))
        near = np.argpartition(-likeness, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(likeness, near, 1), axis=1, kind="stable"), 1)
        return (near + first).astype(np.int32)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes = part.column("size").to_numpy()
                for size in np.unique(sizes):
                    own = part.take(pa.array(np.flatnonzero(sizes == size)))
                    near = nearest(int(size), own.column("vec").to_pylist())
                    pick = pa.array(np.repeat(np.arange(own.num_rows), near.shape[1]))
                    names = pa.array([row.tobytes() for row in near], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), *(own.column(c).take(pick) for c in ("rep", "many")), names.take(pick), own.column("vec").take(pick)], ["pivot", "rep", "many", "near", "vec"])

    return nodes.mapInArrow(rows, "pivot int, rep long, many long, near binary, vec binary")


def _common(p: np.ndarray, q: np.ndarray, pivot: int) -> np.ndarray:
    """How many pivots rows of p and q share, each counted EARLIER times if it is before ``pivot``."""
    same = (p[:, :, None] == q[:, None, :]).any(2)
    return (same * np.where(p < pivot, EARLIER, 1)).sum(1)


def _group(cosine: float, shared: int):
    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pivot, low, high = (int(x) for x in key)
        rows = rows.sort_values("rep", ignore_index=True)
        x = unit(rows["vec"].tolist())
        near = np.frombuffer(b"".join(rows["near"]), np.int32).reshape(len(rows), -1)
        side = rows["block"].to_numpy()
        left = np.flatnonzero(side == low)
        right = np.flatnonzero(side == high)
        # Of each row, the pivots it names; those before this list's weigh more than all others together.
        names, held = np.unique(near, return_inverse=True)
        earlier = np.where(names < pivot, EARLIER, 1).astype(np.float32)
        ones = None
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(left), 256):
            own = left[i : i + 256]
            dots = x[own] @ x[right].T
            close = dots >= cosine - 1e-9
            if low == high:
                close &= own[:, None] < right
            p, q = np.nonzero(close)
            if DENSE * len(p) > close.size:
                if ones is None:
                    ones = np.zeros((len(rows), len(names)), np.float32)
                    ones[np.arange(len(rows))[:, None], held.reshape(near.shape)] = 1
                common = ((ones[own] * earlier) @ ones[right].T)[p, q]
            else:
                common = np.concatenate([np.zeros(0), *(_common(near[own[p[k : k + 65536]]], near[right[q[k : k + 65536]]], pivot) for k in range(0, len(p), 65536))])
            # A vector of few pivots can't share more than it names.
            kept = (common >= min(shared, near.shape[1])) & (common < EARLIER)
            p, q = p[kept], q[kept]
            # The dot product of each pair by itself, in one order, settles what lies at the threshold.
            edge = np.flatnonzero(dots[p, q] < cosine + 1e-9)
            kept = np.ones(len(p), bool)
            kept[edge] = np.einsum("ij,ij->i", x[own[p[edge]]], x[right[q[edge]]]) >= cosine
            found_a.append(own[p[kept]])
            found_b.append(right[q[kept]])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        many = rows["many"].to_numpy()
        links = np.bincount(a, many[b], len(rows)) + np.bincount(b, many[a], len(rows))
        linked = np.flatnonzero(links)
        reps = rows["rep"].to_numpy()
        return pd.DataFrame({"rep": reps[linked], "links": links[linked].astype(np.int64), "root": reps[roots(len(rows), a, b)[linked]]})

    return compare


def link(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``."""
    rows = cut(_checked(vectors, key, vector), "vectors")
    nodes = cut(rows.where("code IS NOT NULL").groupBy("code").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many"), F.first("vec").alias("vec")), "vector-nodes")
    n = nodes.count()
    base = rows.join(nodes.select("code", "rep", "many"), "code", "left")
    alone = F.coalesce(F.col("many") - 1, F.lit(0).cast("long"))
    if n < 2:
        out = base.select("vec_id", alone.alias("n_links"), F.coalesce("rep", "vec_id").alias("component_id"))
        return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))
    nodes = nodes.withColumn("size", F.expr("octet_length(vec) div 8").cast("int"))
    pivots, named = {}, 0
    for size, held in nodes.groupBy("size").count().orderBy(F.desc("count"), "size").limit(INDEXED).collect():
        wanted = max(LEAST_PIVOTS, min(MOST_PIVOTS * held // n, round(2 * held**0.5)))
        # At most LOOKED_AT * MOST_PIVOTS rows, and so many times LEAST_PIVOTS of each length.
        chosen = nodes.where(F.col("size") == size).orderBy(F.xxhash64("rep"), "rep").limit(LOOKED_AT * wanted).select("vec").collect()
        pivots[size] = (named, thinned(unit([bytes(r["vec"]) for r in chosen]), wanted))
        named += len(pivots[size][1])
    entries = cut(_lists(nodes, pivots), "pivot-lists")
    # One row per pivot.
    blocks = entries.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = entries.join(F.broadcast(blocks), "pivot").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("pivot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "many", "near", "vec")
    found = cut(paired.groupBy("pivot", "low", "high").applyInPandas(_group(cosine, SHARED), "rep long, links long, root long"), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(found, "rep", "root")
    out = base.join(counts, "rep", "left").join(labels, F.col("rep") == F.col("node"), "left")
    out = out.select("vec_id", (alone + F.coalesce("links", F.lit(0).cast("long"))).alias("n_links"), F.coalesce("component", "rep", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))
