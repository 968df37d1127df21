"""Exact dedup through a cuckoo-filter index.

Texts are equal when they are the same after every ASCII white-space character
is deleted. The index is split into buckets by digest. Each bucket holds

* a cuckoo filter over the live digests, which answers "surely new" or "maybe
  known" from two candidate cells of short fingerprints, and takes deletions;
* the stored keys: each live digest (SHA-256 of the normalised text), its
  number of live rows, its best row (most code points, then smallest doc_id).

A filter hit is verified against the bucket's stored keys; a filter that
overflows is rebuilt at twice the size from them. Buckets are sized from the
number of rows, so none outgrows a task; rows are combined per digest inside
each input batch before they are dealt out, so a text that holds a third of
all rows sends a bucket one row per batch.

Defined cases: a null text counts as empty; empty texts are equal to each other;
a null doc_id ranks after every other; repeated rows (same doc_id too) each
count and each get a row; an empty table gives an empty index; extra columns
are ignored, or kept by ``keep_best``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import cut, forget, fresh

#: The deleted characters: space, and tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"
CELL, KICKS = 4, 200
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 64
NO_ID = np.iinfo(np.int64).max


class CuckooFilter:
    """Fingerprints in cells of four; each key has two cells, either of which gives the other."""

    def __init__(self, n_cells: int = 64):
        self.n = 1 << max(1, (n_cells - 1).bit_length())
        self.cells: list[list[int]] = [[] for _ in range(self.n)]
        self.count = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[8:10], "little") or 1
        a = int.from_bytes(digest[10:18], "little") & (self.n - 1)
        return mark, a, self._other(mark, a)

    def _other(self, mark: int, at: int) -> int:
        return (at ^ (mark * 0x5BD1E995)) & (self.n - 1)

    def contains(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return mark in self.cells[a] or mark in self.cells[b]

    def insert(self, digest: bytes) -> bool:
        """False if the filter overflows; it must be rebuilt from the stored keys then."""
        mark, a, b = self._places(digest)
        for at in (a, b):
            if len(self.cells[at]) < CELL:
                self.cells[at].append(mark)
                self.count += 1
                return True
        at = b
        for kick in range(KICKS):
            cell = self.cells[at]
            mark, cell[kick % CELL] = cell[kick % CELL], mark
            at = self._other(mark, at)
            if len(self.cells[at]) < CELL:
                self.cells[at].append(mark)
                self.count += 1
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        for at in (a, b):
            if mark in self.cells[at]:
                self.cells[at].remove(mark)
                self.count -= 1
                return True
        return False

    def to_bytes(self) -> bytes:
        out = np.zeros((self.n, CELL), "<u2")
        for i, cell in enumerate(self.cells):
            out[i, : len(cell)] = cell
        return out.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        table = np.frombuffer(data, "<u2").reshape(-1, CELL)
        own = cls(len(table))
        own.cells = [[m for m in row if m] for row in table.tolist()]
        own.count = sum(map(len, own.cells))
        return own


class Bucket:
    """One bucket of the index: the filter and the stored keys behind it."""

    def __init__(self):
        self.filter = CuckooFilter()
        self.keys: dict[bytes, list] = {}

    def _grow(self) -> None:
        size = self.filter.n
        while True:
            size *= 2
            self.filter = CuckooFilter(size)
            if all(map(self.filter.insert, self.keys)):
                return

    def insert(self, digest: bytes, rows: int, chars: int, doc_id: int) -> None:
        if self.filter.contains(digest) and (held := self.keys.get(digest)) is not None:
            held[0] += rows
            if (-chars, doc_id) < (-held[1], held[2]):
                held[1:] = chars, doc_id
            return
        self.keys[digest] = [rows, chars, doc_id]
        if not self.filter.insert(digest):
            self._grow()

    def delete(self, digest: bytes, rows: int = 1) -> bool:
        """Take rows of a digest away; with its last one the digest goes from filter and keys."""
        if not self.filter.contains(digest) or digest not in self.keys:
            return False
        self.keys[digest][0] -= rows
        if self.keys[digest][0] <= 0:
            del self.keys[digest]
            self.filter.delete(digest)
        return True


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, chars) of every row; chars counts the original text's code points."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("chars"))


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per digest and batch."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table.set_column(0, "doc_id", pc.fill_null(table["doc_id"], NO_ID))
        top = table.group_by("digest").aggregate([("chars", "max"), ("doc_id", "count")])
        best = table.join(top, "digest").filter(pc.field("chars") == pc.field("chars_max")).group_by("digest").aggregate([("doc_id", "min"), ("chars", "max"), ("doc_id_count", "max")])
        yield from pa.table([best["digest"], best["doc_id_count_max"], best["chars_max"], best["doc_id_min"]], ["digest", "rows", "chars", "doc_id"]).combine_chunks().to_batches()


INDEX = "bucket long, filter binary, digests array<binary>, rows array<long>, chars array<long>, doc_ids array<long>"


def _bucket_of(n: int) -> Column:
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long"), F.lit(n))


def _changes(rows: DataFrame, n_buckets: int, sign: int) -> DataFrame:
    combined = rows.select("doc_id", "digest", F.col("chars").cast("long").alias("chars")).mapInArrow(_combine, "digest binary, rows long, chars long, doc_id long")
    return combined.select(_bucket_of(n_buckets).alias("bucket"), "digest", (F.col("rows") * sign).alias("rows"), "chars", "doc_id")


def _apply(changes: pd.DataFrame, bucket: Bucket) -> Bucket:
    for digest, rows, chars, doc_id in zip(changes["digest"], changes["rows"].tolist(), changes["chars"].tolist(), changes["doc_id"].tolist(), strict=True):
        if rows > 0:
            bucket.insert(bytes(digest), rows, chars, doc_id)
        else:
            bucket.delete(bytes(digest), -rows)
    return bucket


def _row(number: int, bucket: Bucket) -> pd.DataFrame:
    held = list(bucket.keys.values())
    return pd.DataFrame({"bucket": [number], "filter": [bucket.filter.to_bytes()], "digests": [list(bucket.keys)], "rows": [[h[0] for h in held]], "chars": [[h[1] for h in held]], "doc_ids": [[h[2] for h in held]]})


def bucket_count(rows: DataFrame) -> int:
    """Buckets for so many rows: each holds BUCKET_ROWS digests or so at most."""
    return max(LEAST_BUCKETS, -(-rows.count() // BUCKET_ROWS))


def build(rows: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """The index over rows of ``digests``: one row per bucket."""
    n = n_buckets or bucket_count(rows)
    return _changes(rows, n, 1).groupBy("bucket").applyInPandas(lambda key, own: _row(int(key[0]), _apply(own, Bucket())), INDEX)


def update(index: DataFrame, n_buckets: int, insert: DataFrame | None = None, delete: DataFrame | None = None) -> DataFrame:
    """The index after live rows were added and then others taken away.

    A deletion lowers the number of live rows of its digest. The best row of a
    digest that stays live is kept until the digest goes.
    """
    parts = [_changes(rows, n_buckets, sign) for rows, sign in ((insert, 1), (delete, -1)) if rows is not None]
    changes = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def merge(key: tuple, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        bucket = Bucket()
        for row in old.itertuples():
            bucket.filter = CuckooFilter.from_bytes(row.filter)
            bucket.keys = {bytes(d): [int(a), int(b), int(c)] for d, a, b, c in zip(row.digests, row.rows, row.chars, row.doc_ids, strict=True)}
        return _row(int(key[0]), _apply(new.sort_values("rows", ascending=False), bucket))

    return index.groupBy("bucket").cogroup(changes.groupBy("bucket")).applyInPandas(merge, INDEX)


def contains(index: DataFrame, n_buckets: int, rows: DataFrame) -> DataFrame:
    """(digest, live) for each distinct digest asked."""

    def probe(key: tuple, old: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        live = set()
        for row in old.itertuples():
            own, stored = CuckooFilter.from_bytes(row.filter), {bytes(d) for d in row.digests}
            live = {bytes(d) for d in asked["digest"] if own.contains(bytes(d)) and bytes(d) in stored}
        return pd.DataFrame({"digest": asked["digest"], "live": [bytes(d) in live for d in asked["digest"]]})

    asked = rows.select("digest").distinct().withColumn("bucket", _bucket_of(n_buckets))
    return index.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInPandas(probe, "digest binary, live boolean")


def groups(index: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of every live digest."""
    each = index.select(F.explode(F.arrays_zip("digests", "rows", "doc_ids")).alias("e"))
    return each.select(F.col("e.digests").alias("digest"), F.when(F.col("e.doc_ids") != NO_ID, F.col("e.doc_ids")).alias("keep_id"), F.col("e.rows").alias("group_size"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest for every row of ``docs``."""
    rows = cut(digests(docs, key, text), "exact-digests")
    index = cut(build(rows), "exact-index")
    # Only digests with copies travel; a row without a partner keeps itself.
    shared = groups(index).where("group_size > 1")
    out = rows.join(shared, "digest", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "digest")


def keep_best(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the row that stays of each group of equal texts, and no other of it.

    What goes is settled on digests and ids alone; the texts meet it once, by digest and id, so copies of one text don't meet in one task.
    """
    rows = cut(digests(docs, key, text), "exact-digests")
    index = cut(build(rows), "exact-index")
    shared = groups(index).where("group_size > 1")
    members = rows.join(shared, "digest").select("digest", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.coalesce("keep_id", F.lit(NO_ID)).alias("keep"))
    # Rows that repeat with their id would all be the best: one of them is enough.
    counted = members.groupBy("digest", "id", "keep").count().where("id != keep OR count > 1")
    gone = cut(counted.select("digest", "id", (F.col("id") == F.col("keep")).alias("again")), "exact-gone")
    forget(rows, index)
    mark, number = fresh(docs, "digest", "id")
    gone = gone.withColumnsRenamed({"digest": mark, "id": number})
    marked = docs.withColumn(mark, F.unhex(F.sha2(normalised(F.col(text)), 256))).withColumn(number, F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)))
    out = marked.join(gone, [mark, number], "left_anti")
    repeated = gone.where("again")
    if not repeated.isEmpty():
        # Of rows that share the best one's id too the longest text stays, of equally long ones the last in order.
        held = marked.join(repeated, [mark, number], "left_semi").groupBy(mark, number).agg(F.max_by(F.struct(*docs.columns), F.struct(F.length(text), F.col(text))).alias(fresh(docs, "row")[0]))
        out = out.select(*docs.columns).unionByName(held.select(f"{held.columns[-1]}.*"))
    return out.select(*docs.columns)
