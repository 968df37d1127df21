"""Token ids as raw binary shards with a minimal-perfect-hash index.

A store is a set of shards in key order. Each shard is two files:

``*.bin``  the ids of its documents, one after the other, little-endian
           unsigned integers of 2 bytes where the vocabulary allows, else 4;
``*.idx``  the documents' keys in order, a minimal perfect hash over the
           distinct keys, and per slot a 32-bit fingerprint of the key and the
           first row of that key. A key finds its ids in constant time: slot,
           fingerprint, row, offset.

Spark deals the documents out by key range, so shards follow each other in key
order; one task writes one or more shards as its rows stream by. File names
carry the task attempt, and only the manifest, a parquet table with one row per
shard, says which files count: a lost or repeated attempt leaves none behind
that a reader would see.

Defined cases: a null text is empty; a null key sorts first; rows with equal
keys are stored one after the other (by text) and all are returned; an empty
table gives a store without shards; other columns of the input are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.llm.common import scratch_path
from turnloom.llm.mphf import MinimalPerfectHash, fingerprint, mix
from turnloom.llm.word_bpe import as_bytes, encoder, slices

#: Ids after which a task starts its next shard.
SHARD_IDS = 64 << 20

MANIFEST = "path string, part int, piece int, n_docs long, n_null long, n_ids long, width int, low long, high long"


def key_hash(keys: np.ndarray, null: np.ndarray) -> np.ndarray:
    """64-bit hashes of long keys, null keys apart; distinct for distinct keys, but for that one value."""
    out = mix(keys.astype(np.int64).view(np.uint64), 7)
    out[null] = np.uint64(0x5EED)
    return out


class _Shard:
    """One open shard."""

    def __init__(self, folder: str, name: str, width: int):
        self.files, root = fs.FileSystem.from_uri(folder)
        self.files.create_dir(root, recursive=True)
        self.path, self.width = f"{root}/{name}", width
        self.uri = f"{folder}/{name}"
        self.out = self.files.open_output_stream(self.path + ".bin")
        self.keys: list[np.ndarray] = []
        self.null: list[np.ndarray] = []
        self.lens: list[np.ndarray] = []
        self.n_ids = 0

    def add(self, keys: np.ndarray, null: np.ndarray, ids: np.ndarray, lens: np.ndarray) -> None:
        self.out.write(np.ascontiguousarray(ids.astype("<u2" if self.width == 2 else "<u4")))
        self.keys.append(keys)
        self.null.append(null)
        self.lens.append(lens)
        self.n_ids += len(ids)

    def close(self) -> dict:
        self.out.close()
        keys, null, lens = (np.concatenate(x) for x in (self.keys, self.null, self.lens))
        hashes, first = np.unique(key_hash(keys, null), return_index=True)
        index = MinimalPerfectHash.build(hashes)
        slot = index.slots(hashes)
        marks, rows = np.zeros(index.size, np.uint32), np.zeros(index.size, np.int64)
        marks[slot], rows[slot] = fingerprint(hashes), first
        held = io.BytesIO()
        np.savez(held, keys=keys, null=null, lens=lens, marks=marks, rows=rows, mph=np.frombuffer(index.to_bytes(), np.uint8))
        with self.files.open_output_stream(self.path + ".idx") as out:
            out.write(held.getvalue())
        real = keys[~null]
        return {"n_docs": len(keys), "n_null": int(null.sum()), "n_ids": self.n_ids, "low": int(real.min()) if len(real) else None, "high": int(real.max()) if len(real) else None}


class ShardReader:
    """Keyed access to one shard."""

    def __init__(self, path: str, width: int):
        self.files, self.path = fs.FileSystem.from_uri(path)
        self.width = width
        with self.files.open_input_stream(self.path + ".idx") as f:
            held = np.load(io.BytesIO(f.read()))
        self.keys, self.null, self.lens, self.marks, self.rows = (held[k] for k in ("keys", "null", "lens", "marks", "rows"))
        self.offsets = np.cumsum(self.lens) - self.lens
        self.index = MinimalPerfectHash.from_bytes(held["mph"].tobytes())
        self.payload = self.files.open_input_file(self.path + ".bin")

    def first_rows(self, keys: np.ndarray, null: np.ndarray) -> np.ndarray:
        """The first row of each key, -1 for keys that the shard doesn't hold."""
        hashes = key_hash(keys, null)
        slot = self.index.slots(hashes)
        found = slot >= 0
        found[found] = self.marks[slot[found]] == fingerprint(hashes[found])
        rows = np.where(found, self.rows[np.where(found, slot, 0)] if len(self.rows) else -1, -1)
        # A stranger can share slot and fingerprint; the stored key settles it.
        at = np.maximum(rows, 0)
        same = (rows >= 0) & (self.keys[at] == keys) & (self.null[at] == null)
        return np.where(same, rows, -1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids of the shard from one offset to another."""
        data = self.payload.read_at((stop - start) * self.width, start * self.width)
        return np.frombuffer(data, "<u2" if self.width == 2 else "<u4")

    def rows_ids(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some rows, one after the other, and how many each has: one read from the first to the last of them."""
        start, lens = self.offsets[rows], self.lens[rows]
        base = int(start.min())
        held = self.ids(base, int((start + lens).max()))
        return held[np.repeat(start - base - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))], lens

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of every row with this key."""
        null = np.array([key is None])
        row = int(self.first_rows(np.array([key or 0], np.int64), null)[0])
        out = []
        while 0 <= row < len(self.keys) and self.null[row] == null[0] and (key is None or self.keys[row] == key):
            a = int(self.offsets[row])
            out.append(self.ids(a, a + int(self.lens[row])))
            row += 1
        return out


def _longs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    null = column.is_null().to_numpy(zero_copy_only=False)
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), null


@dataclass
class TokenStore:
    spark: SparkSession
    path: str

    @property
    def manifest(self) -> DataFrame:
        """One row per shard; ``start`` counts the ids of all shards before it."""
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(self) -> DataFrame:
        """Every document by its key: doc_id, start, n_tokens, ids (binary, unsigned 32-bit little-endian)."""

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.to_pylist():
                    reader = ShardReader(shard["path"], shard["width"])
                    n = len(reader.keys)
                    # The place of each row among the rows of its key.
                    fresh = np.concatenate([[True], (reader.keys[1:] != reader.keys[:-1]) | (reader.null[1:] != reader.null[:-1])])[:n]
                    place = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
                    ends = np.cumsum(reader.lens)
                    at = 0
                    while at < n:
                        stop = max(at + 1, int(np.searchsorted(ends, ends[at] - reader.lens[at] + (1 << 20), side="right")))
                        keys, null = reader.keys[at:stop], reader.null[at:stop]
                        first = reader.first_rows(keys, null)
                        if (first < 0).any():
                            raise ValueError(f"the index of {shard['path']} misses one of its keys")
                        row = first + place[at:stop]
                        ids, lens = reader.rows_ids(row)
                        cuts = np.concatenate([[0], 4 * np.cumsum(lens)])
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(keys, pa.int64(), mask=null),
                                pa.array(shard["start"] + reader.offsets[row], pa.int64()),
                                pa.array(lens, pa.int64()),
                                pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(ids.astype("<u4"))]),
                            ],
                            ["doc_id", "start", "n_tokens", "ids"],
                        )
                        at = stop

        shards = self.manifest.select("path", "width", "start")
        return shards.repartition(max(1, shards.count()), "path").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids binary")

    def lookup(self, keys: DataFrame, column: str) -> DataFrame:
        """(doc_id, ids) of the stored rows whose key is in ``keys``, null too; each asked key costs one probe of each shard that spans it.

        Asked keys are dealt out by range, and each task reads of the manifest only the shards that its keys fall into.
        """
        wanted = keys.select(F.col(column).cast("long").alias("k")).distinct()
        manifest = f"{self.path}/manifest"

        def spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, root = fs.FileSystem.from_uri(manifest)
            shards = dataset.dataset(root, filesystem=files, format="parquet")
            for batch in batches:
                asked, null = _longs(batch.column("k"))
                real = np.sort(asked[~null])
                test = dataset.field("n_null") > 0 if null.any() else dataset.scalar(False)
                if len(real):
                    test |= (dataset.field("low") <= int(real[-1])) & (dataset.field("high") >= int(real[0]))
                for x in shards.to_table(filter=test).to_pylist():
                    a, b = (np.searchsorted(real, x["low"]), np.searchsorted(real, x["high"], side="right")) if x["low"] is not None else (0, 0)
                    own = [*([None] if null.any() and x["n_null"] else []), *real[a:b].tolist()]
                    if own:
                        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array([x["path"]] * len(own)), pa.array([x["width"]] * len(own), pa.int32())], ["k", "path", "width"])

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            path, reader = None, None
            for batch in batches:
                for x in batch.to_pylist():
                    if x["path"] != path:
                        path, reader = x["path"], ShardReader(x["path"], x["width"])
                    for ids in reader.get(x["k"]):
                        yield pa.RecordBatch.from_arrays([pa.array([x["k"]], pa.int64()), pa.array([ids.astype("<u4").tobytes()], pa.binary())], ["doc_id", "ids"])

        hits = wanted.repartitionByRange("k").sortWithinPartitions("k").mapInArrow(spanned, "k long, path string, width int")
        return hits.repartition("path").sortWithinPartitions("path", "k").mapInArrow(probe, "doc_id long, ids binary")


def write(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, path: str | None = None, key: str = "doc_id", text: str = "text", shard_ids: int = SHARD_IDS) -> TokenStore:
    """Encode ``text`` of every row and write the store, in ascending order of ``key``."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        coder = encoder(tokenizer_path, end_id)
        width = 2 if max(len(coder.ends_word) - 1, end_id or 0) < 1 << 16 else 4
        shard, piece = None, 0

        def done() -> pa.RecordBatch:
            own = {"path": shard.uri, "part": part, "piece": piece, "width": width} | shard.close()
            return pa.RecordBatch.from_pylist([own], pa.schema([("path", pa.string()), ("part", pa.int32()), ("piece", pa.int32()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("low", pa.int64()), ("high", pa.int64())]))

        for batch in batches:
            for rows in slices(batch, "text"):
                ids, lens = coder.encode(as_bytes(rows.column("text")).to_pylist())
                if shard is None:
                    shard = _Shard(f"{path}/shards", f"shard-{part:06d}-{piece:04d}-{attempt}", width)
                shard.add(*_longs(rows.column("k")), ids, lens)
                if shard.n_ids >= shard_ids:
                    yield done()
                    shard, piece = None, piece + 1
        if shard is not None:
            yield done()

    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Rows of an equal key may be many: a hash of the text lets the ranges split them.
    ranged = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("k", "h").sortWithinPartitions("k", "h", "text")
    ranged.select("k", "text").mapInArrow(shards, MANIFEST).write.parquet(f"{path}/manifest")
    return TokenStore(spark, path)
