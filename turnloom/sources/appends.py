"""Reading log files again: only what was appended, where the rest is unchanged.

The ledger holds a row per file as it was last read: (origin, size, checksum, modified, tail_time, n_records, failed, n_sessions).
``plan`` compares it with the files as they are: ``reuse`` unchanged ones, read the
appended bytes of ``append`` ones, and read ``full`` ones from the start. A file counts as appended if it grew, its time
and the latest time in its last lines moved, its old bytes have the checksum they had, the old or the new bytes meet at a
line end, none of its lines failed before, and it held one session.

Checksums stream through tasks piece by piece, a task hashes files one after the other, and bytes before
an appended part are hashed but not parsed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.sources import jsonl

LEDGER = "origin string, size long, checksum string, modified timestamp, tail_time string, n_records long, failed boolean, n_sessions int"
PIECE, TAIL = 1 << 20, 1 << 16


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(origin, size, modified) of every file under ``path`` that holds anything; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("origin"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def opened(origin: str):
    files, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", origin))
    return files.open_input_file(inner)


def tail_lines(tail: bytes, cut: bool) -> list[str]:
    """The lines of a file's last bytes; one that they begin within doesn't count."""
    lines = tail.split(b"\n")[1:] if cut else tail.split(b"\n")
    return [t for t in (x.decode("utf-8", "replace").strip(T.SPACE) for x in lines) if t]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            old, whole, prefix, edge, at, tail = row["old_size"] or 0, hashlib.sha1(), None, b"", 0, b""
            with opened(row["origin"]) as file:
                while at < row["size"]:
                    stop = old if at < old else row["size"]
                    data = file.read_at(min(PIECE, stop - at), at)
                    if not data:
                        break
                    if at + len(data) == old or at == old:
                        edge += data[-1:] if at < old else data[:1]
                    whole.update(data)
                    at += len(data)
                    tail = (tail + data)[-TAIL:]
                    if at == old:
                        prefix = whole.hexdigest()
            out.append({"origin": row["origin"], "checksum": whole.hexdigest(), "prefix": prefix, "at_line_end": old == 0 or any(b in b"\n\r" for b in edge), "tail": tail_lines(tail, at > TAIL)})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("origin", pa.string()), ("checksum", pa.string()), ("prefix", pa.string()), ("at_line_end", pa.bool_()), ("tail", pa.list_(pa.string()))]))


def plan(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """(origin, size, modified, checksum, tail_time, action, start, first): what to do with each file; an append starts at byte ``start`` with record number ``first``."""
    old = ledger.select("origin", *(F.col(c).alias(f"old_{c}") for c in ("size", "checksum", "modified", "tail_time", "n_records", "failed", "n_sessions")))
    both = files.join(old, "origin", "left")
    seen = both.select("origin", "size", "old_size").mapInArrow(_hashed, "origin string, checksum string, prefix string, at_line_end boolean, tail array<string>")
    tails = seen.select("origin", F.posexplode("tail").alias("ordinal", "raw"))
    now = both.join(seen.drop("tail"), "origin").join(jsonl.tail_time(tails), "origin", "left")
    known = F.col("old_size").isNotNull()
    same_tail = F.col("tail_time").isNotNull() & F.col("tail_time").eqNullSafe(F.col("old_tail_time"))
    reuse = known & (F.col("size") == F.col("old_size")) & (F.col("checksum") == F.col("old_checksum")) & (F.col("old_tail_time").isNull() | F.col("tail_time").eqNullSafe(F.col("old_tail_time")))
    append = known & (F.col("size") > F.col("old_size")) & (F.col("modified") != F.col("old_modified")) & ~same_tail & F.col("prefix").eqNullSafe(F.col("old_checksum")) & F.col("at_line_end") & ~F.coalesce("old_failed", F.lit(False)) & (F.col("old_n_sessions") == 1)
    action = F.when(reuse, "reuse").when(append, "append").otherwise("full")
    grows = F.col("action") == "append"
    return now.withColumn("action", action).select("origin", "size", "modified", "checksum", "tail_time", "action", F.when(grows, F.col("old_size")).alias("start"), F.when(grows, F.col("old_n_records")).alias("first"))


def _appended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of the bytes from ``start`` on, numbered from ``first``."""
    space = T.SPACE
    for batch in batches:
        for row in batch.to_pylist():
            at, rest, n, held = row["start"], b"", row["first"], []

            def put(line: bytes) -> None:
                nonlocal n
                text = line.decode("utf-8", "replace").strip(space)
                if text:
                    held.append((row["origin"], n, text))
                    n += 1

            def sent() -> pa.RecordBatch:
                out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["origin", "ordinal", "raw"])
                held.clear()
                return out

            with opened(row["origin"]) as file:
                while at < row["size"]:
                    data = file.read_at(min(PIECE, row["size"] - at), at)
                    if not data:
                        break
                    at += len(data)
                    *whole, rest = re.split(rb"[\r\n]+", rest + data)
                    for line in whole:
                        put(line)
                    if held:
                        yield sent()
            put(rest)
            if held:
                yield sent()


def records(spark: SparkSession, planned: DataFrame) -> DataFrame:
    """(origin, ordinal, raw) of what ``plan`` says to read; a file's numbers go on where the ledger left them."""
    added = planned.where("action = 'append'").select("origin", "size", "start", "first").mapInArrow(_appended, "origin string, ordinal long, raw string")
    # A list of files, as Spark's own readers keep one on the driver.
    whole = [r.origin for r in planned.where("action = 'full'").select("origin").collect()]
    return added.unionByName(jsonl.lines(spark, whole)) if whole else added


def next_ledger(planned: DataFrame, read: DataFrame, ledger: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """The ledger after reading: files that are gone keep their row, reused ones too. ``sessions`` (origin, n_sessions) says how many a file holds, else one."""
    bad = F.coalesce(~F.schema_of_variant(F.try_parse_json("raw")).startswith("OBJECT"), F.lit(True)) & F.try_parse_json("raw").isNull()
    counts = read.groupBy("origin").agg(F.max("ordinal").alias("last"), F.bool_or(bad).alias("bad"))
    now = planned.where("action != 'reuse'").join(counts, "origin", "left").withColumn("n_records", F.coalesce(F.col("last") + 1, F.col("first"), F.lit(0)))
    now = now.join(sessions, "origin", "left") if sessions is not None else now.withColumn("n_sessions", F.lit(1))
    fresh = now.select("origin", "size", "checksum", "modified", "tail_time", F.col("n_records").cast("long").alias("n_records"), F.coalesce("bad", F.lit(False)).alias("failed"), F.coalesce("n_sessions", F.lit(0)).cast("int").alias("n_sessions"))
    return ledger.join(fresh.select("origin"), "origin", "left_anti").select(*fresh.columns).unionByName(fresh)
